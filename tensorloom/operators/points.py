"""Propagators that end on sampled points, and their high-mode projections.

All of them carry absolute times; the overlap M(t, e, p, c) is always joined at
the time of the end that it projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.plans.einsum import Tensor, add, contract
from tensorloom.plans.shared import Plan

#: (disp, dx, dy, dz): none, one step in each direction and back.
DISPLACEMENTS = ((0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, -1, 0, 0), (5, 0, -1, 0), (6, 0, 0, -1))


def displacements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DISPLACEMENTS), "disp long, dx long, dy long, dz long")


def matches(pts: DataFrame, moves: DataFrame, extents: tuple[int, int, int]) -> DataFrame:
    """(t, disp, p_l, p_r): pairs of points that a displacement joins, an equi-join on the moved coordinates."""
    lx, ly, lz = extents
    left = pts.join(moves).select(
        "t", "disp", F.col("p").alias("p_l"), F.pmod(F.col("x") + F.col("dx"), F.lit(lx)).alias("x"), F.pmod(F.col("y") + F.col("dy"), F.lit(ly)).alias("y"), F.pmod(F.col("z") + F.col("dz"), F.lit(lz)).alias("z")
    )
    return left.join(pts.select("t", "x", "y", "z", F.col("p").alias("p_r")), ["t", "x", "y", "z"]).select("t", "disp", "p_l", "p_r")


def low_source(tau: Tensor, m: Tensor) -> Tensor:
    """sum_a tau[b, a] conj M[s, a, p, c]: (s, t, j, i, b, p, c)."""
    return contract([tau, m.conj().renamed("s", "a", "p", "c")], ("s", "t", "j", "i", "b", "p", "c"))


def low_sink(tau: Tensor, m: Tensor) -> Tensor:
    """sum_b M[t, b, p, c] tau[b, a]: (s, t, j, i, p, c, a)."""
    return contract([m.renamed("t", "b", "p", "c"), tau], ("s", "t", "j", "i", "p", "c", "a"))


def _bumped(x: Tensor, e: str) -> Tensor:
    re = F.col("re") + (F.col(e) + F.col("p") + F.col("c")) % 3
    im = F.col("im") - (F.col(e) * F.col("p") + F.col("c")) % 2
    return Tensor(x.frame.withColumn("re", re).withColumn("im", im), x.axes, x.sizes)


def made_source_points(tau: Tensor, m: Tensor) -> Tensor:
    """A stand-in for a solved mode-to-point propagator: the low modes plus a local term."""
    return _bumped(low_source(tau, m), "b")


def made_sink_points(tau: Tensor, m: Tensor) -> Tensor:
    return _bumped(low_sink(tau, m), "a")


def made_both_points(vsp: Tensor, m: Tensor) -> Tensor:
    """(s, t, j, i, p, c, q, d): sink carried to points by the overlap."""
    return contract([vsp.renamed("s", "t", "j", "i", "b", "q", "d"), m.renamed("t", "b", "p", "c")], ("s", "t", "j", "i", "p", "c", "q", "d"))


#: Axes of propagators by their ends (sink, source): times, spins, then the ends.
ENDS = {"VV": (("b",), ("a",)), "VP": (("b",), ("p", "c")), "PV": (("p", "c"), ("a",)), "PP": (("p", "c"), ("q", "d"))}


def dagger(x: Tensor, ends: str) -> Tensor:
    """g5 S^dagger g5 of a propagator with ends (sink, source): times, spins and ends all change places, so a VP becomes a PV and the other way round."""
    sink, source = ENDS[ends]
    new_sink, new_source = ENDS[ends[::-1]]
    sgn = 1 - 2 * ((F.col("i") >= 2) != (F.col("j") >= 2)).cast("long")
    columns = [F.col("t").alias("s"), F.col("s").alias("t"), F.col("i").alias("j"), F.col("j").alias("i")]
    columns += [F.col(a).alias(b) for a, b in zip((*source, *sink), (*new_sink, *new_source), strict=True)]
    frame = x.frame.select(*x.batch, *columns, (F.col("re") * sgn).alias("re"), (-F.col("im") * sgn).alias("im"))
    sizes = {**x.sizes} | {b: x.sizes[a] for a, b in zip((*source, *sink), (*new_sink, *new_source), strict=True) if a in x.sizes}
    return Tensor(frame, (*x.batch, "s", "t", "j", "i", *new_sink, *new_source), sizes)


def dagger_source_points(vsp: Tensor) -> Tensor:
    """A sink-on-points propagator from a source-on-points one."""
    return dagger(vsp, "VP")


def high_mode_source(vsp: Tensor, tau: Tensor, m: Tensor) -> Tensor:
    """S[b, pc] - sum_a tau[b, a] conj M[a, pc]."""
    return add(vsp, low_source(tau, m).scaled(-1))


def high_mode_sink(psv: Tensor, tau: Tensor, m: Tensor) -> Tensor:
    """S[pc, a] - sum_b M[b, pc] tau[b, a]."""
    return add(psv, low_sink(tau, m).scaled(-1))


def high_mode_both(psp: Tensor, high_source: Tensor, psv: Tensor, m: Tensor) -> Tensor:
    """S[pc, qd] - sum_b M[b, pc] S~[b, qd] - sum_a S[pc, a] conj M[a, qd]."""
    axes = ("s", "t", "j", "i", "p", "c", "q", "d")
    sink = contract([m.renamed("t", "b", "p", "c"), high_source.renamed("s", "t", "j", "i", "b", "q", "d")], axes)
    source = contract([psv, m.conj().renamed("s", "a", "q", "d")], axes)
    return add(psp, sink.scaled(-1), source.scaled(-1))


def summed_high_mode_plan(vsp: Tensor, psv: Tensor, tau: Tensor, m: Tensor) -> Plan:
    """high_mode_both() summed over both points and both times, for a propagator whose sink the overlap carried to points.

    Axes j, i, c, d. Points are summed inside the plan, before anything is joined on
    them, so no pair of points is ever a row; terms that cancel are not made.
    """
    plan = Plan({"vsp": vsp, "psv": psv, "tau": tau, "m": m, "m*": m.conj()})
    out = ("j", "i", "c", "d")
    sink, source = ("m", ("t", "b", "p", "c")), ("m*", ("s", "a", "q", "d"))
    solved, low = ("vsp", ("s", "t", "j", "i", "b", "q", "d")), ("tau", ("s", "t", "j", "i", "b", "a"))
    plan.add([sink, solved], out)
    plan.add([sink, solved], out, -1)
    plan.add([sink, low, source], out)
    plan.add([("psv", ("s", "t", "j", "i", "p", "c", "a")), source], out, -1)
    return plan


# --- sampled points ----------------------------------------------------------------------------

#: A prime below 2**31: products of two residues stay below 2**62, and x -> x**5 is one-to-one, as 5 does not divide PRIME - 1.
PRIME = 2147483647
#: Factors of the three rounds.
MIXERS = (48271, 69621, 39373)


def mixed(site: Column, t: Column, seed: Column) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last, h, is a number below PRIME, different for each site of a slice."""
    out, last = [("h0", F.pmod(site + 1, F.lit(PRIME)))], "h0"
    for n, factor in enumerate(MIXERS):
        x, y = f"x{n}", f"y{n}"
        shift = F.pmod(F.pmod(seed, F.lit(PRIME)) * (n + 1) + F.pmod(t, F.lit(PRIME)) * factor + n, F.lit(PRIME))
        out += [(x, (F.col(last) * factor + shift) % PRIME), (y, F.col(x) * F.col(x) % PRIME), (f"z{n}", F.col(y) * F.col(y) % PRIME), (f"h{n + 1}", F.col(f"z{n}") * F.col(x) % PRIME)]
        last = f"h{n + 1}"
    return [*out, ("h", F.col(last))]


def sampled_points(seeds: DataFrame, latt_size: tuple[int, ...], num_points: int) -> DataFrame:
    """(labels of seeds, t, p, x, y, z): num_points different sites of each time slice, chosen by seed.

    seeds: (labels, seed LONG), a sample each. Sites are ranked by a counter-based
    mix of (seed, t, site) in integers, so every engine and every rerun chooses the
    same; p counts from 0. latt_size: (x, y, z, t).
    """
    if len(latt_size) != 4:
        raise ValueError("latt_size must have 4 elements")
    if num_points <= 0:
        raise ValueError(f"num_points must be positive, not {num_points}")
    lx, ly, lz, lt = latt_size
    if num_points > lx * ly * lz:
        raise ValueError(f"num_points of {num_points} exceeds spatial volume {lx * ly * lz}")
    labels = [c for c in seeds.columns if c != "seed"]
    rows = seeds.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(lt - 1)))).withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(lx * ly * lz - 1))))
    rows = rows.withColumn("t", F.col("t").cast("long")).withColumn("site", F.col("site").cast("long"))
    for name, column in mixed(F.col("site"), F.col("t"), F.col("seed")):
        rows = rows.withColumn(name, column)
    order = Window.partitionBy(*labels, "t").orderBy("h")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= num_points)
    x, y, z = F.col("site") % lx, F.floor(F.col("site") / lx) % ly, F.floor(F.col("site") / (lx * ly))
    return rows.select(*labels, "t", (F.col("n") - 1).cast("long").alias("p"), x.alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z"))


def sampled_points_sql(seeds: str, labels: str, latt_size: tuple[int, int, int, int], num_points: int) -> str:
    """The same for DuckDB; seeds is a relation (labels, seed)."""
    lx, ly, lz, lt = latt_size
    body = f"SELECT {labels}, seed, t.range AS t, s.range AS site, (s.range + 1) % {PRIME} AS h0 FROM {seeds}, range({lt}) t, range({lx * ly * lz}) s"
    for n, factor in enumerate(MIXERS):
        body = f"SELECT *, (h{n} * {factor} + (seed % {PRIME} * {n + 1} + t * {factor} + {n}) % {PRIME}) % {PRIME} AS x{n} FROM ({body})"
        body = f"SELECT *, (x{n} * x{n} % {PRIME}) * (x{n} * x{n} % {PRIME}) % {PRIME} * x{n} % {PRIME} AS h{n + 1} FROM ({body})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {labels}, t ORDER BY h{len(MIXERS)}) AS n FROM ({body})"
    return f"SELECT {labels}, t, n - 1 AS p, site % {lx} AS x, site // {lx} % {ly} AS y, site // {lx * ly} AS z FROM ({ranked}) WHERE n <= {num_points}"
