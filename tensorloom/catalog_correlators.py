"""Queries A1-A27 and F1-F8: correlators on the derived tensors, with DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.momenta import shell
from tensorloom.operators import correlators as C
from tensorloom.operators import points as P
from tensorloom.plans.einsum import Tensor, add, contract, flat_sql, pair
from tensorloom.sources import derived as D

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


class Base:
    """The derived tensors of one call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    def tau(self) -> Tensor:
        return D.perambulators(self.spark, self.sf)

    def phi(self) -> Tensor:
        return D.elementals(self.spark, self.sf)

    def elem(self) -> Tensor:
        return C.operator_elementals(D.operator_terms(self.spark), self.phi())

    def v(self, elem: Tensor | None = None) -> Tensor:
        return C.vertex(elem or self.elem(), D.gammas(self.spark))

    def w(self, elem: Tensor | None = None) -> Tensor:
        return C.source_vertex(elem or self.elem(), D.gammas(self.spark, True))


#: CTEs of the derived tensors; a literal spin structure keeps the flat joins small.
ELEM = "elem AS (SELECT ops.op, ops.gamma, p.t, p.b, p.c, CAST(sum(coeff * p.re) AS BIGINT) AS re, CAST(sum(coeff * p.im) AS BIGINT) AS im FROM ops JOIN phi p ON p.deriv = ops.deriv AND p.mom = ops.mom GROUP BY ALL)"
VERT = "vt AS (SELECT e.op, e.t, g.i AS j, g.j AS k, e.b, e.c, CAST(sum(e.re * g.re - e.im * g.im) AS BIGINT) AS re, CAST(sum(e.re * g.im + e.im * g.re) AS BIGINT) AS im FROM elem e JOIN g ON g.n = e.gamma GROUP BY ALL)"
SRCV = "wt AS (SELECT e.op, e.t AS s, g.i AS l, g.j AS i, e.c AS d, e.b AS a, CAST(sum(e.re * g.re + e.im * g.im) AS BIGINT) AS re, CAST(sum(e.re * g.im - e.im * g.re) AS BIGINT) AS im FROM elem e JOIN gs g ON g.n = e.gamma GROUP BY ALL)"
BASE = "WITH " + ",\n".join([D.V_SQL, D.TAU_SQL, D.BW_SQL, D.PHI_SQL, D.G_SQL, D.GS_SQL, D.OP_SQL, ELEM, VERT, SRCV])
BWO = ("bw", C.BW, C.BW, False)
TAUO = ("tau", ("s", "t", "j", "i", "b", "a"), C.TAU, False)
VO = ("vt", ("op", "t", "j", "k", "b", "c"), C.SINK, False)
WO = ("wt", ("op", "s", "l", "i", "d", "a"), C.SOURCE, False)
#: Two halves summed on their own: what the planner finds, written by hand so that the oracle ends in time.
HALF1 = "h1 AS (" + flat_sql([("bw", C.BW, C.BW, False), ("vt", ("op", "t", "j", "k", "b", "c"), C.SINK, False)], ("s", "t", "i", "a", "k", "c", "op_snk")) + ")"
HALF2 = "h2 AS (" + flat_sql([("tau", ("s", "t", "j", "i", "b", "a"), C.TAU, False), ("wt", ("op", "s", "l", "i", "d", "a"), C.SOURCE, False)], ("s", "t", "k", "c", "i", "a", "op_src")) + ")"
H1O = ("h1", ("s", "t", "i", "a", "k", "c", "op_snk"), ("s", "t", "i", "a", "k", "c", "op_snk"), False)
H2O = ("h2", ("s", "t", "k", "c", "i", "a", "op_src"), ("s", "t", "k", "c", "i", "a", "op_src"), False)
PAIRS = f"{BASE},\n{HALF1},\n{HALF2},\ntp AS ({flat_sql([H1O, H2O], ('op_snk', 'op_src', 's', 't'), minus=True)})"
REL = f"{PAIRS},\nrel AS (SELECT op_snk, op_src, (t - s + {D.LT}) % {D.LT} AS dt, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM tp GROUP BY ALL)"


@query("f1_mode_prefix", f"WITH {D.V_SQL},\n{D.PHI_SQL}\nSELECT deriv, mom, t, b, c, re, im FROM phi WHERE b < 3 AND c < 3")
def f1(spark, sf):
    """The first 3 modes at both ends."""
    return D.elementals(spark, sf).where("b < 3 AND c < 3").frame


@query("f3_time_slices", f"WITH {D.V_SQL}\nSELECT t, e, x, re, im FROM v WHERE t IN (1, 4, 6)")
def f3(spark, sf):
    return D.eigenvectors(spark, sf).where("t IN (1, 4, 6)").frame


@query("f4_relative_time", f"WITH {D.TAU_SQL}\nSELECT (t - s + {D.LT}) % {D.LT} AS dt, count(*) AS n, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM tau GROUP BY 1")
def f4(spark, sf):
    tau = D.perambulators(spark, sf).frame
    return tau.groupBy(F.pmod(F.col("t") - F.col("s"), F.lit(D.LT)).alias("dt")).agg(F.count(F.lit(1)).alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im"))


@query("a1_backward_propagator", f"WITH {D.TAU_SQL},\n{D.BW_SQL}\nSELECT s, t, i, j, a, b, re, im FROM bw")
def a1(spark, sf):
    return D.backward(D.perambulators(spark, sf)).frame


@query(
    "a2_backward_dense",
    f"WITH {D.TAU_SQL},\n{D.G_SQL}\n" + flat_sql([("g", ("n", "i", "j"), ("15", "i", "k"), False), ("tau", ("s", "t", "j", "i", "b", "a"), ("s", "t", "l", "k", "b", "a"), True), ("g", ("n", "i", "j"), ("15", "l", "j"), False)], ("s", "t", "i", "j", "a", "b")),
)
def a2(spark, sf):
    """The same with full spin matrices on both sides."""
    g = D.gammas(spark).where("n = 15")
    g = Tensor(g.frame.drop("n"), ("i", "j"), {"i": 4, "j": 4}, 4, True)
    return contract([g.renamed("i", "k"), D.perambulators(spark, sf).conj().renamed("s", "t", "l", "k", "b", "a"), g.renamed("l", "j")], ("s", "t", "i", "j", "a", "b")).frame


@query("a3_source_gamma", f"WITH {D.GS_SQL}\nSELECT n, i, j, re, im FROM gs")
def a3(spark, sf):
    g, h = D.gammas(spark), D.gammas(spark).where("n = 8")
    h = Tensor(h.frame.drop("n"), ("i", "j"), {"i": 4, "j": 4}, 4, True)
    return contract([h.renamed("i", "j"), g.conj().renamed("n", "k", "j"), h.renamed("k", "l")], ("n", "i", "l")).frame.withColumnRenamed("l", "j")


@query("a4_twopoint", f"{REL}\nSELECT dt, re, im FROM rel WHERE op_snk = 0 AND op_src = 0")
def a4(spark, sf):
    """The pion two-point function, summed over all sources."""
    b = Base(spark, sf)
    elem = b.elem().where("op = 0")
    c = C.twopoint(b.tau(), b.v(elem), b.w(elem))  # dense blocks, one einsum a pair of times
    return C.relative(c, D.LT, ()).select("dt", "re", "im")


@query("a4_twopoint_joins", f"{REL}\nSELECT dt, re, im FROM rel WHERE op_snk = 0 AND op_src = 0")
def a4_joins(spark, sf):
    """The same by joins and sums of single entries, for blocks that are too large or too sparse."""
    b = Base(spark, sf)
    elem = b.elem().where("op = 0")
    c = C.twopoint(b.tau(), b.v(elem), b.w(elem), blocks=False)
    return C.relative(c, D.LT, ()).select("dt", "re", "im")


def _profile_sql(out: str, extra: str) -> str:
    q = flat_sql([("h1", ("s", "t", "i", "a", "k", "c", "op_snk"), ("s", "t", "i", "a", "k", "c", "op_snk"), False), ("tw", ("s", "t", "k", "c", "i", "d", "a", "op_src"), ("s", "t", "k", "c", "i", "d", "a", "op_src"), False)], ("op_snk", "op_src", "s", "t", "a", "d"), minus=True)
    tw = "tw AS (" + flat_sql([("tau", ("s", "t", "j", "i", "b", "a"), C.TAU, False), ("wt", ("op", "s", "l", "i", "d", "a"), C.SOURCE, False)], ("s", "t", "k", "c", "i", "d", "a", "op_src")) + ")"
    return f"{BASE},\n{HALF1},\n{tw},\npf AS ({q})\nSELECT op_snk, op_src, {out}, (t - s + {D.LT}) % {D.LT} AS dt, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM pf{extra} GROUP BY ALL"


@query("a5_twopoint_profile", _profile_sql("a, d", ""))
def a5(spark, sf):
    """Two-point functions resolved by the two source modes."""
    b = Base(spark, sf)
    c = C.twopoint(b.tau(), b.v(), b.w(), ("op_snk", "op_src", "a", "d"), blocks=False)
    return C.relative(c, D.LT, ("op_snk", "op_src", "a", "d"))


@query("a6_twopoint_diagonal", _profile_sql("a", " WHERE a = d"))
def a6(spark, sf):
    """The part diagonal in the source modes."""
    b = Base(spark, sf)
    c = C.twopoint(b.tau(), b.v(), b.w().where("a = d"), ("op_snk", "op_src", "a"), blocks=False)
    return C.relative(c, D.LT, ("op_snk", "op_src", "a"))


@query("a7_twopoint_matrix", f"{REL}\nSELECT op_snk, op_src, dt, re, im FROM rel")
def a7(spark, sf):
    b = Base(spark, sf)
    elem = b.elem()
    return C.relative(C.twopoint(b.tau(), b.v(elem), b.w(elem)), D.LT, ("op_snk", "op_src"))


LOOP = f"lp AS ({flat_sql([('tau', ('s', 't', 'j', 'i', 'b', 'a'), ('t', 't', 'k', 'j', 'c', 'b'), False), ('vt', ('op', 't', 'j', 'k', 'b', 'c'), ('op', 't', 'j', 'k', 'b', 'c'), False)], ('op', 't'))})"
ISO = f"""{REL},\n{LOOP},
dc AS (SELECT x.op AS op_snk, y.op AS op_src, (x.t - y.t + {D.LT}) % {D.LT} AS dt, 2 * CAST(sum(x.re * y.re + x.im * y.im) AS BIGINT) AS re, 2 * CAST(sum(x.im * y.re - x.re * y.im) AS BIGINT) AS im FROM lp x, lp y GROUP BY ALL)
SELECT op_snk, op_src, dt, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM (SELECT * FROM rel UNION ALL SELECT * FROM dc) GROUP BY ALL"""


def _isoscalar(spark, sf, only: int | None) -> DataFrame:
    b = Base(spark, sf)
    elem = b.elem() if only is None else b.elem().where(f"op = {only}")
    v, w = b.v(elem), b.w(elem)
    connected = C.relative(C.twopoint(b.tau(), v, w), D.LT, ("op_snk", "op_src"))
    loop = C.loops(b.tau(), v)
    return C.isoscalar(connected, loop, loop, D.LT, 2)


@query("a8_isoscalar", f"SELECT dt, re, im FROM ({ISO}) WHERE op_snk = 0 AND op_src = 0")
def a8(spark, sf):
    return _isoscalar(spark, sf, 0).select("dt", "re", "im")


@query("a9_isoscalar_matrix", ISO)
def a9(spark, sf):
    return _isoscalar(spark, sf, None)


#: One operator a momentum, for the momentum-resolved matrix: op = 2 * mom + kind.
MOM_OPS = tuple((2 * m + o, g, c, d, m) for m in range(len(D.MOMENTA)) for o, g, c, d in ((0, 15, 1, 0), (1, 8, 1, 1)))


@query("a10_twopoint_momenta", REL.replace(D.OP_SQL, D.values_sql("ops", "op, gamma, coeff, deriv, mom", list(MOM_OPS))) + "\nSELECT op_snk // 2 AS mom, op_snk % 2 AS op_snk, op_src % 2 AS op_src, dt, re, im FROM rel WHERE op_snk // 2 = op_src // 2")
def a10(spark, sf):
    """A matrix of operators for each momentum; pairs of different momenta are never formed."""
    b = Base(spark, sf)
    elem = C.operator_elementals(D.operator_terms(spark, MOM_OPS), b.phi())
    v, w = b.v(elem), b.w(elem)

    def split(t: Tensor) -> Tensor:
        frame = t.frame.withColumn("mom", F.floor(F.col("op") / 2).cast("long")).withColumn("op", F.col("op") % 2)
        return Tensor(frame, ("mom", *t.axes), {**t.sizes, "mom": len(D.MOMENTA), "op": 2}, t.rows)

    v, w = split(v), split(w)
    terms = [D.backward(b.tau()), v.renamed("mom", *[x if x != "op" else "op_snk" for x in v.axes[1:]]), b.tau().renamed("s", "t", "k", "l", "c", "d"), w.renamed("mom", *[x if x != "op" else "op_src" for x in w.axes[1:]])]
    return C.relative(contract(terms, ("mom", "op_snk", "op_src", "s", "t")).scaled(-1), D.LT, ("mom", "op_snk", "op_src"))


def _cube(n: int) -> str:
    return f"(SELECT x.v AS px, y.v AS py, z.v AS pz FROM (SELECT range - {n} AS v FROM range({2 * n + 1})) x, (SELECT range - {n} AS v FROM range({2 * n + 1})) y, (SELECT range - {n} AS v FROM range({2 * n + 1})) z)"


@query("a11_shell_operator", f"SELECT CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, CAST(pz AS BIGINT) AS pz, px * px + py * py + pz * pz AS n, round(1 / sqrt(count(*) OVER (PARTITION BY px * px + py * py + pz * pz)), 6) AS coeff FROM {_cube(3)}")
def a11(spark, sf):
    """Every momentum of [-3, 3]^3 with its shell and the shell's weight 1 / sqrt(number)."""
    from pyspark.sql.window import Window

    every = spark.range(343).select(*[(F.floor(F.col("id") / 7**i) % 7 - 3).cast("long").alias(c) for i, c in enumerate(("px", "py", "pz"))])
    every = every.withColumn("n", F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2).withColumn("n", F.col("n").cast("long"))
    return every.withColumn("coeff", F.round(1 / F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("n"))), 6))


@query("a12_operator_elementals", f"WITH {D.V_SQL},\n{D.PHI_SQL},\n{D.OP_SQL},\n{ELEM}\nSELECT op, gamma, t, b, c, re, im FROM elem")
def a12(spark, sf):
    return Base(spark, sf).elem().frame


RECOMB = ((0, 0, 1, 0), (0, 3, 2, 0), (1, 1, 0, 1), (2, 2, -1, 3), (2, 0, 1, 0))


@query(
    "a13_recombine",
    f"WITH {D.V_SQL},\n{D.PHI_SQL},\n{D.values_sql('m', 'made, deriv, re, im', list(RECOMB))}\n" + flat_sql([("m", ("made", "deriv"), ("made", "deriv"), False), ("phi", ("deriv", "mom", "t", "b", "c"), ("deriv", "mom", "t", "b", "c"), False)], ("made", "mom", "t", "b", "c")),
)
def a13(spark, sf):
    """A sparse linear map on one axis; Catalyst picks the join."""
    m = Tensor(spark.createDataFrame(list(RECOMB), "made long, deriv long, re long, im long"), ("made", "deriv"), {"made": 3, "deriv": 4}, 5, True)
    return contract([m, D.elementals(spark, sf)], ("made", "mom", "t", "b", "c")).frame


@query("a14_meson_vertex", f"{BASE}\nSELECT op, t, j, k, b, c, re, im FROM vt")
def a14(spark, sf):
    return Base(spark, sf).v().frame


@query("a14_meson_vertex_dagger", f"{BASE}\nSELECT op, s, l, i, d, a, re, im FROM wt")
def a14_dagger(spark, sf):
    return Base(spark, sf).w().frame


@query("a16_propagator_both_ways", f"WITH {D.TAU_SQL},\n{D.BW_SQL}\nSELECT s AS t_from, t AS t_to, j, i, b, a, re, im, 0 AS back FROM tau UNION ALL SELECT t, s, i, j, a, b, re, im, 1 FROM bw")
def a16(spark, sf):
    """Every stored propagator and its daggered partner, by absolute times: from t_from to t_to, one scan each."""
    tau = D.perambulators(spark, sf)
    ahead = tau.frame.select(F.col("s").alias("t_from"), F.col("t").alias("t_to"), "j", "i", "b", "a", "re", "im", F.lit(0).alias("back"))
    back = D.backward(tau).frame.select(F.col("t").alias("t_from"), F.col("s").alias("t_to"), F.col("i").alias("j"), F.col("j").alias("i"), F.col("a").alias("b"), F.col("b").alias("a"), "re", "im", F.lit(1).alias("back"))
    return ahead.unionByName(back)


@query("a17_local_propagator", f"WITH {D.TAU_SQL}\nSELECT t, j, i, b, a, re, im FROM tau WHERE s = t")
def a17(spark, sf):
    return D.perambulators(spark, sf).where("s = t").frame.drop("s")


AVG = "SELECT op_snk, op_src, dt, re / 8.0 AS re, im / 8.0 AS im FROM rel"


@query("a24_source_average", f"{REL}\n{AVG}")
def a24(spark, sf):
    b = Base(spark, sf)
    elem = b.elem()
    return C.source_average(C.twopoint(b.tau(), b.v(elem), b.w(elem)), D.LT, ("op_snk", "op_src"))


#: A two-point series with the right shape for masses: per source, the size of the orders' prices folded onto dt.
SERIES = f"sr AS (SELECT o_custkey % 3 AS op, (o_orderkey // 4) % {D.LT} AS dt, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS re FROM orders GROUP BY ALL)"


def _series(spark, sf) -> DataFrame:
    o = D.table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 3).alias("op"), (F.floor(F.col("o_orderkey") / 4) % D.LT).cast("long").alias("dt")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("re"))


@query(
    "a25_effective_mass",
    f"WITH {SERIES}\nSELECT c.op, c.dt, CASE WHEN c.re <> 0 AND (u.re + d.re) / (2.0 * c.re) >= 1 THEN round(acosh((u.re + d.re) / (2.0 * c.re)), 6) END AS mass FROM sr c JOIN sr u ON u.op = c.op AND u.dt = (c.dt + 1) % {D.LT} JOIN sr d ON d.op = c.op AND d.dt = (c.dt + {D.LT - 1}) % {D.LT}",
)
def a25(spark, sf):
    return C.effective_mass(_series(spark, sf), D.LT).withColumn("mass", F.round("mass", 6))


@query(
    "a25_open_ratio",
    f"WITH {SERIES},\nn AS (SELECT op, dt, re, lead(re) OVER (PARTITION BY op ORDER BY dt) AS nx FROM sr)\nSELECT op, dt, CASE WHEN nx <> 0 AND re / nx > 0 THEN round(ln(CAST(re AS DOUBLE) / nx), 6) END AS mass FROM n",
)
def a25_open(spark, sf):
    return C.open_ratio(_series(spark, sf)).withColumn("mass", F.round("mass", 6))


CFG = f"cf AS (SELECT o_custkey % 16 AS cfg, (o_orderkey // 4) % {D.LT} AS dt, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


def _by_cfg(spark, sf) -> DataFrame:
    o = D.table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 16).alias("cfg"), (F.floor(F.col("o_orderkey") / 4) % D.LT).cast("long").alias("dt")).agg(F.avg("o_totalprice").alias("value"))


@query("a26_ensemble_mean", f"WITH {CFG}\nSELECT dt, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value) / sqrt(count(*)), 4) AS error FROM cf GROUP BY dt")
def a26(spark, sf):
    return C.ensemble(_by_cfg(spark, sf), "dt").withColumn("mean", F.round("mean", 4)).withColumn("error", F.round("error", 4))


@query("a26_ensemble_covariance", f"WITH {CFG}\nSELECT a.dt, b.dt AS other, round(covar_samp(a.value, b.value), 2) AS cov FROM cf a JOIN cf b USING (cfg) GROUP BY ALL")
def a26_cov(spark, sf):
    return C.ensemble_covariance(_by_cfg(spark, sf), "dt").withColumn("cov", F.round("cov", 2))


OVER = f"ov AS (SELECT v.t, v.e, pts.p, v.x % {D.NC} AS c, v.re, v.im FROM v JOIN pts ON pts.t = v.t AND pts.x + {D.LX} * (pts.y + {D.LY} * pts.z) = v.x // {D.NC})"


@query("a27_overlap", f"WITH {D.V_SQL},\n{D.POINTS_SQL},\n{OVER}\nSELECT t, e, p, c, re, im FROM ov")
def a27(spark, sf):
    return C.overlap(D.eigenvectors(spark, sf), D.points(spark, sf), D.LX, D.LY, D.NC).frame


@query("n15_sparse_points", f"WITH {D.POINTS_SQL}\nSELECT t, p, x, y, z FROM pts")
def n15_points(spark, sf):
    return D.points(spark, sf)


@query(
    "f8_point_matches",
    f"WITH {D.POINTS_SQL},\n{D.values_sql('dsp', 'disp, dx, dy, dz', list(P.DISPLACEMENTS))}\nSELECT l.t, disp, l.p AS p_l, r.p AS p_r FROM pts l, dsp, pts r WHERE r.t = l.t AND r.x = (l.x + dx + {D.LX}) % {D.LX} AND r.y = (l.y + dy + {D.LY}) % {D.LY} AND r.z = (l.z + dz + {D.LZ}) % {D.LZ}",
)
def f8(spark, sf):
    return P.matches(D.points(spark, sf), P.displacements(spark), (D.LX, D.LY, D.LZ))


# point sector -------------------------------------------------------------------------------

#: Propagators that end on points, made of tau and overlaps plus a local term, so that projection has something to remove.
POINT = f"""vp AS ({flat_sql([('tau', ('s', 't', 'j', 'i', 'b', 'a'), ('s', 't', 'j', 'i', 'b', 'a'), False), ('ov', ('t', 'e', 'p', 'c'), ('s', 'a', 'p', 'c'), True)], ('s', 't', 'j', 'i', 'b', 'p', 'c'))}),
vs AS (SELECT s, t, j, i, b, p, c, re + (b + p + c) % 3 AS re, im - (b * p + c) % 2 AS im FROM vp),
pv AS ({flat_sql([('ov', ('t', 'e', 'p', 'c'), ('t', 'b', 'p', 'c'), False), ('tau', ('s', 't', 'j', 'i', 'b', 'a'), ('s', 't', 'j', 'i', 'b', 'a'), False)], ('s', 't', 'j', 'i', 'p', 'c', 'a'))}),
ps AS (SELECT s, t, j, i, p, c, a, re + (a + p + c) % 3 AS re, im - (a * p + c) % 2 AS im FROM pv)"""
PBASE = f"WITH {D.V_SQL},\n{D.TAU_SQL},\n{D.POINTS_SQL},\n{OVER},\n{POINT}"
HV = f"""hv AS (SELECT s, t, j, i, b, p, c, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM (
  SELECT s, t, j, i, b, p, c, re, im FROM vs UNION ALL
  {flat_sql([('tau', ('s', 't', 'j', 'i', 'b', 'a'), ('s', 't', 'j', 'i', 'b', 'a'), False), ('ov', ('t', 'e', 'p', 'c'), ('s', 'a', 'p', 'c'), True)], ('s', 't', 'j', 'i', 'b', 'p', 'c'), minus=True)}) GROUP BY ALL)"""
HP = f"""hp AS (SELECT s, t, j, i, p, c, a, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM (
  SELECT s, t, j, i, p, c, a, re, im FROM ps UNION ALL
  {flat_sql([('ov', ('t', 'e', 'p', 'c'), ('t', 'b', 'p', 'c'), False), ('tau', ('s', 't', 'j', 'i', 'b', 'a'), ('s', 't', 'j', 'i', 'b', 'a'), False)], ('s', 't', 'j', 'i', 'p', 'c', 'a'), minus=True)}) GROUP BY ALL)"""


class Points(Base):
    def ov(self) -> Tensor:
        return C.overlap(D.eigenvectors(self.spark, self.sf), D.points(self.spark, self.sf), D.LX, D.LY, D.NC)

    def vsp(self) -> Tensor:
        return P.made_source_points(self.tau(), self.ov())

    def psv(self) -> Tensor:
        return P.made_sink_points(self.tau(), self.ov())


@query("a18_point_dagger", f"{PBASE}\nSELECT t AS s, s AS t, i AS j, j AS i, p, c, b AS a, re * CASE WHEN (i >= 2) <> (j >= 2) THEN -1 ELSE 1 END AS re, -im * CASE WHEN (i >= 2) <> (j >= 2) THEN -1 ELSE 1 END AS im FROM vs")
def a18(spark, sf):
    """A sink-on-points propagator from the daggered source-on-points one, transposed in all its axes."""
    return P.dagger_source_points(Points(spark, sf).vsp()).frame


_FLIP = "CASE WHEN (i >= 2) <> (j >= 2) THEN -1 ELSE 1 END"


@query("a18_sink_dagger", f"{PBASE}\nSELECT t AS s, s AS t, i AS j, j AS i, a AS b, p, c, re * {_FLIP} AS re, -im * {_FLIP} AS im FROM ps")
def a18_sink(spark, sf):
    """A source-on-points propagator from the daggered sink-on-points one."""
    return P.dagger(Points(spark, sf).psv(), "PV").frame


@query("a18_both_dagger", f"{PBASE},\n" + "pp AS (SELECT h.s, h.t, h.j, h.i, o.p, o.c, h.p AS q, h.c AS d, CAST(sum(o.re * h.re - o.im * h.im) AS BIGINT) AS re, CAST(sum(o.re * h.im + o.im * h.re) AS BIGINT) AS im FROM vs h JOIN ov o ON o.t = h.t AND o.e = h.b WHERE h.s = 1 GROUP BY ALL)\n" + f"SELECT t AS s, s AS t, i AS j, j AS i, q AS p, d AS c, p AS q, c AS d, re * {_FLIP} AS re, -im * {_FLIP} AS im FROM pp")
def a18_both(spark, sf):
    """Both ends on points: the pairs of points change places; from one source time."""
    q = Points(spark, sf)
    vsp = q.vsp()
    return P.dagger(P.made_both_points(Tensor(vsp.frame.where("s = 1"), vsp.axes, vsp.sizes), q.ov()), "PP").frame


@query("a19_high_mode_source", f"{PBASE},\n{HV}\nSELECT s, t, j, i, b, p, c, re, im FROM hv")
def a19(spark, sf):
    q = Points(spark, sf)
    return P.high_mode_source(q.vsp(), q.tau(), q.ov()).frame


@query("a20_high_mode_sink", f"{PBASE},\n{HP}\nSELECT s, t, j, i, p, c, a, re, im FROM hp")
def a20(spark, sf):
    q = Points(spark, sf)
    return P.high_mode_sink(q.psv(), q.tau(), q.ov()).frame


PSP = """pp AS (SELECT s, t, j, i, p, c, q, d, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM (
  SELECT h.s, h.t, h.j, h.i, o.p, o.c, h.p AS q, h.c AS d, o.re * h.re - o.im * h.im AS re, o.re * h.im + o.im * h.re AS im
  FROM vs h JOIN ov o ON o.t = h.t AND o.e = h.b) GROUP BY ALL)"""
PSP_HIGH = f"""SELECT j, i, c, d, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM (
  SELECT * FROM pp
  UNION ALL SELECT h.s, h.t, h.j, h.i, o.p, o.c, h.p, h.c, -(o.re * h.re - o.im * h.im), -(o.re * h.im + o.im * h.re) FROM hv h JOIN ov o ON o.t = h.t AND o.e = h.b
  UNION ALL SELECT h.s, h.t, h.j, h.i, h.p, h.c, o.p, o.c, -(h.re * o.re + h.im * o.im), -(h.im * o.re - h.re * o.im) FROM ps h JOIN ov o ON o.t = h.s AND o.e = h.a) GROUP BY ALL"""


@query("a21_high_mode_both", f"{PBASE},\n{HV},\n{PSP}\n{PSP_HIGH}")
def a21(spark, sf):
    """Projected at both ends, then summed over points and times (by spin and colour)."""
    q = Points(spark, sf)
    return P.summed_high_mode_plan(q.vsp(), q.psv(), q.tau(), q.ov()).total(("j", "i", "c", "d"))


@query(
    "a15_current_v2p",
    f"WITH {D.V_SQL},\n{D.POINTS_SQL},\n{OVER},\n{D.G_SQL},\n{D.OP_SQL}\n"
    + "SELECT ops.op, ov.t, g.i, g.j, ov.e, ov.p, ov.c, CAST(sum(coeff * (g.re * ov.re + g.im * ov.im)) AS BIGINT) AS re, CAST(sum(coeff * (g.im * ov.re - g.re * ov.im)) AS BIGINT) AS im FROM ops JOIN g ON g.n = ops.gamma, ov WHERE deriv = 0 GROUP BY ALL",
)
def a15(spark, sf):
    """A local current between a mode and a point: gamma times the conjugated overlap."""
    q = Points(spark, sf)
    local = D.operator_terms(spark).where("deriv = 0").select("op", F.col("gamma").alias("n"), F.col("coeff").alias("re"), F.lit(0).cast("long").alias("im"))
    terms = Tensor(local, ("op", "n"), {"op": 4, "n": 16}, 1, True)
    return contract([terms, D.gammas(spark), q.ov().conj()], ("op", "i", "j", "t", "e", "p", "c")).frame


@query("a15_current_p2p_identity", f"WITH {D.POINTS_SQL}\nSELECT t, p AS p_l, p AS p_r, c.range AS c_l, c.range AS c_r, 1 AS re, 0 AS im FROM pts, range({D.NC}) c")
def a15_identity(spark, sf):
    """The identity on points and colours as generated rows."""
    c = spark.range(D.NC).select(F.col("id").alias("c_l"))
    pts = D.points(spark, sf)
    return pts.join(F.broadcast(c)).select("t", F.col("p").alias("p_l"), F.col("p").alias("p_r"), "c_l", F.col("c_l").alias("c_r"), F.lit(1).alias("re"), F.lit(0).alias("im"))


W2 = 16 * 15 / (12 * 11)
W1 = 16 / 12


def _both_sql(x: str) -> str:
    return f"round(CAST({W1} AS DOUBLE) * CAST(sum(CASE WHEN l.p = r.p THEN {x} ELSE 0 END) AS BIGINT) + CAST({W2} AS DOUBLE) * CAST(sum(CASE WHEN l.p = r.p THEN 0 ELSE {x} END) AS BIGINT), 4)"


@query(
    "s6_point_estimator",
    f"WITH {D.V_SQL},\n{D.POINTS_SQL},\n{OVER}\nSELECT l.t, {_both_sql('(l.re * r.re + l.im * r.im)')} AS re, {_both_sql('(l.re * r.im - l.im * r.re)')} AS im FROM ov l JOIN ov r ON l.t = r.t AND l.c = r.c AND l.e = r.e GROUP BY l.t",
)
def s6(spark, sf):
    """Two sampled points, each row weighted by how many different points it has: one pass, exact sums for each number."""
    ov = Points(spark, sf).ov().frame
    r = ov.select("t", "e", "c", F.col("p").alias("q"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = ov.join(r, ["t", "e", "c"])
    same = F.col("p") == F.col("q")

    def weighted(x):
        return F.round(F.lit(W1) * F.sum(F.when(same, x).otherwise(0)) + F.lit(W2) * F.sum(F.when(~same, x).otherwise(0)), 4)

    re = F.col("re") * F.col("re2") + F.col("im") * F.col("im2")
    im = F.col("re") * F.col("im2") - F.col("im") * F.col("re2")
    return both.groupBy("t").agg(weighted(re).alias("re"), weighted(im).alias("im"))


_ = (add, pair, shell)
