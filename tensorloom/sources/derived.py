"""Site and mode tensors derived from the plain tables.

Every row of the tables counts: entries are sums over all rows that share an
index, reduced to small integers, so that both engines agree to the last digit.
The extents are parameters of the derivation, not caps: more rows only change
the values. Both forms of each table are here, frame and DuckDB text.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.gamma import entries, gamma, sign, source_dagger
from tensorloom.plans.einsum import Tensor

#: Times and modes; other extents by the environment, before the import (bench.py takes 16 x 12 for the larger tables).
LT, NE = int(os.environ.get("TENSORLOOM_LT", "8")), int(os.environ.get("TENSORLOOM_NE", "6"))
NS, NC = 4, 2
#: Sites of a time slice: x, y, z; the vector index runs colour first, then x, y, z.
LX, LY, LZ = 4, 2, 2
NX = NC * LX * LY * LZ
NP = 12
MOMENTA = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1))
CELLS = LT * LT * NS * NS * NE * NE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict[tuple[str, str, str], Tensor | DataFrame] = {}


_STATES: dict[tuple[str, str], tuple] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Paths, sizes and times of a folder's files, two levels deep: what is held is made anew when they change."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(path, deep: int) -> list[tuple]:
        return [x for f in fs.listStatus(path) for x in ([(str(f.getPath()), f.getLen(), f.getModificationTime())] + (listed(f.getPath(), deep - 1) if f.isDirectory() and deep else []))]

    return tuple(sorted(listed(hadoop, 1)))


def _free(x: Tensor | DataFrame) -> None:
    try:
        (x.frame if isinstance(x, Tensor) else x).unpersist()
    except Exception as e:  # noqa: BLE001  the session may have ended
        if "stopped" not in str(e).lower() and "connection" not in str(e).lower():
            raise


def held(build: Callable) -> Callable:
    """A derived tensor is made once for a session and folder, and kept in memory or on local disk until release() or until the tables change."""

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        state = _state(spark, sf_dir)
        if _STATES.setdefault(key[:2], state) != state:  # the tables have changed
            _STATES[key[:2]] = state
            for old in [k for k in _HELD if k[:2] == key[:2]]:
                _free(_HELD.pop(old))
        if key not in _HELD:
            made = build(spark, sf_dir)
            frame = (made.frame if isinstance(made, Tensor) else made).persist(StorageLevel.MEMORY_AND_DISK)
            _HELD[key] = replace(made, frame=frame) if isinstance(made, Tensor) else frame
        return _HELD[key]

    return get


def kept(frame: DataFrame) -> DataFrame:
    """A frame that several others read: made once, kept in memory or on local disk until release(); what is lost is made again."""
    out = frame.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD[frame.sparkSession.sparkContext.applicationId, "", f"kept-{len(_HELD)}-{id(out)}"] = out
    return out


def release() -> None:
    """Frees all derived tensors, for example when the tables have changed."""
    for x in _HELD.values():
        _free(x)
    _HELD.clear()


def small(total: Column, n: int) -> Column:
    """An integer in [-(n // 2), n // 2] from any integer."""
    return (F.pmod(total, F.lit(n)) - n // 2).cast("long")


def small_sql(total: str, n: int) -> str:
    return f"CAST((({total}) % {n} + {n}) % {n} - {n // 2} AS BIGINT)"


# eigenvectors -------------------------------------------------------------------------------


@held
def eigenvectors(spark: SparkSession, sf_dir: str) -> Tensor:
    """V(t, e, x): e-th mode of time slice t at vector index x."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = F.transform(F.sequence(F.lit(0), F.lit(NX - 1)), lambda x: F.struct(x.alias("x"), F.get("embedding", 2 * x).alias("p"), F.get("embedding", 2 * x + 1).alias("q")))
    rows = base.select((F.col("vec_id") % LT).alias("t"), (F.floor(F.col("vec_id") / LT) % NE).cast("long").alias("e"), F.explode(both).alias("v"))

    def part(c: str) -> Column:
        return F.sum(F.round(F.col(f"v.{c}") * 64).cast("long"))

    frame = rows.groupBy("t", "e", F.col("v.x").cast("long").alias("x")).agg(small(part("p"), 7).alias("re"), small(part("q"), 7).alias("im"))
    return Tensor(frame, ("t", "e", "x"), {"t": LT, "e": NE, "x": NX})


V_SQL = f"""v AS (SELECT vec_id % {LT} AS t, (vec_id // {LT}) % {NE} AS e, x,
  {small_sql("sum(CAST(round(embedding[2 * x + 1] * 64) AS BIGINT))", 7)} AS re,
  {small_sql("sum(CAST(round(embedding[2 * x + 2] * 64) AS BIGINT))", 7)} AS im
  FROM embeddings, (SELECT CAST(range AS BIGINT) AS x FROM range({NX})) GROUP BY 1, 2, 3)"""


# perambulators ------------------------------------------------------------------------------


@held
def perambulators(spark: SparkSession, sf_dir: str) -> Tensor:
    """tau(s, t, j, i, b, a): from mode a, spin i at time s to mode b, spin j at absolute time t."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    n = F.pmod(F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.col("l_partkey") * 131 + F.col("l_suppkey") * 7919, F.lit(CELLS))
    cells = rows.groupBy(n.cast("long").alias("n")).agg(
        small(F.sum(F.floor("l_quantity").cast("long")), 11).alias("re"), small(F.sum(F.round(F.col("l_discount") * 100).cast("long")), 11).alias("im")
    )

    def digit(unit: int, size: int) -> Column:
        return (F.floor(F.col("n") / unit) % size).cast("long")

    e, s, t = NE * NE, NE * NE * NS, NE * NE * NS * NS
    start = digit(t * LT, LT)
    frame = cells.select(
        start.alias("s"), ((start + digit(t, LT)) % LT).alias("t"), digit(s, NS).alias("j"), digit(e, NS).alias("i"), digit(NE, NE).alias("b"), digit(1, NE).alias("a"), "re", "im"
    )
    return Tensor(frame, ("s", "t", "j", "i", "b", "a"), {"s": LT, "t": LT, "j": NS, "i": NS, "b": NE, "a": NE})


TAU_SQL = f"""tau_n AS (SELECT (l_orderkey * 8 + l_linenumber + l_partkey * 131 + l_suppkey * 7919) % {CELLS} AS n,
  {small_sql("sum(CAST(floor(l_quantity) AS BIGINT))", 11)} AS re, {small_sql("sum(CAST(round(l_discount * 100) AS BIGINT))", 11)} AS im
  FROM lineitem GROUP BY 1),
tau AS (SELECT n // {CELLS // LT} AS s, (n // {CELLS // LT} + n // {NE * NE * 16} % {LT}) % {LT} AS t, n // {NE * NE * 4} % 4 AS j,
  n // {NE * NE} % 4 AS i, n // {NE} % {NE} AS b, n % {NE} AS a, re, im FROM tau_n)"""

#: Signs of the diagonal matrix gamma(15).
G5 = (1, 1, -1, -1)


def backward(tau: Tensor) -> Tensor:
    """The propagator from t back to s, g5 tau^dagger g5: (s, t, i, j, a, b)."""
    odd = ((F.col("i") >= 2) != (F.col("j") >= 2)).cast("long")
    sgn = 1 - 2 * odd
    axes = (*tau.batch, "s", "t", "i", "j", "a", "b")
    frame = tau.frame.select(*axes, (F.col("re") * sgn).alias("re"), (-F.col("im") * sgn).alias("im"))
    return Tensor(frame, axes, tau.sizes)


BW_SQL = "bw AS (SELECT s, t, i, j, a, b, re * CASE WHEN (i >= 2) <> (j >= 2) THEN -1 ELSE 1 END AS re, -im * CASE WHEN (i >= 2) <> (j >= 2) THEN -1 ELSE 1 END AS im FROM tau)"


# elementals ---------------------------------------------------------------------------------


def shift_columns(x: Column) -> dict[int, Column]:
    """Vector index of the next site in each direction (0: the site itself), periodic."""
    c, px, py, pz = x % NC, F.floor(x / NC) % LX, F.floor(x / (NC * LX)) % LY, F.floor(x / (NC * LX * LY))

    def at(a: Column, b: Column, d: Column) -> Column:
        return (c + NC * (a + LX * (b + LY * d))).cast("long")

    return {0: x, 1: at((px + 1) % LX, py, pz), 2: at(px, (py + 1) % LY, pz), 3: at(px, py, (pz + 1) % LZ)}


@held
def elementals(spark: SparkSession, sf_dir: str) -> Tensor:
    """Phi(deriv, mom, t, b, c) = sum_x conj V(t, b, x) e^{2 pi i p x} V(t, c, x + deriv): phases of extents 4 and 2 are powers of i."""
    v = eigenvectors(spark, sf_dir).frame
    moved = shift_columns(F.col("x"))
    left = v.select("t", F.col("e").alias("b"), "x", F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("deriv"), moved[d].alias("to")) for d in moved])).alias("m"), "re", "im")
    left = left.select("t", "b", "x", "m.deriv", "m.to", "re", "im")
    right = v.select(F.col("t").alias("t2"), F.col("e").alias("c"), F.col("x").alias("x2"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = left.join(right, (F.col("t") == F.col("t2")) & (F.col("to") == F.col("x2")))
    both = both.groupBy("deriv", "t", "b", "c", "x").agg(
        F.sum(F.col("re") * F.col("re2") + F.col("im") * F.col("im2")).alias("re"), F.sum(F.col("re") * F.col("im2") - F.col("im") * F.col("re2")).alias("im")
    )
    x = F.col("x")
    px, py, pz = F.floor(x / NC) % LX, F.floor(x / (NC * LX)) % LY, F.floor(x / (NC * LX * LY))
    turns = F.array(*[F.struct(F.lit(m).cast("long").alias("mom"), ((p[0] * px + 2 * p[1] * py + 2 * p[2] * pz) % 4).alias("k")) for m, p in enumerate(MOMENTA)])
    every = both.select("deriv", "t", "b", "c", F.explode(turns).alias("q"), "re", "im")
    re = F.when(F.col("q.k") == 0, F.col("re")).when(F.col("q.k") == 1, -F.col("im")).when(F.col("q.k") == 2, -F.col("re")).otherwise(F.col("im"))
    im = F.when(F.col("q.k") == 0, F.col("im")).when(F.col("q.k") == 1, F.col("re")).when(F.col("q.k") == 2, -F.col("im")).otherwise(-F.col("re"))
    frame = every.groupBy("deriv", F.col("q.mom").alias("mom"), "t", "b", "c").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return Tensor(frame, ("deriv", "mom", "t", "b", "c"), {"deriv": 4, "mom": len(MOMENTA), "t": LT, "b": NE, "c": NE})


_P = f"(x // {NC}) % {LX}", f"(x // {NC * LX}) % {LY}", f"x // {NC * LX * LY}"


def _moved_sql(d: int) -> str:
    px, py, pz = _P
    a = [f"(({px}) + {int(d == 1)}) % {LX}", f"(({py}) + {int(d == 2)}) % {LY}", f"(({pz}) + {int(d == 3)}) % {LZ}"]
    return f"x % {NC} + {NC} * ({a[0]} + {LX} * ({a[1]} + {LY} * ({a[2]})))"


PHI_SQL = (
    "mv AS ("
    + " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS deriv, x, {_moved_sql(d)} AS too FROM (SELECT CAST(range AS BIGINT) AS x FROM range({NX}))" for d in range(4))
    + "),\nph AS ("
    + " UNION ALL ".join(f"SELECT CAST({m} AS BIGINT) AS mom, x, ({p[0]} * ({_P[0]}) + {2 * p[1]} * ({_P[1]}) + {2 * p[2]} * ({_P[2]})) % 4 AS k FROM (SELECT CAST(range AS BIGINT) AS x FROM range({NX}))" for m, p in enumerate(MOMENTA))
    + """),
phi AS (SELECT deriv, mom, t, b, c,
  CAST(sum(CASE k WHEN 0 THEN pr WHEN 1 THEN -pi WHEN 2 THEN -pr ELSE pi END) AS BIGINT) AS re,
  CAST(sum(CASE k WHEN 0 THEN pi WHEN 1 THEN pr WHEN 2 THEN -pi ELSE -pr END) AS BIGINT) AS im
  FROM (SELECT mv.deriv, ph.mom, ph.k, l.t, l.e AS b, r.e AS c, l.re * r.re + l.im * r.im AS pr, l.re * r.im - l.im * r.re AS pi
        FROM v l JOIN mv ON l.x = mv.x JOIN v r ON r.t = l.t AND r.x = mv.too JOIN ph ON ph.x = l.x) GROUP BY deriv, mom, t, b, c)"""
)


# literal tables -----------------------------------------------------------------------------

#: Operators as terms (op, gamma, coefficient, deriv, mom); members 5 and 13 of a family change sign.
OPERATORS: tuple[tuple[int, int, int, int, int], ...] = (
    (0, 15, 1, 0, 0),
    (1, 6, 1, 1, 0),
    (1, 5, sign(5), 2, 0),
    (1, 3, 1, 3, 0),
)


def gamma_rows(source: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(n, i, j, re, im) of all 16 matrices, or of their source daggers."""
    return [(n, *e) for n in range(16) for e in entries(source_dagger(gamma(n)) if source else gamma(n))]


def gammas(spark: SparkSession, source: bool = False) -> Tensor:
    frame = spark.createDataFrame(gamma_rows(source), "n long, i long, j long, re long, im long")
    return Tensor(frame, ("n", "i", "j"), {"n": 16, "i": 4, "j": 4}, rows=64, literal=True)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A literal CTE of integers and texts."""

    def one(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)

    body = ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows)
    casts = ", ".join(c if isinstance(rows[0][i], str) else f"CAST({c} AS {'DOUBLE' if isinstance(rows[0][i], float) else 'BIGINT'}) AS {c}" for i, c in enumerate(columns.split(", ")))
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) v({columns}))"


G_SQL = values_sql("g", "n, i, j, re, im", gamma_rows())
GS_SQL = values_sql("gs", "n, i, j, re, im", gamma_rows(True))
OP_SQL = values_sql("ops", "op, gamma, coeff, deriv, mom", list(OPERATORS))


def operator_terms(spark: SparkSession, rows=OPERATORS) -> DataFrame:
    return spark.createDataFrame(list(rows), "op long, gamma long, coeff long, deriv long, mom long")


# points -------------------------------------------------------------------------------------


@held
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, p, x, y, z): NP different sites of each time slice, those whose parts weigh least.

    A site's weight is the sum of the sizes of all parts that fall on it; sites
    without parts weigh 0; ties go by site.
    """
    sites = LX * LY * LZ
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    weight = part.groupBy((F.col("p_partkey") % LT).alias("t"), (F.floor(F.col("p_partkey") / LT) % sites).cast("long").alias("site")).agg(F.sum("p_size").alias("w"))
    every = spark.range(LT * sites).select((F.col("id") % LT).alias("t"), F.floor(F.col("id") / LT).cast("long").alias("site"))
    from pyspark.sql.window import Window

    order = Window.partitionBy("t").orderBy(F.coalesce("w", F.lit(0)), "site")
    ranked = every.join(weight, ["t", "site"], "left").withColumn("p", F.row_number().over(order).cast("long") - 1).where(F.col("p") < NP)
    return ranked.select("t", "p", (F.col("site") % LX).alias("x"), (F.floor(F.col("site") / LX) % LY).cast("long").alias("y"), F.floor(F.col("site") / (LX * LY)).cast("long").alias("z"))


POINTS_SQL = f"""pw AS (SELECT p_partkey % {LT} AS t, (p_partkey // {LT}) % {LX * LY * LZ} AS site, sum(p_size) AS w FROM part GROUP BY 1, 2),
pts AS (SELECT t, n - 1 AS p, site % {LX} AS x, (site // {LX}) % {LY} AS y, site // {LX * LY} AS z
  FROM (SELECT s.t, s.site, row_number() OVER (PARTITION BY s.t ORDER BY coalesce(w, 0), s.site) AS n
        FROM (SELECT range % {LT} AS t, range // {LT} AS site FROM range({LT * LX * LY * LZ})) s LEFT JOIN pw USING (t, site)) WHERE n <= {NP})"""
