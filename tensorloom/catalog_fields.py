"""Queries over site fields: stencils, transport, currents, projections onto modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.links import conjugate
from tensorloom.operators import correlators as C
from tensorloom.operators import fields as X
from tensorloom.operators import modes as M
from tensorloom.plans.einsum import Tensor, contract, flat_sql
from tensorloom.sources import derived as D
from tensorloom.sources.staging import cut

Q: dict = {}
SQL: dict[str, str] = {}
EXT = (D.LX, D.LY, D.LZ)
LINKS = D.LT * 16 * 3 * D.NC * D.NC


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@D.held
def gauge(spark: SparkSession, sf: str) -> DataFrame:
    """Link matrices (t, x, y, z, mu, a, b) from all orders, as small integers; cells without orders are zero."""
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    n = F.pmod(F.col("o_orderkey") + F.col("o_custkey") * 13, F.lit(LINKS)).cast("long")
    cells = o.groupBy(n.alias("n")).agg(D.small(F.sum(F.floor("o_totalprice").cast("long")), 5).alias("re"), D.small(F.sum(F.col("o_custkey")), 5).alias("im"))

    def digit(unit: int, size: int):
        return (F.floor(F.col("n") / unit) % size).cast("long")

    return cells.select(digit(192, D.LT).alias("t"), digit(12, D.LX).alias("x"), digit(48, D.LY).alias("y"), digit(96, D.LZ).alias("z"), digit(4, 3).alias("mu"), digit(2, 2).alias("a"), digit(1, 2).alias("b"), "re", "im")


U_SQL = f"""u_n AS (SELECT (o_orderkey + o_custkey * 13) % {LINKS} AS n, {D.small_sql("sum(CAST(floor(o_totalprice) AS BIGINT))", 5)} AS re, {D.small_sql("sum(o_custkey)", 5)} AS im FROM orders GROUP BY 1),
u AS (SELECT n // 192 % {D.LT} AS t, n // 12 % {D.LX} AS x, n // 48 % {D.LY} AS y, n // 96 % {D.LZ} AS z, n // 4 % 3 AS mu, n // 2 % 2 AS a, n % 2 AS b, re, im FROM u_n)"""


def field(spark: SparkSession, sf: str) -> DataFrame:
    """Eigenvectors by coordinates: (t, x, y, z, c, e, re, im)."""
    x = F.col("x")
    v = D.eigenvectors(spark, sf).frame
    return v.select("t", (F.floor(x / D.NC) % D.LX).cast("long").alias("vx"), (F.floor(x / (D.NC * D.LX)) % D.LY).cast("long").alias("y"), F.floor(x / (D.NC * D.LX * D.LY)).cast("long").alias("z"), (x % D.NC).alias("c"), "e", "re", "im").withColumnRenamed("vx", "x")


F_SQL = f"f AS (SELECT t, x // {D.NC} % {D.LX} AS x, x // {D.NC * D.LX} % {D.LY} AS y, x // {D.NC * D.LX * D.LY} AS z, x % {D.NC} AS c, e, re, im FROM v)"


def _hop_sql(d: int, source: str = "f") -> str:
    step = [0, 0, 0]
    step[d % 3] = 1
    if d < 3:
        on = " AND ".join(f"f.{c} = (u.{c} + {s}) % {n}" for c, s, n in zip("xyz", step, EXT, strict=True))
        return f"SELECT u.t, u.x, u.y, u.z, u.a AS c, f.e, CAST(sum(u.re * f.re - u.im * f.im) AS BIGINT) AS re, CAST(sum(u.re * f.im + u.im * f.re) AS BIGINT) AS im FROM u JOIN {source} f ON f.t = u.t AND f.c = u.b AND {on} WHERE u.mu = {d} GROUP BY ALL"
    at = ", ".join(f"(u.{c} + {s}) % {n} AS {c}" for c, s, n in zip("xyz", step, EXT, strict=True))
    on = " AND ".join(f"f.{c} = u.{c}" for c in "xyz")
    return f"SELECT u.t, {at}, u.b AS c, f.e, CAST(sum(u.re * f.re + u.im * f.im) AS BIGINT) AS re, CAST(sum(u.re * f.im - u.im * f.re) AS BIGINT) AS im FROM u JOIN {source} f ON f.t = u.t AND f.c = u.a AND {on} WHERE u.mu = {d - 3} GROUP BY ALL"


FIELD = f"WITH {D.V_SQL},\n{U_SQL},\n{F_SQL}"


@query("n0_links", f"WITH {U_SQL}\nSELECT t, x, y, z, mu, a, b, re, im FROM u")
def links(spark, sf):
    return gauge(spark, sf)


@query("n1_laplacian", FIELD + "\nSELECT t, x, y, z, c, e, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM (SELECT t, x, y, z, c, e, 6 * re AS re, 6 * im AS im FROM f " + " ".join(f"UNION ALL SELECT t, x, y, z, c, e, -re, -im FROM ({_hop_sql(d)})" for d in range(6)) + ") GROUP BY ALL")
def n1(spark, sf):
    return X.laplacian(field(spark, sf), gauge(spark, sf), EXT, ("e",))


@query("n2_lowest_eigenvalues")
def n2(spark, sf):
    """Modes of the smeared, unitary links of each slice (doubles, so rounded)."""
    u = X.projected(_regular(gauge(spark, sf)), EXT, D.NC)
    return X.eigenvalues(u, EXT, D.NC, D.NE).withColumn("value", F.round("value", 6) + 0.0)


@query("n2_eigenmode_residuals", f"SELECT t.range AS t, e.range AS e, CAST(1 AS DOUBLE) AS norm, CAST(0 AS DOUBLE) AS residual FROM range({D.LT}) t, range({D.NE}) e")
def n2_modes(spark, sf):
    """Norm of every mode v, and of (laplacian - value) v, the laplacian by hops on rows and the value as found."""
    u = X.projected(_regular(gauge(spark, sf)), EXT, D.NC)
    v = X.eigenmodes(u, EXT, D.NC, D.NE)
    keys = ["t", "e", "x", "y", "z", "c"]
    moved = X.laplacian(v, u, EXT, ("e",)).select(*keys, F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = v.join(moved, keys).join(X.eigenvalues(u, EXT, D.NC, D.NE), ["t", "e"])
    off = (F.col("re2") - F.col("value") * F.col("re")) ** 2 + (F.col("im2") - F.col("value") * F.col("im")) ** 2
    return both.groupBy("t", "e").agg(F.round(F.sum(F.col("re") ** 2 + F.col("im") ** 2), 6).alias("norm"), F.round(F.sqrt(F.sum(off)), 6).alias("residual"))


@query("n2_iterative_modes", f"SELECT t.range AS t, e.range AS e, CAST(1 AS DOUBLE) AS norm, CAST(0 AS DOUBLE) AS residual FROM range({D.LT}) t, range({D.NE}) e")
def n2_iterative(spark, sf):
    """The same for modes found by filtered iteration on rows; values and spaces are held against dense ones by a test."""
    u = cut(X.projected(_regular(gauge(spark, sf)), EXT, D.NC))
    v = M.lowest(u, EXT, D.NE)
    keys = ["t", "e", "x", "y", "z", "c"]
    moved = X.laplacian(v, u, EXT, ("e",)).select(*keys, F.col("re").alias("re2"), F.col("im").alias("im2"))
    off = (F.col("re2") - F.col("value") * F.col("re")) ** 2 + (F.col("im2") - F.col("value") * F.col("im")) ** 2
    return v.join(moved, keys).groupBy("t", "e").agg(F.round(F.sum(F.col("re") ** 2 + F.col("im") ** 2), 6).alias("norm"), F.round(F.sqrt(F.sum(off)), 6).alias("residual"))


def _regular(u: DataFrame) -> DataFrame:
    """Links made invertible: nine times the unit matrix added; missing cells are filled."""
    s = u.sparkSession
    every = s.range(LINKS).withColumnRenamed("id", "n")

    def digit(unit: int, size: int):
        return (F.floor(F.col("n") / unit) % size).cast("long")

    cells = every.select(digit(192, D.LT).alias("t"), digit(12, D.LX).alias("x"), digit(48, D.LY).alias("y"), digit(96, D.LZ).alias("z"), digit(4, 3).alias("mu"), digit(2, 2).alias("a"), digit(1, 2).alias("b"))
    both = cells.join(u, ["t", "x", "y", "z", "mu", "a", "b"], "left")
    one = F.when(F.col("a") == F.col("b"), F.lit(9.0)).otherwise(F.lit(0.0))
    return both.select("t", "x", "y", "z", "mu", "a", "b", (F.coalesce("re", F.lit(0)) + one).alias("re"), F.coalesce("im", F.lit(0)).cast("double").alias("im"))


#: The unitary part of 2 x 2 matrices m in closed form: (m + phase(det m) cof(m)*) / sqrt(|m|^2 + 2 |det m|).
UNITARY_SQL = f"""{U_SQL},
g AS (SELECT t.range AS t, x.range AS x, y.range AS y, z.range AS z, mu.range AS mu FROM range({D.LT}) t, range({D.LX}) x, range({D.LY}) y, range({D.LZ}) z, range(3) mu),
m AS (SELECT g.t, g.x, g.y, g.z, g.mu, {", ".join(f"{9 * (a == b)} + coalesce(sum(u.re) FILTER (WHERE u.a = {a} AND u.b = {b}), 0) AS r{a}{b}, coalesce(sum(u.im) FILTER (WHERE u.a = {a} AND u.b = {b}), 0) AS i{a}{b}" for a in (0, 1) for b in (0, 1))}
  FROM g LEFT JOIN u ON u.t = g.t AND u.x = g.x AND u.y = g.y AND u.z = g.z AND u.mu = g.mu GROUP BY ALL),
dt AS (SELECT *, CAST(r00 * r11 - i00 * i11 - r01 * r10 + i01 * i10 AS DOUBLE) AS dr, CAST(r00 * i11 + i00 * r11 - r01 * i10 - i01 * r10 AS DOUBLE) AS di,
  CAST(r00 * r00 + i00 * i00 + r01 * r01 + i01 * i01 + r10 * r10 + i10 * i10 + r11 * r11 + i11 * i11 AS DOUBLE) AS ff FROM m),
ph AS (SELECT *, dr / sqrt(dr * dr + di * di) AS pr, di / sqrt(dr * dr + di * di) AS pi_, sqrt(ff + 2 * sqrt(dr * dr + di * di)) AS s FROM dt),
uu AS (SELECT t, x, y, z, mu, (r00 + pr * r11 + pi_ * i11) / s AS a_re, (i00 + pi_ * r11 - pr * i11) / s AS a_im, (r01 - pr * r10 - pi_ * i10) / s AS b_re, (i01 - pi_ * r10 + pr * i10) / s AS b_im,
  (r10 - pr * r01 - pi_ * i01) / s AS c_re, (i10 - pi_ * r01 + pr * i01) / s AS c_im, (r11 + pr * r00 + pi_ * i00) / s AS d_re, (i11 + pi_ * r00 - pr * i00) / s AS d_im FROM ph)"""


@query(
    "n3_unitary_projection",
    f"WITH {UNITARY_SQL}\nSELECT t, mu, a, b, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM ("
    + " UNION ALL ".join(f"SELECT t, mu, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b, (x + 2 * y + 3 * z + 1) * {n}_re AS re, (x + 2 * y + 3 * z + 1) * {n}_im AS im FROM uu" for n, a, b in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)))
    + ") GROUP BY ALL",
)
def n3(spark, sf):
    """The projected links of each slice and direction, entry by entry, summed with a weight that tells sites apart."""
    u = X.projected(_regular(gauge(spark, sf)), EXT, D.NC)
    site = F.col("x") + 2 * F.col("y") + 3 * F.col("z") + 1
    return u.groupBy("t", "mu", "a", "b").agg((F.round(F.sum(site * F.col("re")), 6) + 0.0).alias("re"), (F.round(F.sum(site * F.col("im")), 6) + 0.0).alias("im"))


@query("n4_stout_smearing")
def n4(spark, sf):
    """Smeared links of each slice and direction: sum of |entries|^2 (unitary) and of their real traces; a test holds them against loops over sites."""
    u = X.smeared(X.projected(_regular(gauge(spark, sf)), EXT, D.NC), EXT, D.NC, 2, 0.1)
    trace = F.when(F.col("a") == F.col("b"), F.col("re")).otherwise(0.0)
    return u.groupBy("t", "mu").agg(F.round(F.sum(F.col("re") ** 2 + F.col("im") ** 2), 6).alias("weight"), F.round(F.sum(trace), 6).alias("trace"))


@query("n5_elementals", f"WITH {D.V_SQL},\n{D.PHI_SQL}\nSELECT deriv, mom, t, b, c, re, im FROM phi")
def n5(spark, sf):
    return D.elementals(spark, sf).frame


#: Derivative paths of directions 0..2.
PATHS: tuple[tuple[int, ...], ...] = ((), (0,), (2,), (0, 1))


def derivative_elementals(f: DataFrame, u: DataFrame, paths=PATHS, coeff: DataFrame | None = None) -> DataFrame:
    """(path, mom, t, b, c): sum over all splits of a path of (-1)^right, conj (left part, reversed) times phase times right part.

    coeff (b, c, cr, ci): optional blending coefficients, a factor of each entry.
    """
    tree = X.WordTree([p for _, left, right, _ in splits(paths) for p in (left, right)], forward=True)
    made = X.derived_by_paths(f, u, tree, EXT, ("e",), D.kept)
    pairs = f.sparkSession.createDataFrame([(n, tree.number[left], tree.number[right], s) for n, left, right, s in splits(paths)], "path long, nl long, nr long, s long")
    a = made.join(F.broadcast(pairs), F.col("node") == F.col("nl")).select("path", "nr", "s", "t", "x", "y", "z", F.col("c").alias("k"), F.col("e").alias("b"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = made.select(F.col("node").alias("nr"), "t", "x", "y", "z", F.col("c").alias("k"), F.col("e").alias("c"), "re", "im")
    out = a.join(b, ["nr", "t", "x", "y", "z", "k"]).groupBy("path", "t", "x", "y", "z", "b", "c").agg(
        F.sum(F.col("s") * (F.col("ar") * F.col("re") + F.col("ai") * F.col("im"))).alias("re"), F.sum(F.col("s") * (F.col("ar") * F.col("im") - F.col("ai") * F.col("re"))).alias("im")
    )
    turns = F.array(*[F.struct(F.lit(m).cast("long").alias("mom"), F.pmod(p[0] * F.col("x") + 2 * p[1] * F.col("y") + 2 * p[2] * F.col("z"), F.lit(4)).alias("k")) for m, p in enumerate(D.MOMENTA)])
    every = out.select("path", "t", "b", "c", F.explode(turns).alias("q"), "re", "im")
    re = F.when(F.col("q.k") == 0, F.col("re")).when(F.col("q.k") == 1, -F.col("im")).when(F.col("q.k") == 2, -F.col("re")).otherwise(F.col("im"))
    im = F.when(F.col("q.k") == 0, F.col("im")).when(F.col("q.k") == 1, F.col("re")).when(F.col("q.k") == 2, -F.col("im")).otherwise(-F.col("re"))
    out = every.groupBy("path", F.col("q.mom").alias("mom"), "t", "b", "c").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    if coeff is None:
        return out
    return out.join(coeff, ["b", "c"]).select("path", "mom", "t", "b", "c", (F.col("re") * F.col("cr") - F.col("im") * F.col("ci")).alias("re"), (F.col("re") * F.col("ci") + F.col("im") * F.col("cr")).alias("im"))


AX = ("t", "x", "y", "z", "c", "e")


def _project(left: DataFrame, right: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(more, t, b, c): sum over sites and colours of conj left_b * right_c; more: labels of right."""
    sizes = {"t": D.LT, "x": D.LX, "y": D.LY, "z": D.LZ, "c": D.NC, "e": D.NE}
    a = Tensor(left.select(*AX, "re", "im"), AX, sizes)
    b = Tensor(right.select(*more, *AX, "re", "im"), (*more, *AX), sizes)
    out = contract([a.conj().renamed("t", "x", "y", "z", "k", "b"), b.renamed(*more, "t", "x", "y", "z", "k", "c")], (*more, "t", "b", "c"))
    return out.frame


def _project_sql(right: str) -> str:
    return flat_sql([("f", AX, ("t", "x", "y", "z", "k", "b"), True), (right, AX, ("t", "x", "y", "z", "k", "c"), False)], ("t", "b", "c"))


WORD = (0, 4)


@query("n6_displaced_elemental", f"{FIELD},\nh1 AS ({_hop_sql(4)}),\nh2 AS ({_hop_sql(0, 'h1')})\n{_project_sql('h2')}")
def n6(spark, sf):
    """Modes joined through links along a word: x ahead, then y back."""
    f, u = field(spark, sf), gauge(spark, sf)
    moved = f
    for d in reversed(WORD):
        moved = X.hop(moved, u, d, EXT, ("e",))
    return _project(f, moved)


TR1 = f"w1 AS (SELECT p.t, p.p, (p.x + 1) % {D.LX} AS x, p.y, p.z, u.a, u.b, u.re, u.im FROM pts p JOIN u ON u.t = p.t AND u.x = p.x AND u.y = p.y AND u.z = p.z AND u.mu = 0)"


@query(
    "n7_point_transport",
    f"WITH {U_SQL},\n{D.POINTS_SQL},\n{TR1}\nSELECT w.t, w.p, w.x, (w.y + {D.LY - 1}) % {D.LY} AS y, w.z, w.a, u.a AS b, CAST(sum(w.re * u.re + w.im * u.im) AS BIGINT) AS re, CAST(sum(w.im * u.re - w.re * u.im) AS BIGINT) AS im FROM w1 w JOIN u ON u.t = w.t AND u.x = w.x AND u.y = (w.y + {D.LY - 1}) % {D.LY} AND u.z = w.z AND u.mu = 1 AND u.b = w.b GROUP BY ALL",
)
def n7(spark, sf):
    return X.transport(gauge(spark, sf), D.points(spark, sf), WORD, EXT, D.NC)


CUR = f"""wt AS (SELECT w.t, w.p, w.x, (w.y + {D.LY - 1}) % {D.LY} AS y, w.z, w.a, u.a AS b, CAST(sum(w.re * u.re + w.im * u.im) AS BIGINT) AS re, CAST(sum(w.im * u.re - w.re * u.im) AS BIGINT) AS im FROM w1 w JOIN u ON u.t = w.t AND u.x = w.x AND u.y = (w.y + {D.LY - 1}) % {D.LY} AND u.z = w.z AND u.mu = 1 AND u.b = w.b GROUP BY ALL)"""


@query(
    "n8_current_p2v",
    f"{FIELD},\n{D.POINTS_SQL},\n{TR1},\n{CUR}\nSELECT w.t, w.p, w.a AS c, f.e, CAST(sum(w.re * f.re - w.im * f.im) AS BIGINT) AS re, CAST(sum(w.re * f.im + w.im * f.re) AS BIGINT) AS im FROM wt w JOIN f ON f.t = w.t AND f.x = w.x AND f.y = w.y AND f.z = w.z AND f.c = w.b GROUP BY ALL",
)
def n8(spark, sf):
    """From a point along a word to the modes: transport, then a look-up on the coordinates reached."""
    w = X.transport(gauge(spark, sf), D.points(spark, sf), WORD, EXT, D.NC)
    f = field(spark, sf).select("t", "x", "y", "z", F.col("c").alias("b"), "e", F.col("re").alias("fr"), F.col("im").alias("fi"))
    both = w.join(f, ["t", "x", "y", "z", "b"])
    return both.groupBy("t", "p", F.col("a").alias("c"), "e").agg(F.sum(F.col("re") * F.col("fr") - F.col("im") * F.col("fi")).alias("re"), F.sum(F.col("re") * F.col("fi") + F.col("im") * F.col("fr")).alias("im"))


@query(
    "n8_current_p2p",
    f"WITH {U_SQL},\n{D.POINTS_SQL},\n{TR1},\n{CUR}\nSELECT w.t, w.p AS p_l, q.p AS p_r, w.a AS c_l, w.b AS c_r, w.re, w.im FROM wt w JOIN pts q ON q.t = w.t AND q.x = w.x AND q.y = w.y AND q.z = w.z",
)
def n8_p2p(spark, sf):
    """Pairs of sampled points that the word joins, with its links."""
    w = X.transport(gauge(spark, sf), D.points(spark, sf), WORD, EXT, D.NC)
    q = D.points(spark, sf).select("t", "x", "y", "z", F.col("p").alias("p_r"))
    return w.join(q, ["t", "x", "y", "z"]).select("t", F.col("p").alias("p_l"), "p_r", F.col("a").alias("c_l"), F.col("b").alias("c_r"), "re", "im")


#: All words of up to two letters, those that step straight back among them.
WORDS: list[tuple[int, ...]] = [(), *[(d,) for d in range(6)], *[(d, e) for d in range(6) for e in range(6)]]


def word_fields(f: DataFrame, u: DataFrame, words: list[tuple[int, ...]], ext=EXT, hold=D.kept) -> tuple[X.WordTree, DataFrame]:
    """The tree of words and their conjugates, and U_w F of each of its nodes: what V2V, P2V and V2P elementals hang off."""
    tree = X.WordTree([*words, *[conjugate(w) for w in words]], forward=False)
    return tree, hold(X.moved_by_words(f, u, tree, ext, ("e",), hold))


def elementals_v2v(f: DataFrame, tree: X.WordTree, moved: DataFrame, words: list[tuple[int, ...]]) -> DataFrame:
    """(w, t, b, c): mode b to mode c along a word."""
    return _project(f, tree.named(moved, words), ("w",))


def elementals_p2v(points: DataFrame, tree: X.WordTree, moved: DataFrame, words: list[tuple[int, ...]]) -> DataFrame:
    """(w, t, p, c, e): a point and colour to a mode along a word."""
    return tree.named(moved, words).join(points, ["t", "x", "y", "z"]).select("w", "t", "p", "c", "e", "re", "im")


def elementals_v2p(points: DataFrame, tree: X.WordTree, moved: DataFrame, words: list[tuple[int, ...]]) -> DataFrame:
    """(w, t, e, p, c): a mode to a point and colour along a word: the conjugate of the word walked back from the point."""
    back = tree.named(moved, [conjugate(w) for w in words]).join(points, ["t", "x", "y", "z"])
    return back.select("w", "t", "e", "p", "c", "re", (-F.col("im")).alias("im"))


def elementals_p2p(points: DataFrame, u: DataFrame, words: list[tuple[int, ...]], ext=EXT, colours: int = D.NC) -> DataFrame:
    """(w, t, p_l, p_r, c_l, c_r): pairs of sampled points that a word joins, with its links."""
    tree = X.WordTree(words, forward=True)
    ends = tree.named(X.transported_by_words(u, points, tree, ext, colours, D.kept), words)
    to = points.select("t", "x", "y", "z", F.col("p").alias("p_r"))
    return ends.join(to, ["t", "x", "y", "z"]).select("w", "t", F.col("p").alias("p_l"), "p_r", F.col("a").alias("c_l"), F.col("b").alias("c_r"), "re", "im")


def _ahead_sql(c: str, i: int) -> str:
    return f"({c} + CASE WHEN mu = {i} THEN 1 ELSE 0 END) % {EXT[i]}"


#: Links as they are walked: field site and colour (fx, fy, fz, k) to target (x, y, z, c).
OL_SQL = (
    f"ol AS (SELECT mu AS dir, t, {', '.join(f'{_ahead_sql(c, i)} AS f{c}' for i, c in enumerate('xyz'))}, x, y, z, a AS c, b AS k, re, im FROM u"
    f" UNION ALL SELECT mu + 3, t, x, y, z, {', '.join(_ahead_sql(c, i) for i, c in enumerate('xyz'))}, b, a, re, -im FROM u)"
)
_WALK = "CAST(sum(ol.re * f.re - ol.im * f.im) AS BIGINT) AS re, CAST(sum(ol.re * f.im + ol.im * f.re) AS BIGINT) AS im"
_MEET = "JOIN ol ON ol.t = f.t AND ol.fx = f.x AND ol.fy = f.y AND ol.fz = f.z AND ol.k = f.c GROUP BY ALL"
#: Derivatives of the modes by node: 0, then 1 + d, then 4 + 3 d + e for direction d first, e second.
_GRAD = "sum(CASE WHEN ol.dir < 3 THEN 1 ELSE -1 END * (ol.re * f.re - ol.im * f.im)) AS re, sum(CASE WHEN ol.dir < 3 THEN 1 ELSE -1 END * (ol.re * f.im + ol.im * f.re)) AS im"
DV_SQL = f"""dv1 AS (SELECT 1 + ol.dir % 3 AS node, ol.t, ol.x, ol.y, ol.z, ol.c, f.e, {_GRAD} FROM f {_MEET}),
dv AS (SELECT 0 AS node, t, x, y, z, c, e, re, im FROM f UNION ALL SELECT * FROM dv1 UNION ALL
  SELECT 4 + 3 * (f.node - 1) + ol.dir % 3 AS node, ol.t, ol.x, ol.y, ol.z, ol.c, f.e, {_GRAD} FROM dv1 f {_MEET})"""


def _node(path: tuple[int, ...]) -> int:
    return 0 if not path else 1 + path[0] if len(path) == 1 else 4 + 3 * path[0] + path[1]


def splits(paths: tuple[tuple[int, ...], ...]) -> list[tuple[int, tuple[int, ...], tuple[int, ...], int]]:
    """(place of the path, left part reversed, right part, sign) of all splits of paths."""
    out = []
    for n, path in enumerate(paths):
        for pick in range(1 << len(path)):
            right = tuple(d for i, d in enumerate(path) if pick >> i & 1)
            left = tuple(d for i, d in enumerate(path) if not pick >> i & 1)[::-1]
            out.append((n, left, right, (-1) ** len(right)))
    return out


def derivative_sql(name: str, paths: tuple[tuple[int, ...], ...]) -> str:
    """The derivative elementals of paths of up to two letters as CTEs, after FIELD and OL_SQL: (path, mom, t, b, c, re, im)."""
    rows = D.values_sql("sp", "path, nl, nr, s", [(n, _node(left), _node(right), sign) for n, left, right, sign in splits(paths)])
    turns = D.values_sql("tn", "mom, px, py, pz", [(m, *p) for m, p in enumerate(D.MOMENTA)])
    return f"""{DV_SQL},
{rows},
{turns},
de AS (SELECT sp.path, l.t, l.x, l.y, l.z, l.e AS b, r.e AS c, sum(sp.s * (l.re * r.re + l.im * r.im)) AS re, sum(sp.s * (l.re * r.im - l.im * r.re)) AS im FROM sp JOIN dv l ON l.node = sp.nl JOIN dv r ON r.node = sp.nr AND r.t = l.t AND r.x = l.x AND r.y = l.y AND r.z = l.z AND r.c = l.c GROUP BY ALL),
dk AS (SELECT path, mom, t, b, c, ((px * x + 2 * py * y + 2 * pz * z) % 4 + 4) % 4 AS k, re, im FROM de, tn),
{name} AS (SELECT path, mom, t, b, c, CAST(sum(CASE k WHEN 0 THEN re WHEN 1 THEN -im WHEN 2 THEN -re ELSE im END) AS BIGINT) AS re, CAST(sum(CASE k WHEN 0 THEN im WHEN 1 THEN re WHEN 2 THEN -im ELSE -re END) AS BIGINT) AS im FROM dk GROUP BY path, mom, t, b, c)"""


@query("n5_derivative_elementals", f"{FIELD},\n{OL_SQL},\n{derivative_sql('der', PATHS)}\nSELECT path, mom, t, b, c, re, im FROM der")
def n5_paths(spark, sf):
    return derivative_elementals(field(spark, sf), gauge(spark, sf))


#: U_w V of all words by number: 0, then 1 + d, then 7 + 6 d + e.
WF_SQL = f"""{OL_SQL},
wf1 AS (SELECT 1 + ol.dir AS w, ol.t, ol.x, ol.y, ol.z, ol.c, f.e, {_WALK} FROM f {_MEET}),
wf AS (SELECT 0 AS w, t, x, y, z, c, e, re, im FROM f UNION ALL SELECT * FROM wf1 UNION ALL
  SELECT 7 + 6 * ol.dir + f.w - 1 AS w, ol.t, ol.x, ol.y, ol.z, ol.c, f.e, {_WALK} FROM wf1 f {_MEET})"""


V2V_SQL = "SELECT CAST(g.w AS BIGINT) AS w, f.t, f.e AS b, g.e AS c, CAST(sum(f.re * g.re + f.im * g.im) AS BIGINT) AS re, CAST(sum(f.re * g.im - f.im * g.re) AS BIGINT) AS im FROM f JOIN wf g ON f.t = g.t AND f.x = g.x AND f.y = g.y AND f.z = g.z AND f.c = g.c GROUP BY ALL"


@query("n8_words_v2v", f"{FIELD},\n{WF_SQL}\n{V2V_SQL}")
def n8_v2v(spark, sf):
    """All 43 words of up to two letters, each edge of their tree walked once."""
    f = field(spark, sf)
    tree, moved = word_fields(f, gauge(spark, sf), WORDS)
    return elementals_v2v(f, tree, moved, WORDS)


_AT = "JOIN pts ON pts.t = wf.t AND pts.x = wf.x AND pts.y = wf.y AND pts.z = wf.z"


P2V_SQL = f"SELECT CAST(w AS BIGINT) AS w, wf.t, pts.p, wf.c, e, re, im FROM wf {_AT}"


@query("n8_words_p2v", f"{FIELD},\n{D.POINTS_SQL},\n{WF_SQL}\n{P2V_SQL}")
def n8_p2v(spark, sf):
    tree, moved = word_fields(field(spark, sf), gauge(spark, sf), WORDS)
    return elementals_p2v(D.points(spark, sf), tree, moved, WORDS)


#: A word's conjugate: letters turned round, in reverse order.
_CONJ = "CASE WHEN w = 0 THEN 0 WHEN w < 7 THEN 1 + (w - 1 + 3) % 6 ELSE 7 + 6 * (((w - 7) % 6 + 3) % 6) + ((w - 7) // 6 + 3) % 6 END"


V2P_SQL = f"SELECT CAST({_CONJ} AS BIGINT) AS w, wf.t, e, pts.p, wf.c, re, -im AS im FROM wf {_AT}"


@query("n8_words_v2p", f"{FIELD},\n{D.POINTS_SQL},\n{WF_SQL}\n{V2P_SQL}")
def n8_v2p(spark, sf):
    tree, moved = word_fields(field(spark, sf), gauge(spark, sf), WORDS)
    return elementals_v2p(D.points(spark, sf), tree, moved, WORDS)


_STEP = "CAST(sum(l.re * ol.re - l.im * ol.im) AS BIGINT) AS re, CAST(sum(l.re * ol.im + l.im * ol.re) AS BIGINT) AS im"


LE_SQL = f"""l0 AS (SELECT pts.*, c.range AS a, c.range AS b, 1 AS re, 0 AS im FROM pts, range({D.NC}) c),
l1 AS (SELECT 1 + ol.dir AS w, l.t, l.p, ol.fx AS x, ol.fy AS y, ol.fz AS z, l.a, ol.k AS b, {_STEP} FROM l0 l JOIN ol ON ol.t = l.t AND ol.x = l.x AND ol.y = l.y AND ol.z = l.z AND ol.c = l.b GROUP BY ALL),
l2 AS (SELECT 7 + 6 * (l.w - 1) + ol.dir AS w, l.t, l.p, ol.fx AS x, ol.fy AS y, ol.fz AS z, l.a, ol.k AS b, {_STEP} FROM l1 l JOIN ol ON ol.t = l.t AND ol.x = l.x AND ol.y = l.y AND ol.z = l.z AND ol.c = l.b GROUP BY ALL),
le AS (SELECT 0 AS w, t, p, x, y, z, a, b, re, im FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""
P2P_SQL = "SELECT CAST(w AS BIGINT) AS w, le.t, le.p AS p_l, pts.p AS p_r, a AS c_l, b AS c_r, CAST(re AS BIGINT) AS re, CAST(im AS BIGINT) AS im FROM le JOIN pts ON pts.t = le.t AND pts.x = le.x AND pts.y = le.y AND pts.z = le.z"


@query("n8_words_p2p", f"WITH {U_SQL},\n{D.POINTS_SQL},\n{OL_SQL},\n{LE_SQL}\n{P2P_SQL}")
def n8_words_p2p(spark, sf):
    return elementals_p2p(D.points(spark, sf), gauge(spark, sf), WORDS)


@query("n9_distance_elemental", f"{FIELD},\n" + ",\n".join(f"h{d} AS ({_hop_sql(d)}),\ng{d} AS ({_hop_sql(d, f'h{d}')})" for d in range(6)) + ",\nav AS (" + " UNION ALL ".join(f"SELECT * FROM g{d}" for d in range(6)) + f"),\nr AS ({_project_sql('av')})\nSELECT x.t, x.b, x.c, x.re + y.re AS re, x.im - y.im AS im FROM r x JOIN r y ON x.t = y.t AND x.b = y.c AND x.c = y.b")
def n9(spark, sf):
    """Distance 2: six times the mean over the straight displacements, both orders added."""
    f, u = field(spark, sf), gauge(spark, sf)
    r = _project(f, X.straight(f, u, 2, EXT, ("e",)))
    other = r.select(F.col("t").alias("t2"), F.col("b").alias("c2"), F.col("c").alias("b2"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = r.join(other, (F.col("t") == F.col("t2")) & (F.col("b") == F.col("b2")) & (F.col("c") == F.col("c2")))
    return both.select("t", "b", "c", (F.col("re") + F.col("re2")).alias("re"), (F.col("im") - F.col("im2")).alias("im"))


@query("n10_noise_norms", f"SELECT t.range AS t, n.range AS n, CAST(1 AS DOUBLE) AS norm FROM range({D.LT}) t, range(2, 4) n")
def n10(spark, sf):
    """Two high-mode vectors a slice beside copies and phases; theirs are orthonormal."""
    v = D.eigenvectors(spark, sf).frame.select("t", "e", "x", "re", "im")
    n = X.noise(v, [(1, 1), (5, 1)], 7, high=2)
    return n.where("n >= 2").groupBy("t", "n").agg(F.round(F.sum(F.col("re") ** 2 + F.col("im") ** 2), 6).alias("norm"))


# projections of solutions onto modes: the solutions come from outside; here from the line items ----

SOL = D.LT * D.NX * D.NS * D.NE


@D.held
def solution(spark: SparkSession, sf: str) -> Tensor:
    """S(t, x, i, a): a solved field at vector index x and spin i for source mode a."""
    l = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    n = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(SOL)).cast("long")
    cells = l.groupBy(n.alias("n")).agg(D.small(F.sum(F.floor("l_quantity").cast("long")), 9).alias("re"), D.small(F.sum(F.round(F.col("l_tax") * 100).cast("long")), 9).alias("im"))

    def digit(unit: int, size: int):
        return (F.floor(F.col("n") / unit) % size).cast("long")

    frame = cells.select(digit(D.NX * D.NS * D.NE, D.LT).alias("t"), digit(D.NS * D.NE, D.NX).alias("x"), digit(D.NE, D.NS).alias("i"), digit(1, D.NE).alias("a"), "re", "im")
    return Tensor(frame, ("t", "x", "i", "a"), {"t": D.LT, "x": D.NX, "i": D.NS, "a": D.NE})


S_SQL = f"""s_n AS (SELECT (l_orderkey * 7 + l_linenumber) % {SOL} AS n, {D.small_sql("sum(CAST(floor(l_quantity) AS BIGINT))", 9)} AS re, {D.small_sql("sum(CAST(round(l_tax * 100) AS BIGINT))", 9)} AS im FROM lineitem GROUP BY 1),
sol AS (SELECT n // {D.NX * D.NS * D.NE} % {D.LT} AS t, n // {D.NS * D.NE} % {D.NX} AS x, n // {D.NE} % {D.NS} AS i, n % {D.NE} AS a, re, im FROM s_n)"""


@query("n11_projected_solution", f"WITH {D.V_SQL},\n{S_SQL}\n" + flat_sql([("v", ("t", "e", "x"), ("t", "b", "x"), True), ("sol", ("t", "x", "i", "a"), ("t", "x", "i", "a"), False)], ("t", "i", "b", "a")))
def n11(spark, sf):
    """A stored solution projected onto the modes: a perambulator."""
    return contract([D.eigenvectors(spark, sf).conj().renamed("t", "b", "x"), solution(spark, sf)], ("t", "i", "b", "a")).frame


_PX = f"pts.x + {D.LX} * (pts.y + {D.LY} * pts.z)"


def solution_at_points(s: Tensor, points: DataFrame) -> DataFrame:
    """(t, p, c, i, a): a stored solution read at sampled points, a join on coordinates: a propagator whose sink is points."""
    x = F.col("x")
    rows = s.frame.select("t", (x % D.NC).alias("c"), (F.floor(x / D.NC) % D.LX).cast("long").alias("sx"), (F.floor(x / (D.NC * D.LX)) % D.LY).cast("long").alias("sy"), F.floor(x / (D.NC * D.LX * D.LY)).cast("long").alias("sz"), "i", "a", "re", "im")
    pts = points.select(F.col("t").alias("pt"), "p", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return rows.join(pts, [F.col("t") == F.col("pt"), F.col("sx") == F.col("px"), F.col("sy") == F.col("py"), F.col("sz") == F.col("pz")]).select("t", "p", "c", "i", "a", "re", "im")


@query("n11_point_sink", f"WITH {S_SQL},\n{D.POINTS_SQL}\nSELECT sol.t, pts.p, sol.x % {D.NC} AS c, sol.i, sol.a, sol.re, sol.im FROM sol JOIN pts ON pts.t = sol.t AND {_PX} = sol.x // {D.NC}")
def n11_point_sink(spark, sf):
    """The solution at sampled points."""
    return solution_at_points(solution(spark, sf), D.points(spark, sf))


@query("n11_point_source", f"WITH {S_SQL},\n{D.POINTS_SQL}\nSELECT sol.t, sol.a AS b, sol.i, pts.p, sol.x % {D.NC} AS c, sol.re * CASE WHEN sol.i >= 2 THEN -1 ELSE 1 END AS re, -sol.im * CASE WHEN sol.i >= 2 THEN -1 ELSE 1 END AS im FROM sol JOIN pts ON pts.t = sol.t AND {_PX} = sol.x // {D.NC}")
def n11_point_source(spark, sf):
    """From sampled points to the modes: the solution at points, daggered, with the signs of the spin that it keeps."""
    rows = solution_at_points(solution(spark, sf), D.points(spark, sf))
    sgn = F.when(F.col("i") >= 2, -1).otherwise(1)
    return rows.select("t", F.col("a").alias("b"), "i", "p", "c", (F.col("re") * sgn).alias("re"), (-F.col("im") * sgn).alias("im"))


GEN = [("sol", ("t", "x", "i", "a"), ("t", "x", "j", "b"), True), ("g", ("n", "i", "j"), ("n", "j", "k"), False), ("sol", ("t", "x", "i", "a"), ("t", "x", "k", "a"), False)]


@query("n12_generalised_perambulator", f"WITH {S_SQL},\n{D.G_SQL}\n" + flat_sql(GEN, ("n", "t", "b", "a"), extra="o1.n IN (0, 1, 8, 15)"))
def n12(spark, sf):
    """conj S gamma S summed over sites, for several spin matrices at once."""
    s = solution(spark, sf)
    g = D.gammas(spark).where("n IN (0, 1, 8, 15)")
    return contract([s.conj().renamed("t", "x", "j", "b"), g.renamed("n", "j", "k"), s.renamed("t", "x", "k", "a")], ("n", "t", "b", "a")).frame


@query("n13_density_perambulator", f"WITH {S_SQL},\n{D.G_SQL}\nSELECT x // {D.NC} AS site, t, b, a, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM ({flat_sql(GEN, ('n', 't', 'x', 'b', 'a'), extra='o1.n = 8')}) GROUP BY ALL")
def n13(spark, sf):
    """The same with the site kept."""
    s = solution(spark, sf)
    g = D.gammas(spark).where("n = 8")
    c = contract([s.conj().renamed("t", "x", "j", "b"), g.renamed("n", "j", "k"), s.renamed("t", "x", "k", "a")], ("t", "x", "b", "a")).frame
    return c.groupBy(F.floor(F.col("x") / D.NC).cast("long").alias("site"), "t", "b", "a").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


@query("n14_even_odd_layout", f"SELECT t.range AS t, z.range AS z, y.range AS y, x.range AS x, (t.range + z.range + y.range + x.range) % 2 AS parity, x.range // 2 + {D.LX // 2} * (y.range + {D.LY} * (z.range + {D.LZ} * t.range)) AS place FROM range({D.LT}) t, range({D.LZ}) z, range({D.LY}) y, range({D.LX}) x")
def n14(spark, sf):
    n = D.LT * 16
    sites = spark.range(n).select(F.floor(F.col("id") / 16).cast("long").alias("t"), (F.floor(F.col("id") / 8) % 2).cast("long").alias("z"), (F.floor(F.col("id") / 4) % 2).cast("long").alias("y"), (F.col("id") % 4).alias("x"))
    return sites.select("t", "z", "y", "x", *[c.alias(k) for k, c in X.relayout((D.LX, D.LY, D.LZ, D.LT)).items()])


_ = C
