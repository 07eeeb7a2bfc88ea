"""Queries over sums of diagrams by one shared plan: configurations, several sampled points, current vertices."""

from __future__ import annotations

from fractions import Fraction
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.catalog_correlators import BASE, H1O, H2O, HALF1, HALF2, OVER, POINT, REL, SRCV, VERT, Points
from tensorloom.catalog_fields import F_SQL, LE_SQL, OL_SQL, P2P_SQL, P2V_SQL, U_SQL, V2P_SQL, V2V_SQL, WF_SQL, WORDS, elementals_p2p, elementals_p2v, elementals_v2p, elementals_v2v, field, gauge, word_fields
from tensorloom.catalog_symbolic import CH, CHAINS, _tensors, cycle_sql
from tensorloom.operators import baryons as B
from tensorloom.operators import construction as O
from tensorloom.operators import correlators as C
from tensorloom.operators import points as P
from tensorloom.plans import diagrams as D
from tensorloom.plans import symmetry as S
from tensorloom.plans import wick as W
from tensorloom.plans.einsum import CFG, Tensor, contract, flat_sql
from tensorloom.plans.shared import Plan
from tensorloom.sources import derived as T

Q: dict = {}
SQL: dict[str, str] = {}
CFGS = 4
VOLUME = T.LX * T.LY * T.LZ


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# all terms of a correlator, all configurations ---------------------------------------------------


def over_configurations(t: Tensor, count: int = CFGS) -> Tensor:
    """Configuration k has k + 1 times the tensor: a row that met another configuration would show."""
    cfg = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(CFG)
    frame = t.frame.select(cfg, *t.axes, "re", "im")
    times = (F.col(CFG) + 1).cast("long")
    return Tensor(frame.select(F.col(CFG).cast("long").alias(CFG), *t.axes, (F.col("re") * times).alias("re"), (F.col("im") * times).alias("im")), (CFG, *t.axes), {**t.sizes, CFG: count})


def two_pions() -> D.Expression:
    """All contractions of two pions at each of two times: vacuum, box and twice the single one."""
    two = [(Fraction(1), [W.Hadron("ud", "pi"), W.Hadron("du", "pi")])]
    return W.correlator([[two], [two]])[0, 0]


def two_pion_plan(spark: SparkSession, sf: str) -> Plan:
    props, vertices = _tensors(spark, sf)
    tau = over_configurations(props["q"])
    return D.plan_sum(two_pions(), {"q": tau, "q_local": tau}, {"pi": vertices["pi"], "pi†": vertices["b1"]}, {0: "s", 1: "t"}, ("s", "t"))


def _turn(op: int) -> str:
    """Two vertices of an operator at one time and the propagators that arrive at them, one of them from the other time."""
    return flat_sql([("ch", CH, (str(op), "s", "s", "j", "b", "x", "y"), False), ("ch", CH, (str(op), "t", "s", "x", "y", "i", "a"), False)], ("s", "t", "j", "b", "i", "a"))


def _loop(op: int) -> str:
    return f"SELECT x.t, sum(CAST(x.re AS HUGEINT) * y.re - CAST(x.im AS HUGEINT) * y.im) AS re, sum(CAST(x.re AS HUGEINT) * y.im + CAST(x.im AS HUGEINT) * y.re) AS im FROM ch x JOIN ch y ON x.op = {op} AND y.op = {op} AND x.s = x.t AND y.s = y.t AND x.t = y.t AND x.j = y.i AND x.b = y.a AND x.i = y.j AND x.a = y.b GROUP BY 1"


TWO_PIONS = f"""{CHAINS},
m0 AS ({_turn(0)}), m1 AS ({_turn(1)}),
box AS (SELECT l.s, l.t, sum(CAST(l.re AS HUGEINT) * r.re - CAST(l.im AS HUGEINT) * r.im) AS re, sum(CAST(l.re AS HUGEINT) * r.im + CAST(l.im AS HUGEINT) * r.re) AS im
  FROM m0 l JOIN m1 r ON l.s = r.t AND l.t = r.s AND l.j = r.i AND l.b = r.a AND l.i = r.j AND l.a = r.b GROUP BY ALL),
one AS ({cycle_sql([0, 1], ["s", "t"])}),
l0 AS ({_loop(0)}), l1 AS ({_loop(1)}),
every AS (SELECT s, t, CAST(re AS HUGEINT) * re - CAST(im AS HUGEINT) * im AS re, 2 * CAST(re AS HUGEINT) * im AS im FROM one
  UNION ALL SELECT s, t, -2 * re, -2 * im FROM box
  UNION ALL SELECT l0.t, l1.t, l0.re * l1.re - l0.im * l1.im, l0.re * l1.im + l0.im * l1.re FROM l0, l1)
SELECT k.range AS cfg, s, t, floor(CAST(sum(re) * (k.range + 1) ** 4 AS DOUBLE) / 1000000) AS re, floor(CAST(sum(im) * (k.range + 1) ** 4 AS DOUBLE) / 1000000) AS im FROM every, range({CFGS}) k GROUP BY k.range, s, t"""


@query("a22_two_pion_configurations", TWO_PIONS)
def a22_two_pions(spark, sf):
    """Every term of the correlator over four configurations by one plan; four propagators a term, so configuration k has (k + 1)^4. In millions."""
    out = two_pion_plan(spark, sf).total(("s", "t"), T.kept)
    return out.select("cfg", "s", "t", *[F.floor(F.col(c).cast("double") / 1000000).cast("double").alias(c) for c in ("re", "im")])


def _twopoints(spark: SparkSession, sf: str) -> DataFrame:
    """(cfg, dt, value): the real part of the pion's two-point function, configuration by configuration, in one contraction."""
    b = Points(spark, sf)
    elem = b.elem().where("op = 0")
    tau = over_configurations(b.tau())
    return C.relative(C.twopoint(tau, b.v(elem), b.w(elem), ()), T.LT, ()).select("cfg", "dt", F.col("re").cast("double").alias("value"))


_TWOPOINTS = f"{REL},\ncs AS (SELECT k.range AS cfg, dt, CAST(re * (k.range + 1) * (k.range + 1) AS DOUBLE) AS value FROM rel, range({CFGS}) k WHERE op_snk = 0 AND op_src = 0)"


@query("a26_twopoint_mean", f"{_TWOPOINTS}\nSELECT dt, count(*) AS n, avg(value) AS mean, round(stddev_samp(value) / sqrt(count(*)), 2) AS error FROM cs GROUP BY dt")
def a26_mean(spark, sf):
    """Mean and error of the two-point function over its configurations."""
    return C.ensemble(_twopoints(spark, sf), "dt").withColumn("error", F.round("error", 2))


@query("a26_twopoint_covariance", f"{_TWOPOINTS}\nSELECT a.dt, b.dt AS other, round(covar_samp(a.value, b.value) / 1000000) AS cov FROM cs a JOIN cs b USING (cfg) GROUP BY ALL")
def a26_covariance(spark, sf):
    """Covariance of its times over the configurations, in millions."""
    return C.ensemble_covariance(_twopoints(spark, sf), "dt").withColumn("cov", F.round(F.col("cov") / 1000000))


# several sampled points ----------------------------------------------------------------------


def point_cycle_plan(ov: Tensor, points: int, volume: int = VOLUME, sampled: int = T.NP) -> Plan:
    """Estimator of sum tr P(p1, p2) P(p2, p3) ... P(pn, p1) over all sites from sampled ones, P the projector on the modes; times sampled! / (sampled - n)!.

    Every identification of points is a term of free sums, so an intermediate has two point labels at most.
    """
    plan = Plan({"m": ov, "m*": ov.conj()})
    scale = prod(sampled - i for i in range(points))
    for blocks, factor in D.identified_weights(list(range(points)), volume, sampled):
        at = {p: f"p{i}" for i, block in enumerate(blocks) for p in block}
        own = []
        for k in range(points):
            after = (k + 1) % points
            own += [("m", ("t", f"e{k}", at[k], f"c{k}")), ("m*", ("t", f"e{k}", at[after], f"c{after}"))]
        plan.add(own, ("t",), factor * scale)
    return plan


def _direct_sql(n: int) -> str:
    """The same as one direct sum over all n-tuples of points."""
    scale = prod(T.NP - i for i in range(n))
    weight = " ".join(f"WHEN {k} THEN {int(D.sampling_weight(VOLUME, T.NP, k) * scale)}" for k in range(1, n + 1))
    terms = [("pr", ("t", "p", "c", "q", "d"), ("t", f"p{k}", f"c{k}", f"p{(k + 1) % n}", f"c{(k + 1) % n}"), False) for k in range(n)]
    tuples = flat_sql(terms, ("t", *[f"p{k}" for k in range(n)]))
    different = f"len(list_distinct([{', '.join(f'p{k}' for k in range(n))}]))"
    return (
        f"WITH {T.V_SQL},\n{T.POINTS_SQL},\n{OVER},\npr AS (SELECT l.t, l.p, l.c, r.p AS q, r.c AS d, CAST(sum(l.re * r.re + l.im * r.im) AS BIGINT) AS re, CAST(sum(l.im * r.re - l.re * r.im) AS BIGINT) AS im FROM ov l JOIN ov r ON l.t = r.t AND l.e = r.e GROUP BY ALL),\n"
        f"tp AS ({tuples}),\nww AS (SELECT t, CASE {different} {weight} END AS w, re, im FROM tp)\n"
        f"SELECT t, CAST(sum(w * re) AS DOUBLE) / {scale} AS re, CAST(sum(w * im) AS DOUBLE) / {scale} AS im FROM ww GROUP BY t"
    )


def _estimated(plan: Plan, scale: int, axes: tuple[str, ...]) -> DataFrame:
    out = plan.total(axes, T.kept)
    return out.select(*axes, *[(F.col(c).cast("double") / scale).alias(c) for c in ("re", "im")])


@query("s6_three_points", _direct_sql(3))
def s6_three(spark, sf):
    """Three sampled points of a slice, five identifications."""
    return _estimated(point_cycle_plan(Points(spark, sf).ov(), 3), prod(T.NP - i for i in range(3)), ("t",))


@query("s6_four_points", _direct_sql(4))
def s6_four(spark, sf):
    """Four sampled points of a slice, fifteen identifications."""
    return _estimated(point_cycle_plan(Points(spark, sf).ov(), 4), prod(T.NP - i for i in range(4)), ("t",))


# a current vertex with displaced mode and point ends ------------------------------------------------

#: The current: gamma number, and coefficients of words by their place in WORDS (none, one step in x).
CURRENT_GAMMA, CURRENT_WORDS = 8, ((0, 1), (1, 2))
SCALE = T.NP * (T.NP - 1)


#: Axes of current elementals by their ends, and their extents.
CURRENT_AXES = {"vv": ("b", "c"), "vp": ("e", "p", "c"), "pv": ("p", "c", "e"), "pp": ("p_l", "c_l", "p_r", "c_r")}
CURRENT_SIZES = {"b": T.NE, "e": T.NE, "p": T.NP, "p_l": T.NP, "p_r": T.NP, "c_l": T.NC, "c_r": T.NC, "t": T.LT}


def current_elementals(spark: SparkSession, sf: str) -> dict[tuple[str, str], Tensor]:
    """The displaced current's elementals between mode and point ends, all from one tree of words."""
    f, u, pts = field(spark, sf), gauge(spark, sf), T.points(spark, sf)
    words = [WORDS[w] for w, _ in CURRENT_WORDS]
    tree, moved = word_fields(f, u, words)
    coeff = F.broadcast(spark.createDataFrame([(i, c) for i, (_, c) in enumerate(CURRENT_WORDS)], "w long, coeff long"))
    frames = {"vv": elementals_v2v(f, tree, moved, words), "vp": elementals_v2p(pts, tree, moved, words), "pv": elementals_p2v(pts, tree, moved, words), "pp": elementals_p2p(pts, u, words)}
    out = {}
    for kind, frame in frames.items():
        axes = CURRENT_AXES[kind]
        rows = frame.join(coeff, "w").groupBy("t", *axes).agg(F.sum(F.col("coeff") * F.col("re")).alias("re"), F.sum(F.col("coeff") * F.col("im")).alias("im"))
        out["j", kind] = Tensor(rows, ("t", *axes), CURRENT_SIZES | {"c": T.NE if kind == "vv" else T.NC})
    return out


def with_gamma(elementals: Tensor, gammas: Tensor, n: int) -> Tensor:
    """(t, i, j, ends): a current's elementals times one spin matrix."""
    g = gammas.where(F.col("n") == n)
    g = Tensor(g.frame.drop("n"), ("i", "j"), {"i": T.NS, "j": T.NS}, 4, True)
    return contract([g, elementals], ("t", "i", "j", *[a for a in elementals.axes if a not in ("t", CFG)]))


def current_vertices(spark: SparkSession, sf: str) -> dict[tuple[str, str], Tensor]:
    return {k: with_gamma(x, T.gammas(spark), CURRENT_GAMMA) for k, x in current_elementals(spark, sf).items()}


def _j(name: str, ends: tuple[str, ...], source: str) -> str:
    coeff = " ".join(f"WHEN {w} THEN {c}" for w, c in CURRENT_WORDS)
    own = ", ".join(f"x.{e}" for e in ends)
    return f"{name} AS (SELECT x.t, gm.i AS l, gm.j AS r, {own}, CAST(sum(k * (gm.re * x.re - gm.im * x.im)) AS BIGINT) AS re, CAST(sum(k * (gm.re * x.im + gm.im * x.re)) AS BIGINT) AS im FROM (SELECT *, CASE w {coeff} END AS k FROM ({source}) WHERE w IN ({', '.join(str(w) for w, _ in CURRENT_WORDS)})) x, (SELECT * FROM g WHERE n = {CURRENT_GAMMA}) gm GROUP BY ALL)"


def current_daggers(spark: SparkSession, sf: str) -> dict[tuple[str, str], Tensor]:
    """The current at a source: gamma turned to its source dagger, elementals conjugated and their ends changed over, so that mode-point becomes point-mode."""
    out = {}
    for (_, kind), x in current_elementals(spark, sf).items():
        n = {"v": 1, "p": 2}[kind[0]]
        left, right = CURRENT_AXES[kind][:n], CURRENT_AXES[kind][n:]
        turned = x.conj().ordered("t", *right, *left).renamed("t", *CURRENT_AXES[kind[::-1]])
        out["j†", kind[::-1]] = with_gamma(turned, T.gammas(spark, True), CURRENT_GAMMA)
    return out


_TAUS = ("s", "t", "j", "i", "b", "a")
_W1, _W2 = (int(D.sampling_weight(VOLUME, T.NP, k) * SCALE) for k in (1, 2))
_HALF_V = flat_sql([("tau", _TAUS, ("s", "t", "j", "i", "b", "a"), False), ("jvv", ("t", "l", "r", "b", "c"), ("s", "i", "r", "a", "x"), False)], ("s", "t", "j", "b", "r", "x"))
_HALF_PV = flat_sql([("vs", ("s", "t", "j", "i", "b", "p", "c"), ("s", "t", "j", "i", "b", "p", "c"), False), ("jpv", ("t", "l", "r", "p", "c", "e"), ("s", "i", "r", "p", "c", "x"), False)], ("s", "t", "j", "b", "r", "x"))
_HALF_VP = flat_sql([("tau", _TAUS, ("s", "t", "j", "i", "b", "a"), False), ("jvp", ("t", "l", "r", "e", "p", "c"), ("s", "i", "r", "a", "q", "d"), False)], ("s", "t", "j", "b", "r", "q", "d"))
_HALF_PP = f"SELECT h.s, h.t, h.j, h.b, x.r, x.p_r AS q, x.c_r AS d, sum(CASE WHEN x.p_l = x.p_r THEN {_W1} ELSE {_W2} END * (h.re * x.re - h.im * x.im)) AS re, sum(CASE WHEN x.p_l = x.p_r THEN {_W1} ELSE {_W2} END * (h.re * x.im + h.im * x.re)) AS im FROM vs h JOIN jpp x ON x.t = h.s AND x.l = h.i AND x.p_l = h.p AND x.c_l = h.c GROUP BY ALL"
#: The meson vertex at t and the propagator from it back to the current: right end a mode, or a point.
_BACK_V = flat_sql([("vt", ("op", "t", "j", "k", "b", "c"), ("0", "t", "l", "j", "m", "b"), False), ("tau", _TAUS, ("t", "s", "r", "l", "x", "m"), False)], ("s", "t", "j", "b", "r", "x"))
_BACK_P = flat_sql([("vt", ("op", "t", "j", "k", "b", "c"), ("0", "t", "l", "j", "m", "b"), False), ("ps", ("s", "t", "j", "i", "p", "c", "a"), ("t", "s", "r", "l", "q", "d", "m"), False)], ("s", "t", "j", "b", "r", "q", "d"))


@query(
    "s6_current_diagram",
    f"""{BASE},
{T.POINTS_SQL},
{OVER},
{POINT},
{U_SQL},
{F_SQL},
{WF_SQL},
{LE_SQL},
{_j("jvv", ("b", "c"), V2V_SQL)},
{_j("jvp", ("e", "p", "c"), V2P_SQL)},
{_j("jpv", ("p", "c", "e"), P2V_SQL)},
{_j("jpp", ("p_l", "c_l", "p_r", "c_r"), P2P_SQL)},
hv AS (SELECT s, t, j, b, r, x, sum(re) AS re, sum(im) AS im FROM (SELECT s, t, j, b, r, x, {SCALE} * re AS re, {SCALE} * im AS im FROM ({_HALF_V}) UNION ALL SELECT s, t, j, b, r, x, {_W1} * re, {_W1} * im FROM ({_HALF_PV})) GROUP BY ALL),
hp AS (SELECT s, t, j, b, r, q, d, sum(re) AS re, sum(im) AS im FROM (SELECT s, t, j, b, r, q, d, {_W1} * re AS re, {_W1} * im AS im FROM ({_HALF_VP}) UNION ALL {_HALF_PP}) GROUP BY ALL),
bv AS ({_BACK_V}), bp AS ({_BACK_P}),
every AS (SELECT hv.s, hv.t, sum(hv.re * bv.re - hv.im * bv.im) AS re, sum(hv.re * bv.im + hv.im * bv.re) AS im FROM hv JOIN bv USING (s, t, j, b, r, x) GROUP BY ALL
  UNION ALL SELECT hp.s, hp.t, sum(hp.re * bp.re - hp.im * bp.im), sum(hp.re * bp.im + hp.im * bp.re) FROM hp JOIN bp USING (s, t, j, b, r, q, d) GROUP BY ALL)
SELECT s, t, CAST(sum(re) AS DOUBLE) / {SCALE} AS re, CAST(sum(im) AS DOUBLE) / {SCALE} AS im FROM every GROUP BY s, t""",
)
def s6_current(spark, sf):
    """A displaced current at s and a meson at t: mode-mode, mode-point, point-mode and point-point states in one plan."""
    q = Points(spark, sf)
    _, vertices = _tensors(spark, sf)
    props = {("q", "VV"): q.tau(), ("q", "VP"): q.vsp(), ("q", "PV"): q.psv()}
    d = D.from_matrix([[0, 1], [1, 0]], [0, 1], ["j", "pi"], [None, "q"])
    plan = D.plan_currents(d, [True, False], [0, 1], props, current_vertices(spark, sf) | {("pi", "vv"): vertices["pi"]}, {0: "s", 1: "t"}, VOLUME, T.NP, SCALE)
    return _estimated(plan, SCALE, ("s", "t"))


# operators of spin and link families ------------------------------------------------------------


def link_operators() -> list[tuple[int, int, int, int]]:
    """(op, gamma, place in WORDS, coefficient): a scalar of vector spins and one-link vectors, a pseudoscalar with a scalar of links, and the first row of a vector of corner links."""
    built = [
        O.link_insertion("rho", (0,), "T_1", -1, -1, "A_1"),
        O.link_insertion("pi", (0,), "A_1", 1, 1, "A_1"),
        O.link_insertion("pi", (0, 1), "T_2", 1, 1, "T_2")[:1],
    ]
    place = {w: i for i, w in enumerate(WORDS)}
    return [(op, n, place[w], c) for op, rows in enumerate(built) for n, w, c in O.whole_terms(rows[:1])[0]]


LINK_ELEM = "elem AS (SELECT lops.op, lops.gamma, x.t, x.b, x.c, CAST(sum(lops.coeff * x.re) AS BIGINT) AS re, CAST(sum(lops.coeff * x.im) AS BIGINT) AS im FROM lops JOIN v2v x ON x.w = lops.w GROUP BY ALL)"


def _link_sql() -> str:
    parts = [T.V_SQL, T.TAU_SQL, T.BW_SQL, T.G_SQL, T.GS_SQL, U_SQL, F_SQL, WF_SQL, f"v2v AS ({V2V_SQL})", T.values_sql("lops", "op, gamma, w, coeff", link_operators()), LINK_ELEM, VERT, SRCV, HALF1, HALF2]
    return "WITH " + ",\n".join(parts) + f",\ntp AS ({flat_sql([H1O, H2O], ('op_snk', 'op_src', 's', 't'), minus=True)})\nSELECT op_snk, op_src, (t - s + {T.LT}) % {T.LT} AS dt, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM tp GROUP BY ALL"


@query("o7_link_insertions", _link_sql())
def o7(spark, sf):
    """The correlator matrix of operators made of spin and link families, bound to displaced elementals."""
    b = Points(spark, sf)
    f, terms = field(spark, sf), link_operators()
    words = [WORDS[w] for w in sorted({w for _, _, w, _ in terms})]
    tree, moved = word_fields(f, gauge(spark, sf), words)
    at = {WORDS.index(w): i for i, w in enumerate(words)}
    rows = spark.createDataFrame([(op, n, at[w], c) for op, n, w, c in terms], "op long, gamma long, w long, coeff long")
    displaced = Tensor(elementals_v2v(f, tree, moved, words), ("w", "t", "b", "c"), {"w": len(words), "t": T.LT, "b": T.NE, "c": T.NE})
    elem = O.bind_links(rows, displaced)
    return C.relative(C.twopoint(b.tau(), b.v(elem), b.w(elem)), T.LT, ("op_snk", "op_src"))


# group elements on sums of diagrams ---------------------------------------------------------------

#: Rows of a vector meson, and weights of its three correlators; no rotation leaves the weighted sum as it is.
ROWS3, WEIGHTS3, TURN = (1, 2, 4), (1, 2, 5), "c3delta"


def vector_sum(weights: tuple[int, ...]) -> D.Expression:
    """Connected correlators of row k at time 1 with its dagger at time 0, by weight."""
    edges = (D.Edge(0, 1, "q"), D.Edge(1, 0, "q"))
    return D.simplify_sum({(D.Diagram(((0, f"rho.{k}†"), (1, f"rho.{k}")), edges),): Fraction(w) for k, w in enumerate(weights)})


def turned_sum(weights: tuple[int, ...], element: str) -> D.Expression:
    return D.acted(vector_sum(weights), D.irrep_image({"rho": "T_1"}, element, lambda rep: S.irrep(rep, -1)))


def _vector_sql() -> str:
    """The weights go with the axes that the rotation takes rows to."""
    m = S.vectors()[TURN]
    weights = [sum(int(m[n, k]) ** 2 * w for k, w in enumerate(WEIGHTS3)) for n in range(3)]
    ops = T.values_sql("ops", "op, gamma, coeff, deriv, mom", [(k, n, 1, 0, 0) for k, n in enumerate(ROWS3)])
    one = " UNION ALL ".join(f"SELECT s, t, {w} * re AS re, {w} * im AS im FROM ({cycle_sql([k, k], ['s', 't'])})" for k, w in enumerate(weights))
    return f"{CHAINS.replace(T.OP_SQL, ops)}\nSELECT s, t, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM ({one}) GROUP BY s, t"


@query("l10_group_action", _vector_sql())
def l10_action(spark, sf):
    """A weighted sum of a vector's correlators after a rotation, its vertices expanded by the irrep's matrix and merged, evaluated on the tables."""
    b = Points(spark, sf)
    terms = T.operator_terms(spark, [(k, n, 1, 0, 0) for k, n in enumerate(ROWS3)])
    v = b.v(C.operator_elementals(terms, b.phi()))
    rows = {k: Tensor(v.frame.where(F.col("op") == k).drop("op"), v.axes[1:], v.sizes, v.expected() / 4) for k in range(3)}
    vertices = {f"rho.{k}{mark}": x for k, x in rows.items() for mark in ("", "†")}
    e = {k: Fraction(w).limit_denominator(10**6) for k, w in turned_sum(WEIGHTS3, TURN).items()}
    return D.evaluate_sum(e, {"q": b.tau()}, vertices, {0: "s", 1: "t"}, ("s", "t"), T.kept)


# three-quark vertices --------------------------------------------------------------------------

#: Sites of fields of three colours; component c of site x is number (3 x + c) modulo the numbers of an embedding.
SITES3 = 11
#: The diquark's gamma, and the spin of the third quark.
DIQUARK, SPIN3 = 5, 0


@T.held
def three_colours(spark: SparkSession, sf: str) -> Tensor:
    """V(t, e, x, c): modes of three colours from the embeddings."""
    base = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    at = [(x, c, (3 * x + c) % T.NX) for x in range(SITES3) for c in range(3)]
    cells = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(c).cast("long").alias("c"), F.get("embedding", 2 * n).alias("p"), F.get("embedding", 2 * n + 1).alias("q")) for x, c, n in at])).alias("v")
    rows = base.select((F.col("vec_id") % T.LT).alias("t"), (F.floor(F.col("vec_id") / T.LT) % T.NE).cast("long").alias("e"), cells)
    part = {k: T.small(F.sum(F.round(F.col(f"v.{k}") * 64).cast("long")), 5) for k in "pq"}
    frame = rows.groupBy("t", "e", F.col("v.x").alias("x"), F.col("v.c").alias("c")).agg(part["p"].alias("re"), part["q"].alias("im"))
    return Tensor(frame, ("t", "e", "x", "c"), {"t": T.LT, "e": T.NE, "x": SITES3, "c": 3})


def nucleon_spins(spark: SparkSession) -> Tensor:
    rows = [(i, j, SPIN3, re, im) for n, i, j, re, im in T.gamma_rows() if n == DIQUARK]
    return Tensor(spark.createDataFrame(rows, "i long, j long, k long, re long, im long"), ("i", "j", "k"), {"i": 4, "j": 4, "k": 4}, 4, True)


def nucleon() -> D.Expression:
    """Both contractions of a baryon of flavours udu (the diquark is ud) at time 1 with its conjugate at time 0."""
    e = W.contract_quarks([W.Hadron("udu", "N", 1), W.Hadron("bar{udu}", "N", 0)])
    return D.simplify_sum(D.replace_vertices(e, {"0": "N", "1": "N†"}))


V3_SQL = f"""v3 AS (SELECT vec_id % {T.LT} AS t, (vec_id // {T.LT}) % {T.NE} AS e, n // 3 AS x, n % 3 AS c,
  {T.small_sql(f"sum(CAST(round(embedding[2 * (n % {T.NX}) + 1] * 64) AS BIGINT))", 5)} AS re, {T.small_sql(f"sum(CAST(round(embedding[2 * (n % {T.NX}) + 2] * 64) AS BIGINT))", 5)} AS im
  FROM embeddings, (SELECT CAST(range AS BIGINT) AS n FROM range({3 * SITES3})) GROUP BY 1, 2, 3, 4),
{T.values_sql("eps", "i, j, k, re, im", [(*p, (1 if (p[1] - p[0]) % 3 == 1 else -1), 0) for p in ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (2, 1, 0), (1, 0, 2))])},
tri AS ({flat_sql([("eps", ("i", "j", "k"), ("i", "j", "k"), False), *[("v3", ("t", "e", "x", "c"), ("t", e, "x", c), False) for e, c in (("a", "i"), ("b", "j"), ("c", "k"))]], ("t", "a", "b", "c"))})"""


@query("l10_colour_triplets", f"WITH {V3_SQL}\nSELECT t, a, b, c, re, im FROM tri WHERE a <> b AND b <> c AND a <> c")
def l10_triplets(spark, sf):
    """Antisymmetric elementals of three modes; the SQL sums over all colours and modes instead."""
    return B.triplets(three_colours(spark, sf)).frame


def _nucleon_sql() -> str:
    """Three propagators one after the other on the source vertex, then both contractions at the sink."""
    three = ("i", "j", "k", "a", "b", "c")
    walk, ends = "", ["i", "j", "k", "a", "b", "c"]
    source = "nb"
    for n in range(3):
        new = list(ends)
        new[n], new[n + 3] = f"x{n}", f"y{n}"
        own = ("s", *(["t"] if n else []))
        walk += f",\nw{n} AS ({flat_sql([(source, (*own, *ends), (*own, *ends), False), ('tau0', ('s', 't', 'j', 'i', 'b', 'a'), ('s', 't', f'x{n}', three[n], f'y{n}', three[n + 3]), False)], ('s', 't', *new))})"
        ends, source = new, f"w{n}"
    spins = ", ".join(f"({i}, {j}, {re}, {im})" for k, i, j, re, im in T.gamma_rows() if k == DIQUARK)
    nv = f"nv AS (SELECT t, sp.i, sp.j, CAST({SPIN3} AS BIGINT) AS k, a, b, c, CAST(sp.re * tri.re - sp.im * tri.im AS BIGINT) AS re, CAST(sp.re * tri.im + sp.im * tri.re AS BIGINT) AS im FROM tri, (VALUES {spins}) sp(i, j, re, im))"
    total = []
    for (d,), weight in sorted(nucleon().items()):
        # ends of the sink's quarks by the quark of the source they come from
        to = {e.q_src: e.q_snk for e in d.edges}
        labels = [""] * 6
        for src, snk in to.items():
            labels[snk], labels[snk + 3] = f"x{src}", f"y{src}"
        total.append(f"SELECT s, t, {int(weight)} * re AS re, {int(weight)} * im AS im FROM ({flat_sql([('w2', ('s', 't', *ends), ('s', 't', *ends), False), ('nv', ('t', *three), ('t', *labels), False)], ('s', 't'))})")
    return (
        f"WITH {T.TAU_SQL},\ntau0 AS (SELECT * FROM tau WHERE s = 0),\n{V3_SQL},\n{nv},\nnb AS (SELECT t AS s, i, j, k, a, b, c, re, -im AS im FROM nv WHERE t = 0){walk}\n"
        f"SELECT s, t, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM ({' UNION ALL '.join(total)}) GROUP BY s, t"
    )


def nucleon_plan(spark: SparkSession, sf: str, tau: Tensor) -> Plan:
    n = B.vertex(B.triplets(three_colours(spark, sf)), nucleon_spins(spark))
    return D.plan_sum(nucleon(), {"q": tau}, {"N": n, "N†": n.conj()}, {0: "s", 1: "t"}, ("s", "t"))


@query("l13_nucleon", _nucleon_sql())
def l13_nucleon(spark, sf):
    """A nucleon's two-point function from source time 0: vertices of three quarks, edges by quark number, both contractions in one plan."""
    tau = T.perambulators(spark, sf)
    tau = Tensor(tau.frame.where("s = 0"), tau.axes, tau.sizes, tau.expected() / T.LT)
    return nucleon_plan(spark, sf, tau).total(("s", "t"), T.kept)


_CURRENT_SQL = f"WITH {T.V_SQL},\n{T.POINTS_SQL},\n{U_SQL},\n{F_SQL},\n{WF_SQL},\n{LE_SQL},\n{T.G_SQL},\n{T.GS_SQL}"


def _dagger_sql(kind: str, source: str) -> str:
    """The dagger of a current elemental of a kind: columns by those of the turned kind."""
    n = {"v": 1, "p": 2}[kind[0]]
    ends = CURRENT_AXES[kind]
    columns = ", ".join(f"x.{a} AS {b}" for a, b in zip((*ends[n:], *ends[:n]), CURRENT_AXES[kind[::-1]], strict=True))
    coeff = " ".join(f"WHEN {w} THEN {c}" for w, c in CURRENT_WORDS)
    return f"SELECT x.t, gm.i, gm.j, {columns}, CAST(sum(k * (gm.re * x.re + gm.im * x.im)) AS BIGINT) AS re, CAST(sum(k * (gm.im * x.re - gm.re * x.im)) AS BIGINT) AS im FROM (SELECT *, CASE w {coeff} END AS k FROM ({source}) WHERE w IN ({', '.join(str(w) for w, _ in CURRENT_WORDS)})) x, (SELECT * FROM gs WHERE n = {CURRENT_GAMMA}) gm GROUP BY ALL"


def _current_query(kind: str, source: str) -> None:
    ends = CURRENT_AXES[kind]
    names = {"v": "mode", "p": "point"}

    @query(f"a15_displaced_{kind[0]}2{kind[1]}", f"{_CURRENT_SQL},\n{_j('jx', ends, source)}\nSELECT t, l AS i, r AS j, {', '.join(ends)}, re, im FROM jx")
    def ahead(spark, sf, kind=kind):
        return current_vertices(spark, sf)["j", kind].frame

    @query(f"a15_dagger_{kind[1]}2{kind[0]}", f"{_CURRENT_SQL}\n{_dagger_sql(kind, source)}")
    def back(spark, sf, kind=kind):
        return current_daggers(spark, sf)["j†", kind[::-1]].frame

    ahead.__doc__ = f"A displaced current from a {names[kind[0]]} to a {names[kind[1]]} end, with its spin matrix."
    back.__doc__ = f"The dagger of the {names[kind[0]]}-{names[kind[1]]} current."


for _kind, _source in (("vp", V2P_SQL), ("pv", P2V_SQL), ("pp", P2P_SQL)):
    _current_query(_kind, _source)


# points by seed -------------------------------------------------------------------------------

LATTICE = (T.LX, T.LY, T.LZ, T.LT)
SEEDS = "(SELECT o_custkey % 4 AS cfg, CAST(sum(o_orderkey) % 2147483647 AS BIGINT) AS seed FROM orders GROUP BY 1)"


@query("n15_seeded_points", P.sampled_points_sql(SEEDS, "cfg", LATTICE, T.NP))
def n15_seeded(spark, sf):
    """Points of four configurations, each by a seed of its own from its orders."""
    o = T.table(spark, sf, "orders")
    seeds = o.groupBy((F.col("o_custkey") % 4).alias("cfg")).agg((F.sum("o_orderkey") % 2147483647).cast("long").alias("seed"))
    return P.sampled_points(seeds, LATTICE, T.NP)

