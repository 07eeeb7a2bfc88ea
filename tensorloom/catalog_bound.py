"""Dimension tables of the symbolic layer joined with tensors: spin families, derivative schemes, momenta, rewrites and projections as values on the tables."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.catalog_correlators import H1O, H2O, HALF1, HALF2, SRCV, VERT, Points
from tensorloom.catalog_diagrams import TWO_PIONS, two_pions
from tensorloom.catalog_fields import EXT, FIELD, OL_SQL, WORDS, V2V_SQL, WF_SQL, derivative_elementals, derivative_sql, elementals_v2v, field, gauge, word_fields
from tensorloom.catalog_symbolic import MOM_SQL, SQL as SYMBOLIC, Q as TABLES, _momenta, _tensors
from tensorloom.functions import links as L
from tensorloom.functions import momenta as M
from tensorloom.operators import construction as O
from tensorloom.operators import correlators as C
from tensorloom.plans import diagrams as D
from tensorloom.plans import exact as E
from tensorloom.plans import symmetry as S
from tensorloom.plans.einsum import Tensor, contract, flat_sql
from tensorloom.sources import derived as T

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# loops of all spin matrices -----------------------------------------------------------------------


def spin_loops(spark: SparkSession, sf: str) -> DataFrame:
    """(n, t, re, im): tr gamma(n) phi(t) tau(t, t) for all sixteen matrices, bare elementals of zero momentum."""
    b = Points(spark, sf)
    phi = b.phi()
    phi = Tensor(phi.frame.where("deriv = 0 AND mom = 0").drop("deriv", "mom"), ("t", "b", "c"), phi.sizes)
    tau = b.tau()
    same = Tensor(tau.frame.where("s = t").drop("s"), ("t", "j", "i", "b", "a"), tau.sizes)
    return contract([T.gammas(spark), phi.renamed("t", "b", "c"), same.renamed("t", "j", "i", "c", "b")], ("n", "t")).frame


LOOPS = f"""{T.V_SQL},\n{T.TAU_SQL},\n{T.PHI_SQL},\n{T.G_SQL},
lp AS ({flat_sql([("g", ("n", "i", "j"), ("n", "i", "j"), False), ("phi", ("deriv", "mom", "t", "b", "c"), ("0", "0", "t", "b", "c"), False), ("tau", ("s", "t", "j", "i", "b", "a"), ("t", "t", "j", "i", "c", "b"), False)], ("n", "t"))})"""


@query("g2_labelled_loops", f"WITH {LOOPS},\nlab AS ({SYMBOLIC['g2_gamma_labels']})\nSELECT label, t, re, im FROM lp JOIN lab USING (n)")
def g2_loops(spark, sf):
    """Loops under the matrices' labels."""
    return spin_loops(spark, sf).join(F.broadcast(TABLES["g2_gamma_labels"](spark, sf)), "n").select("label", "t", "re", "im")


@query("g3_family_loops", f"WITH {LOOPS},\nfam AS ({SYMBOLIC['g3_gamma_families']})\nSELECT name, grp, parity, charge, hermitian, t, CAST(sum(re * re + im * im) AS BIGINT) AS weight FROM lp JOIN fam USING (n) GROUP BY ALL")
def g3_loops(spark, sf):
    """Each spin family's loops, squared and summed over its members."""
    families = F.broadcast(TABLES["g3_gamma_families"](spark, sf))
    return spin_loops(spark, sf).join(families, "n").groupBy("name", "grp", "parity", "charge", "hermitian", "t").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("weight"))


# derivative schemes -------------------------------------------------------------------------------

#: Paths of up to two letters, by their numbers.
PATHS2 = tuple(L.derivative_path(n) for n in range(13))
DERIVED = f"{FIELD},\n{OL_SQL},\n{derivative_sql('der', PATHS2)}"


def derived(spark: SparkSession, sf: str) -> DataFrame:
    return derivative_elementals(field(spark, sf), gauge(spark, sf), PATHS2)


@query("g6_derivative_operators", f"{DERIVED},\nsch AS ({SYMBOLIC['g6_derivative_schemes']})\nSELECT name, r, mom, t, b, c, CAST(sum(coeff * re) AS BIGINT) AS re, CAST(sum(coeff * im) AS BIGINT) AS im FROM der JOIN sch USING (path) WHERE mom < 2 GROUP BY ALL")
def g6_operators(spark, sf):
    """Elementals of the rows of every derivative scheme, first two momenta."""
    schemes = F.broadcast(TABLES["g6_derivative_schemes"](spark, sf))
    return derived(spark, sf).where("mom < 2").join(schemes, "path").groupBy("name", "r", "mom", "t", "b", "c").agg(F.sum(F.col("coeff") * F.col("re")).alias("re"), F.sum(F.col("coeff") * F.col("im")).alias("im"))


def insertion_terms() -> list[tuple[int, int, int, int]]:
    """(op, gamma, path, coefficient): first rows of a vector spin times one derivative, as scalar, and of a pseudoscalar times B."""
    out = []
    for op, (spins, scheme, rep) in enumerate((("rho", "nabla", "A_1"), ("pi", "B", "T_1"), ("b1", "nabla", "A_1"))):
        row = next(terms for r, k, terms in O.insertion(spins, scheme) if r == rep and k == 0)
        out += [(op, n, p, c) for n, p, c in O.whole_terms([row])[0]]
    return out


_INS_ELEM = "elem AS (SELECT o.op, o.gamma, d.t, d.b, d.c, CAST(sum(o.coeff * d.re) AS BIGINT) AS re, CAST(sum(o.coeff * d.im) AS BIGINT) AS im FROM ins o JOIN der d ON d.path = o.path AND d.mom = 0 GROUP BY ALL)"


@query(
    "o6_insertion_correlators",
    ",\n".join([DERIVED, T.TAU_SQL, T.BW_SQL, T.G_SQL, T.GS_SQL, T.values_sql("ins", "op, gamma, path, coeff", insertion_terms()), _INS_ELEM, VERT, SRCV, HALF1, HALF2])
    + f",\ntp AS ({flat_sql([H1O, H2O], ('op_snk', 'op_src', 's', 't'), minus=True)})\nSELECT op_snk, op_src, (t - s + {T.LT}) % {T.LT} AS dt, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM tp GROUP BY ALL",
)
def o6_correlators(spark, sf):
    """The correlator matrix of operators made of spin and derivative families."""
    b = Points(spark, sf)
    terms = spark.createDataFrame(insertion_terms(), "op long, gamma long, w long, coeff long")
    rows = derived(spark, sf).where("mom = 0").select(F.col("path").alias("w"), "t", "b", "c", "re", "im")
    elem = O.bind_links(terms, Tensor(rows, ("w", "t", "b", "c"), {"w": len(PATHS2), "t": T.LT, "b": T.NE, "c": T.NE}))
    return C.relative(C.twopoint(b.tau(), b.v(elem), b.w(elem)), T.LT, ("op_snk", "op_src"))


# words and momenta --------------------------------------------------------------------------------


@query("g8_conjugated_elementals", f"{FIELD},\n{WF_SQL}\n{V2V_SQL}")
def g8_elementals(spark, sf):
    """Every word's elementals from those of its conjugate word, turned and conjugated; the SQL takes the words themselves."""
    f = field(spark, sf)
    tree, moved = word_fields(f, gauge(spark, sf), WORDS)
    other = elementals_v2v(f, tree, moved, [L.conjugate(w) for w in WORDS])
    return other.select("w", "t", F.col("c").alias("b"), F.col("b").alias("c"), "re", (-F.col("im")).alias("im"))


def phased(spark: SparkSession, sf: str, momenta: DataFrame) -> DataFrame:
    """(mom, t, b, c, re, im): overlaps of modes with phases exp(2 pi i p x / L), momenta (mom, px, py, pz) a broadcast dimension."""
    f = field(spark, sf)
    right = f.select("t", "x", "y", "z", "c", F.col("e").alias("f"), F.col("re").alias("r2"), F.col("im").alias("i2"))
    both = f.join(right, ["t", "x", "y", "z", "c"]).groupBy("t", "x", "y", "z", F.col("e").alias("b"), F.col("f").alias("c")).agg(
        F.sum(F.col("re") * F.col("r2") + F.col("im") * F.col("i2")).alias("re"), F.sum(F.col("re") * F.col("i2") - F.col("im") * F.col("r2")).alias("im")
    )
    angle = 2 * np.pi * (F.col("px") * F.col("x") / EXT[0] + F.col("py") * F.col("y") / EXT[1] + F.col("pz") * F.col("z") / EXT[2])
    rows = both.join(F.broadcast(momenta))
    re = F.sum(F.cos(angle) * F.col("re") - F.sin(angle) * F.col("im"))
    im = F.sum(F.cos(angle) * F.col("im") + F.sin(angle) * F.col("re"))
    return rows.groupBy("mom", "px", "py", "pz", "t", "b", "c").agg(re.alias("re"), im.alias("im"))


_ANGLE = f"2 * pi() * (px * x / {EXT[0]}.0 + py * y / {EXT[1]}.0 + pz * z / {EXT[2]}.0)"
PHASED = f"""{FIELD},
ov0 AS (SELECT l.t, l.x, l.y, l.z, l.e AS b, r.e AS c, sum(l.re * r.re + l.im * r.im) AS re, sum(l.re * r.im - l.im * r.re) AS im FROM f l JOIN f r ON l.t = r.t AND l.x = r.x AND l.y = r.y AND l.z = r.z AND l.c = r.c GROUP BY ALL),
{MOM_SQL},
pe AS (SELECT mom, px, py, pz, t, b, c, sum(cos({_ANGLE}) * re - sin({_ANGLE}) * im) AS re, sum(cos({_ANGLE}) * im + sin({_ANGLE}) * re) AS im FROM ov0, m GROUP BY ALL)"""


@query("g10_phased_elementals", f"{PHASED}\nSELECT mom, t, b, c, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM pe")
def g10_elementals(spark, sf):
    """Elementals of the 27 momenta of the list."""
    out = phased(spark, sf, _momenta(spark))
    return out.select("mom", "t", "b", "c", *[(F.round(k, 4) + 0.0).alias(k) for k in ("re", "im")])


@query("g14_back_to_back_traces", f"{PHASED}\nSELECT a.px, a.py, a.pz, a.t, round(sum(a.re * z.re - a.im * z.im), 3) + 0.0 AS re, round(sum(a.re * z.im + a.im * z.re), 3) + 0.0 AS im FROM pe a JOIN pe z ON z.px = -a.px AND z.py = -a.py AND z.pz = -a.pz AND z.t = a.t AND z.b = a.c AND z.c = a.b GROUP BY ALL")
def g14_traces(spark, sf):
    """tr phi(p) phi(-p) of every momentum with its opposite."""
    p = phased(spark, sf, _momenta(spark)).drop("mom")
    q = p.select((-F.col("px")).alias("px"), (-F.col("py")).alias("py"), (-F.col("pz")).alias("pz"), "t", F.col("c").alias("b"), F.col("b").alias("c"), F.col("re").alias("r2"), F.col("im").alias("i2"))
    both = p.join(q, ["px", "py", "pz", "t", "b", "c"]).groupBy("px", "py", "pz", "t")
    return both.agg((F.round(F.sum(F.col("re") * F.col("r2") - F.col("im") * F.col("i2")), 3) + 0.0).alias("re"), (F.round(F.sum(F.col("re") * F.col("i2") + F.col("im") * F.col("r2")), 3) + 0.0).alias("im"))


def projected_momenta() -> list[tuple[str, int, int, int, int, int]]:
    """(irrep, row, momentum, coefficient): shell 1 projected onto A_1 (even) and onto all rows of T_1 (odd), exactly, in whole numbers."""
    out = []
    for rep, parity in (("A_1", 1), ("T_1", -1)):
        mats = E.exact_irrep(rep, parity)

        def act(g: str, p: tuple[int, int, int]) -> list[tuple[int, tuple[int, int, int]]]:
            return [(1, S.rotate(g, p))]

        firsts = E.projected([{p: E.Surd.of(1)} for p in M.shell(1)], mats, act)
        rows = E.whole(E.multiplet(firsts[E.independent(firsts)[0]], mats, act))
        out += [(rep, k, *p, c) for k, row in enumerate(rows) for p, c in sorted(row.items())]
    return out


#: By hand: the scalar is the sum over the shell; row k of the vector is an axis, ahead less back, up to one sign for all rows.
_PROJECTED = f"""{PHASED}
SELECT 'A_1' AS rep, CAST(0 AS BIGINT) AS row, t, b, c, round(abs(sum(re)), 3) AS re, round(abs(sum(im)), 3) AS im FROM pe WHERE px * px + py * py + pz * pz = 1 GROUP BY t, b, c
UNION ALL SELECT 'T_1', CAST(CASE WHEN px <> 0 THEN 0 WHEN py <> 0 THEN 1 ELSE 2 END AS BIGINT) AS row, t, b, c, round(abs(sum((px + py + pz) * re)), 3), round(abs(sum((px + py + pz) * im)), 3) FROM pe WHERE px * px + py * py + pz * pz = 1 GROUP BY 2, t, b, c"""


@query("y14_projected_elementals", _PROJECTED)
def y14_elementals(spark, sf):
    """Sizes of the parts of elementals of shell 1 projected onto irreps, rows connected by the group."""
    rows = spark.createDataFrame(projected_momenta(), "rep string, row long, qx long, qy long, qz long, coeff long")
    p = phased(spark, sf, _momenta(spark))
    both = p.join(F.broadcast(rows), (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy")) & (F.col("pz") == F.col("qz")))
    return both.groupBy("rep", "row", "t", "b", "c").agg(*[F.round(F.abs(F.sum(F.col("coeff") * F.col(k))), 3).alias(k) for k in ("re", "im")])


# rewrites of sums ---------------------------------------------------------------------------------


def _kept_value(spark: SparkSession, sf: str, e: D.Expression) -> DataFrame:
    props, vertices = _tensors(spark, sf)
    out = D.evaluate_sum(e, {"q": props["q"], "q_local": props["q"]}, {"pi": vertices["pi"], "pi†": vertices["b1"]}, {0: "s", 1: "t"}, ("s", "t"), T.kept)
    return out.select("s", "t", *[F.floor(F.col(c).cast("double") / 1000000).cast("double").alias(c) for c in ("re", "im")])


_KEPT = TWO_PIONS[: TWO_PIONS.index("every AS (")]
_MILLIONS = "floor(CAST(sum(re) AS DOUBLE) / 1000000) AS re, floor(CAST(sum(im) AS DOUBLE) / 1000000) AS im"


@query("f7_without_local_value", f"{_KEPT}every AS (SELECT s, t, CAST(re AS HUGEINT) * re - CAST(im AS HUGEINT) * im AS re, 2 * CAST(re AS HUGEINT) * im AS im FROM one)\nSELECT s, t, {_MILLIONS} FROM every GROUP BY s, t")
def f7_value(spark, sf):
    """The two-pion correlator without products that hold local propagators, on the tables."""
    return _kept_value(spark, sf, D.without_propagators(two_pions(), ["q_local"]))


@query("l9_replaced_value", f"{_KEPT}every AS (SELECT s, t, 3 * (CAST(re AS HUGEINT) * re - CAST(im AS HUGEINT) * im) AS re, 6 * CAST(re AS HUGEINT) * im AS im FROM one)\nSELECT s, t, {_MILLIONS} FROM every GROUP BY s, t")
def l9_value(spark, sf):
    """Vertices renamed to others and back, times changed over and back, a sum tripled: the value stays that of the kept terms."""
    e = D.without_propagators(two_pions(), ["q_local"])
    e = D.replace_vertices(D.replace_vertices(e, {"pi": "other", "pi†": "last"}), {"other": "pi", "last": "pi†"})
    e = D.replace_times(D.replace_times(e, {0: 7, 1: 8}), {7: 0, 8: 1})
    e = D.conjugated(D.conjugated(D.replace_propagators(e, {"q": "x"})))
    e = D.replace_propagators(e, {"x": "q"})
    return _kept_value(spark, sf, D.simplify_sum({k: Fraction(3) * c for k, c in e.items()}))
