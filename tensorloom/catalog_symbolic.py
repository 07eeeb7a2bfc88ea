"""Queries over the symbolic layer: spin matrices, words, momenta, scenes, diagrams, groups."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.catalog_correlators import BASE, LOOP, REL, Base
from tensorloom.functions import gamma as G
from tensorloom.functions import links as L
from tensorloom.functions import momenta as M
from tensorloom.operators import correlators as C
from tensorloom.operators import construction as O
from tensorloom.plans import diagrams as D
from tensorloom.plans import symmetry as S
from tensorloom.plans import wick as W
from tensorloom.plans.einsum import Tensor, flat_sql
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


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# spin matrices ------------------------------------------------------------------------------

GEN_SQL = T.values_sql("gen", "bit, i, j, p", [(b, i, j, p) for b, e in enumerate(G.GENERATORS) for (i, j), p in e.items()])


@query(
    "g1_gamma_matrices",
    f"""WITH RECURSIVE {GEN_SQL},
w(n, bit, i, j, p) AS (
  SELECT n.range, 0, k.range, k.range, 0 FROM range(16) n, range(4) k
  UNION ALL
  SELECT n, w.bit + 1, w.i, CASE WHEN (n >> w.bit) & 1 = 1 THEN gen.j ELSE w.j END, CASE WHEN (n >> w.bit) & 1 = 1 THEN (w.p + gen.p) % 4 ELSE w.p END
  FROM w JOIN gen ON gen.bit = w.bit AND gen.i = w.j WHERE w.bit < 4)
SELECT n, i, j, CAST(CASE p WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS BIGINT) AS re, CAST(CASE p WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS BIGINT) AS im FROM w WHERE bit = 4""",
)
def g1(spark, sf):
    return T.gammas(spark).frame


@query(
    "g1_gamma_algebra",
    f"WITH {T.G_SQL}\nSELECT a.n AS n, b.n AS m, a.i AS i, b.j AS j, CAST(sum(a.re * b.re - a.im * b.im) AS BIGINT) AS re, CAST(sum(a.re * b.im + a.im * b.re) AS BIGINT) AS im FROM g a JOIN g b ON a.j = b.i GROUP BY ALL",
)
def g1_products(spark, sf):
    """All products of two spin matrices, by join and sum."""
    from tensorloom.plans.einsum import contract

    g = T.gammas(spark)
    return contract([g.renamed("n", "i", "x"), g.renamed("m", "x", "j")], ("n", "m", "i", "j")).frame


@query("g2_gamma_labels")
def g2(spark, sf):
    return rows(spark, [(n, G.label(n)) for n in range(16)], "n long, label string")


SQL["g2_gamma_labels"] = """SELECT range AS n, CASE WHEN range = 0 THEN '' WHEN range = 15 THEN 'γ5' WHEN range = 7 THEN 'γ5γ4' WHEN range = 8 THEN 'γ4'
  WHEN range IN (14, 13, 11) THEN 'γ' || CASE range WHEN 14 THEN 1 WHEN 13 THEN 2 ELSE 3 END || 'γ5'
  WHEN range IN (1, 2, 4) THEN 'γ' || CASE range WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END
  WHEN range IN (9, 10, 12) THEN 'γ' || CASE range WHEN 9 THEN 1 WHEN 10 THEN 2 ELSE 3 END || 'γ4'
  ELSE 'γ' || CASE range WHEN 6 THEN 1 WHEN 5 THEN 2 ELSE 3 END || 'γ5γ4' END AS label FROM range(16)"""


@query(
    "g3_gamma_families",
    "SELECT CAST(n AS BIGINT) AS n, name, grp, CAST(p AS BIGINT) AS parity, CAST(c AS BIGINT) AS charge, CAST(h AS BIGINT) AS hermitian FROM (VALUES (0,'a0','A_1',1,1,1),(15,'pi','A_1',-1,1,-1),(7,'pi2','A_1',-1,1,1),(8,'b0','A_1',1,-1,1),(14,'a1','T_1',1,1,-1),(13,'a1','T_1',1,1,-1),(11,'a1','T_1',1,1,-1),(1,'rho','T_1',-1,-1,-1),(2,'rho','T_1',-1,-1,-1),(4,'rho','T_1',-1,-1,-1),(9,'rho2','T_1',-1,-1,1),(10,'rho2','T_1',-1,-1,1),(12,'rho2','T_1',-1,-1,1),(6,'b1','T_1',1,-1,-1),(5,'b1','T_1',1,-1,-1),(3,'b1','T_1',1,-1,-1)) v(n,name,grp,p,c,h)",
)
def g3(spark, sf):
    return rows(spark, [(n, f.name, f.group, f.parity, f.charge, f.hermitian) for f in G.FAMILIES for n in f.members], "n long, name string, grp string, parity long, charge long, hermitian long")


@query("g4_gamma_transform")
def g4(spark, sf):
    """(element, n, sign, image) for all elements under which the image is one matrix, and for `conj`."""
    out = [(g, n, *G.rotation_image(m, n)) for g, m in S.spinors().items() for n in range(16)]
    out += [("conj", n, *G.conjugate_image(n)) for n in range(16)]
    return rows(spark, out, "element string, n long, sign long, image long")


# derivatives, links, momenta ----------------------------------------------------------------


@query("g5_derivative_paths", "WITH RECURSIVE w(n, len, rest) AS (SELECT range, 0, range FROM range(121) UNION ALL SELECT n, len + 1, rest - CAST(pow(3, len) AS BIGINT) FROM w WHERE rest >= CAST(pow(3, len) AS BIGINT)), l AS (SELECT n, max(len) AS len, min(rest) AS rest FROM w GROUP BY n) SELECT n, len AS length, i.range AS place, rest // CAST(pow(3, len - 1 - i.range) AS BIGINT) % 3 AS axis FROM l, range(5) i WHERE i.range < len")
def g5(spark, sf):
    """Every letter of the first 121 paths."""
    data = [(n, len(p), i, x) for n in range(121) for p in [L.derivative_path(n)] for i, x in enumerate(p)]
    return rows(spark, data, "n long, length int, place long, axis long")


@query("g6_derivative_schemes", "SELECT name, CAST(r AS BIGINT) AS r, CAST(coeff AS BIGINT) AS coeff, CAST(path AS BIGINT) AS path FROM (VALUES ('1',0,1,0),('nabla',0,1,1),('nabla',1,1,2),('nabla',2,1,3),('B',0,1,11),('B',0,-1,9),('B',1,1,6),('B',1,-1,10),('B',2,1,7),('B',2,-1,5),('D',0,1,11),('D',0,1,9),('D',1,1,6),('D',1,1,10),('D',2,1,7),('D',2,1,5),('E',0,1,4),('E',0,-1,8),('E',1,-1,4),('E',1,-1,8),('E',1,2,12)) v(name,r,coeff,path)")
def g6(spark, sf):
    return rows(spark, [(n, i, c, p) for n, rs in L.DERIVATIVES.items() for i, r in enumerate(rs) for c, p in r], "name string, r long, coeff long, path long")


@query("g7_link_words", L.LINK_SQL + "SELECT CAST(idx AS BIGINT) AS idx, CAST(len AS BIGINT) AS length, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, CAST(dz AS BIGINT) AS dz FROM w")
def g7(spark, sf):
    """All words of up to 4 letters with their displacement."""
    return rows(spark, [(i, len(w), *L.displacement(w)) for i in range(L.words_shorter(5)) for w in [L.link_word(i)]], "idx long, length long, dx long, dy long, dz long")


#: The letters of a word beside its number, then the two maps letter by letter.
WORD_SQL = L.LINK_SQL.replace("w(idx, len, last, dx, dy, dz)", "w(idx, len, last, dx, dy, dz, word)").replace("SELECT 0, 0, -1, 0, 0, 0\n", "SELECT 0, 0, -1, 0, 0, 0, ''\n").replace("WHEN 5 THEN -1 ELSE 0 END\n  FROM", "WHEN 5 THEN -1 ELSE 0 END,\n    word || l\n  FROM")


@query("g8_link_conjugates", WORD_SQL + "SELECT CAST(idx AS BIGINT) AS idx, translate(reverse(word), '012345', '345012') AS conjugate, translate(word, '012345', '345012') AS inverse FROM w WHERE len < 4")
def g8(spark, sf):
    """Reversed and inverted words, by array functions on the letters."""
    base = rows(spark, [(i, list(L.link_word(i))) for i in range(L.words_shorter(4))], "idx long, word array<int>")
    turned = F.transform(F.reverse("word"), lambda x: (x + 3) % 6)
    inv = F.transform("word", lambda x: (x + 3) % 6)
    return base.select("idx", F.array_join(F.transform(turned, lambda x: x.cast("string")), "").alias("conjugate"), F.array_join(F.transform(inv, lambda x: x.cast("string")), "").alias("inverse"))


@query("g9_link_letter_maps")
def g9(spark, sf):
    """Images of the 6 letters under each of the 96 elements."""
    return rows(spark, [(g, a, b) for g, m in S.vectors().items() for a, b in enumerate(L.letter_map(m.tolist()))], "element string, letter long, image long")


PHASE = f"SELECT m.mom, x.range AS x, y.range AS y, z.range AS z, round(cos(2 * pi() * (px * x.range / {T.LX}.0 + py * y.range / {T.LY}.0 + pz * z.range / {T.LZ}.0)), 6) + 0.0 AS re, round(sin(2 * pi() * (px * x.range / {T.LX}.0 + py * y.range / {T.LY}.0 + pz * z.range / {T.LZ}.0)), 6) + 0.0 AS im FROM m, range({T.LX}) x, range({T.LY}) y, range({T.LZ}) z"
MOM_SQL = T.values_sql("m", "mom, px, py, pz", [(i, *p) for i, p in enumerate(M.momentum_list(3))])


def _sites(spark) -> DataFrame:
    n = T.LX * T.LY * T.LZ
    return spark.range(n).select((F.col("id") % T.LX).alias("x"), (F.floor(F.col("id") / T.LX) % T.LY).cast("long").alias("y"), F.floor(F.col("id") / (T.LX * T.LY)).cast("long").alias("z"))


def _momenta(spark, kind: int = 3) -> DataFrame:
    return rows(spark, [(i, *p) for i, p in enumerate(M.momentum_list(kind))], "mom long, px long, py long, pz long")


@query("g10_momentum_phases", f"WITH {MOM_SQL}\n{PHASE}")
def g10(spark, sf):
    angle = 2 * np.pi * (F.col("px") * F.col("x") / T.LX + F.col("py") * F.col("y") / T.LY + F.col("pz") * F.col("z") / T.LZ)
    both = _sites(spark).join(F.broadcast(_momenta(spark)))
    return both.select("mom", "x", "y", "z", (F.round(F.cos(angle), 6) + 0.0).alias("re"), (F.round(F.sin(angle), 6) + 0.0).alias("im"))


@query("g10_even_odd", f"SELECT t.range AS t, x.range AS x, y.range AS y, z.range AS z, (t.range + z.range + y.range + x.range) % 2 AS parity FROM range({T.LT}) t, range({T.LX}) x, range({T.LY}) y, range({T.LZ}) z")
def g10_cb(spark, sf):
    both = _sites(spark).join(F.broadcast(spark.range(T.LT).withColumnRenamed("id", "t")))
    return both.select("t", "x", "y", "z", F.pmod(F.col("t") + F.col("x") + F.col("y") + F.col("z"), F.lit(2)).alias("parity"))


@query("g12_momentum_lists", "WITH s AS (SELECT range - 3 AS v FROM range(7)) SELECT x.v AS px, y.v AS py, z.v AS pz, row_number() OVER (ORDER BY z.v, y.v, x.v) - 1 AS mom FROM s x, s y, s z WHERE x.v * x.v + y.v * y.v + z.v * z.v <= 9")
def g12(spark, sf):
    return _momenta(spark, 9).select("px", "py", "pz", "mom")


@query("g13_shells", "WITH s AS (SELECT range - 3 AS v FROM range(7)) SELECT x.v * x.v + y.v * y.v + z.v * z.v AS n, count(*) AS momenta, CAST(sum(x.v) AS BIGINT) AS sx FROM s x, s y, s z GROUP BY 1")
def g13(spark, sf):
    data = [(n, *p) for n in range(28) for p in M.shell(n)]
    return rows(spark, data, "n long, px long, py long, pz long").groupBy("n").agg(F.count(F.lit(1)).alias("momenta"), F.sum("px").alias("sx"))


@query("g14_back_to_back", "WITH s AS (SELECT range - 3 AS v FROM range(7)), m AS (SELECT x.v AS px, y.v AS py, z.v AS pz FROM s x, s y, s z WHERE x.v * x.v + y.v * y.v + z.v * z.v = 2) SELECT a.px, a.py, a.pz, b.px AS qx, b.py AS qy, b.pz AS qz FROM m a JOIN m b ON b.px = -a.px AND b.py = -a.py AND b.pz = -a.pz")
def g14(spark, sf):
    a = rows(spark, [p for p in M.shell(2)], "px long, py long, pz long")
    b = a.select(F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("pz").alias("qz"))
    return a.join(b, (F.col("qx") == -F.col("px")) & (F.col("qy") == -F.col("py")) & (F.col("qz") == -F.col("pz")))


@query("g15_levi_civita", "SELECT i.range AS i, j.range AS j, k.range AS k, (j.range - i.range) * (k.range - i.range) * (k.range - j.range) // 2 AS sign FROM range(3) i, range(3) j, range(3) k WHERE i.range <> j.range AND j.range <> k.range AND i.range <> k.range")
def g15(spark, sf):
    return rows(spark, [(*p, s) for p, s in S.levi_civita(3)], "i long, j long, k long, sign long")


# sampling scenes ----------------------------------------------------------------------------

PART = "WITH RECURSIVE w(n, rest, most, parts, len) AS (SELECT n.range, n.range, n.range, '', 0 FROM range(1, 9) n UNION ALL SELECT n, rest - k.range, k.range, CASE WHEN parts = '' THEN '' ELSE parts || ',' END || k.range, len + 1 FROM w, range(1, 9) k WHERE k.range <= rest AND k.range <= most)"


@query("s1_integer_partitions", f"{PART}\nSELECT n, parts, CAST(len AS BIGINT) AS len FROM w WHERE rest = 0")
def s1(spark, sf):
    return rows(spark, [(n, ",".join(map(str, p)), len(p)) for n in range(1, 9) for p in D.integer_partitions(n)], "n long, parts string, len long")


VOL, NPT = 16, 12
WEIGHT = f"CASE WHEN len > {NPT} THEN 0 ELSE round(list_product(list_transform(range(len), lambda i: ({VOL}.0 - i) / ({NPT}.0 - i))), 6) END"


@query("s2_sampling_weights", f"SELECT range AS k, CASE WHEN range > {NPT} THEN 0.0 WHEN range = 0 THEN 1.0 ELSE round(list_product(list_transform(range(range), lambda i: ({VOL}.0 - i) / ({NPT}.0 - i))), 6) END AS weight FROM range(15)")
def s2(spark, sf):
    """The product by an array fold."""
    k = spark.range(15).select(F.col("id").alias("k"))
    fold = F.aggregate(F.when(F.col("k") > 0, F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).otherwise(F.array().cast("array<bigint>")), F.lit(1.0), lambda a, i: a * (F.lit(float(VOL)) - i) / F.greatest(F.lit(float(NPT)) - i, F.lit(1.0)))
    return k.select("k", F.when(F.col("k") > NPT, F.lit(0.0)).otherwise(F.round(fold, 6)).alias("weight"))


@query("s3_point_scenes", f"{PART}\nSELECT n AS r, parts, {WEIGHT} AS weight FROM w WHERE rest = 0 AND n <= 5")
def s3(spark, sf):
    return rows(spark, [(r, ",".join(map(str, p)), round(float(w), 6)) for r in range(1, 6) for p, w in D.point_scenes(r, VOL, NPT)], "r long, parts string, weight double")


@query("s5_scene_constraints")
def s5(spark, sf):
    """Set partitions of the point positions of every state of a 2-cycle, with weights."""
    d = D.from_matrix([[0, 1], [1, 0]], [0, 1], ["a", "b"], [None, "q"])
    out = []
    for n, x in enumerate(D.expand_currents(d, [True, True])):
        for m, w in D.scene_constraints(D.sampling_groups(x, [0, 0]), VOL, NPT):
            text = ";".join(f"{v}{side}={g}.{i}" for (v, side), (g, i) in sorted(m.items()))
            out.append((n, "".join(a + b for a, b in x.states), text, float(w)))
    return rows(spark, out, "state long, ends string, points string, weight double")


# diagrams -----------------------------------------------------------------------------------

SHAPES = {
    "connected": ([[0, 1], [1, 0]], [0, 1]),
    "disconnected": ([[1, 0], [0, 1]], [0, 1]),
    "triangle": ([[0, 1, 0], [0, 0, 1], [1, 0, 0]], [0, 1, 1]),
    "box": ([[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]], [0, 1, 0, 1]),
    "crossed": ([[0, 0, 1, 0], [0, 0, 0, 1], [0, 1, 0, 0], [1, 0, 0, 0]], [0, 0, 1, 1]),
}


def shape(name: str, names: list[str] | None = None) -> D.Diagram:
    matrix, times = SHAPES[name]
    return D.from_matrix(matrix, times, names or ["pi", "b1", "pi", "b1"][: len(times)], [None, "q"])


@query("l2_operands")
def l2(spark, sf):
    return rows(spark, [(n, i, p.subscripts()) for n in SHAPES for i, p in enumerate(D.analyse(shape(n)))], "diagram string, part long, subscripts string")


@query("l3_current_states")
def l3(spark, sf):
    out = []
    for n in ("connected", "triangle"):
        d = shape(n)
        out += [(n, k, ",".join(a + b for a, b in x.states), ",".join(x.kinds)) for k, x in enumerate(D.expand_currents(d, [True] * len(d.vertices)))]
    return rows(spark, out, "diagram string, state long, ends string, kinds string")


SQL["l3_current_states"] = """WITH st(n, a) AS (VALUES (0, 'vv'), (1, 'vp'), (2, 'pv'), (3, 'pp'))
SELECT 'connected' AS diagram, CAST(x.n * 4 + y.n AS BIGINT) AS state, x.a || ',' || y.a AS ends, upper(y.a[2] || x.a[1] || ',' || x.a[2] || y.a[1]) AS kinds FROM st x, st y
UNION ALL SELECT 'triangle', CAST(x.n * 16 + y.n * 4 + z.n AS BIGINT), x.a || ',' || y.a || ',' || z.a, upper(y.a[2] || x.a[1] || ',' || z.a[2] || y.a[1] || ',' || x.a[2] || z.a[1]) FROM st x, st y, st z"""


@query("l8_canonical_diagrams")
def l8(spark, sf):
    """Canonical digests; equal diagrams with other vertex orders get equal ones."""
    out = []
    for n in SHAPES:
        d = shape(n)
        turned = D.Diagram(tuple(reversed(d.vertices)), tuple(D.Edge(len(d.vertices) - 1 - e.src, len(d.vertices) - 1 - e.snk, e.prop) for e in d.edges))
        out.append((n, len(D.simplify(d)), "".join(x.digest[:8] for x in D.simplify(d)), D.simplify(d) == D.simplify(turned)))
    return rows(spark, out, "diagram string, parts long, digest string, stable boolean")


#: A vertex times the propagator that arrives at it, a matrix from (left spin, left mode) to (source spin, source mode).
CHAIN = "ch AS (" + flat_sql([("vt", ("op", "t", "j", "k", "b", "c"), ("op", "t", "j", "k", "b", "c"), False), ("tau", ("s", "t", "j", "i", "b", "a"), ("s", "t", "k", "i", "c", "a"), False)], ("op", "s", "t", "j", "b", "i", "a")) + ")"
CH = ("op", "s", "t", "j", "b", "i", "a")


def cycle_sql(ops: list[int], times: list[str]) -> str:
    """A single closed loop through vertices 0 -> 1 -> ... -> 0: vertex k takes the propagator from its predecessor."""
    n = len(ops)
    terms = []
    for k in range(n):
        before = (k - 1) % n
        terms.append(("ch", CH, (str(ops[k]), times[before], times[k], f"j{k}", f"b{k}", f"j{before}", f"b{before}"), False))
    return flat_sql(terms, ("s", "t"))


def _tensors(spark, sf) -> tuple[dict, dict]:
    b = Base(spark, sf)
    v = b.v()

    def at(op: int) -> Tensor:
        return Tensor(v.frame.where(F.col("op") == op).drop("op"), v.axes[1:], v.sizes, v.expected() / 4)

    return {"q": b.tau()}, {"pi": at(0), "b1": at(1)}


def _value(spark, sf, name: str, names: list[str] | None = None) -> DataFrame:
    props, vertices = _tensors(spark, sf)
    return D.evaluate(shape(name, names), props, vertices, {0: "s", 1: "t"}).frame.select("s", "t", "re", "im")


CHAINS = f"{BASE},\n{CHAIN}"


@query("a22_diagram_connected", f"{CHAINS}\n{cycle_sql([0, 1], ['s', 't'])}")
def a22_connected(spark, sf):
    return _value(spark, sf, "connected")


@query("a22_diagram_disconnected", f"{BASE},\n{LOOP}\nSELECT x.t AS s, y.t, CAST(x.re * y.re - x.im * y.im AS BIGINT) AS re, CAST(x.re * y.im + x.im * y.re AS BIGINT) AS im FROM lp x, lp y WHERE x.op = 0 AND y.op = 1")
def a22_disconnected(spark, sf):
    return _value(spark, sf, "disconnected")


@query("a22_diagram_triangle", f"{CHAINS}\n{cycle_sql([0, 1, 0], ['s', 't', 't'])}")
def a22_triangle(spark, sf):
    return _value(spark, sf, "triangle")


#: Entries of a box exceed 64 bits at large scales, so it has doubles and relative rounding.
@query("a22_diagram_box", f"{CHAINS},\nc2 AS ({flat_sql([('ch', CH, ('0', 't', 's', 'j', 'b', 'x', 'y'), False), ('ch', CH, ('1', 's', 't', 'x', 'y', 'i', 'a'), False)], ('s', 't', 'j', 'b', 'i', 'a'))})\nSELECT s, t, floor(re / 1000000) AS re, floor(im / 1000000) AS im FROM (SELECT l.s, l.t, CAST(sum(CAST(l.re AS HUGEINT) * r.re - CAST(l.im AS HUGEINT) * r.im) AS DOUBLE) AS re, CAST(sum(CAST(l.re AS HUGEINT) * r.im + CAST(l.im AS HUGEINT) * r.re) AS DOUBLE) AS im FROM c2 l JOIN c2 r ON l.s = r.s AND l.t = r.t AND l.i = r.j AND l.a = r.b AND l.j = r.i AND l.b = r.a GROUP BY ALL)")
def a22_box(spark, sf):
    """A four-vertex loop; exact decimals in the last product, then millions."""
    props, vertices = _tensors(spark, sf)
    d = shape("box")
    frame = D.evaluate(d, props, vertices, {0: "s", 1: "t"}).frame
    return frame.select("s", "t", F.floor(F.col("re").cast("double") / 1000000).cast("double").alias("re"), F.floor(F.col("im").cast("double") / 1000000).cast("double").alias("im"))


@query("a23_diagram_fixed_times", f"{CHAINS}\nSELECT s, t, re, im FROM ({cycle_sql([0, 1], ['s', 't'])}) WHERE s = 2 AND t = 5")
def a23(spark, sf):
    """The same at single times; the filter reaches the scans of the propagators."""
    props, vertices = _tensors(spark, sf)
    props = {"q": props["q"].where("(s = 2 AND t = 5) OR (s = 5 AND t = 2)")}
    return D.evaluate(shape("connected"), props, vertices, {0: "s", 1: "t"}).frame.where("s = 2 AND t = 5").select("s", "t", "re", "im")


@query("f6_pruned_diagrams")
def f6(spark, sf):
    """What stays of a contracted sum without local propagators, and with expected ones only."""
    e = W.contract_quarks([W.Hadron("uu", "a", 0), W.Hadron("dd", "b", 1), W.Hadron("ud", "c", 1)] + [W.Hadron("du", "d", 0)])
    kept = D.without_propagators(e, ["q_local"])
    fine = D.without_unexpected(e, lambda p: p != "s")
    return rows(spark, [("all", len(e)), ("no_local", len(kept)), ("expected", len(fine))], "rule string, terms long")


@query("l6_wick_contractions")
def l6(spark, sf):
    cases = {"mesons": ["ud", "du"], "neutral": ["uu", "dd"], "same": ["uu", "uu"], "baryon": ["uds", "bar{uds}"], "proton": ["uud", "bar{uud}"], "four": ["ud", "ud", "du", "du"]}
    out = []
    for name, flavours in cases.items():
        e = W.contract_quarks([W.Hadron(f, f"h{i}", i % 2 if name != "four" else i // 2) for i, f in enumerate(flavours)])
        for (d,), c in sorted(e.items()):
            out.append((name, float(c), " ".join(f"{x.src}.{x.q_src}>{x.snk}.{x.q_snk}:{x.prop}" for x in d.edges)))
    return rows(spark, out, "case string, coeff double, edges string")


@query("l7_flavours", "SELECT * FROM (VALUES ('ud', 'du', 0), ('uds', 'bar{uds}', 1), ('bar{uds}', 'uds', -1), ('us', 'su', 0)) v(flavour, conjugate, baryon)")
def l7(spark, sf):
    return rows(spark, [(f, W.Hadron(f).conjugate().flavour, W.Hadron(f).baryon) for f in ("ud", "uds", "bar{uds}", "us")], "flavour string, conjugate string, baryon int")


def pion_matrix() -> dict:
    pi = [(Fraction(1), [W.Hadron("ud", "pi")])]
    b1 = [(Fraction(1), [W.Hadron("ud", "b1")])]
    return W.correlator([[pi, b1], [pi, b1]])


@query("l11_correlator_terms")
def l11(spark, sf):
    out = [(*k, float(c), "*".join(d.digest[:12] for d in ds)) for k, e in pion_matrix().items() for ds, c in e.items()]
    return rows(spark, out, "sink long, source long, coeff double, diagrams string")


@query("l13_correlator_values", f"{CHAINS}\nSELECT x.s, x.t, -x.re AS re, -x.im AS im FROM ({cycle_sql([0, 0], ['s', 't'])}) x")
def l13(spark, sf):
    """A contracted sum evaluated: each different diagram once; here the pion's."""
    props, vertices = _tensors(spark, sf)
    e = W.contract_quarks([W.Hadron("ud", "pi", 0), W.Hadron("du", "pi", 1)])
    e = D.replace_vertices(D.simplify_sum(e), {"0": "pi", "1": "pi"})
    out = D.evaluate_sum(e, props, vertices, {0: "s", 1: "t"}, ("s", "t"))
    return out.select("s", "t", F.col("re").cast("long").alias("re"), F.col("im").cast("long").alias("im"))


@query("l14_dot_text")
def l14(spark, sf):
    return rows(spark, [(n, D.to_dot(shape(n))) for n in SHAPES], "diagram string, dot string")


# operators ----------------------------------------------------------------------------------


@query("o1_merged_terms", "SELECT l_linenumber % 4 AS gamma, l_partkey % 5 AS deriv, CAST(sum(CAST(floor(l_quantity) AS BIGINT) - 25) AS BIGINT) AS coeff FROM lineitem GROUP BY ALL HAVING coeff <> 0")
def o1(spark, sf):
    """Equal terms merged, zeros dropped."""
    t = T.table(spark, sf, "lineitem").select((F.col("l_linenumber") % 4).alias("gamma"), (F.col("l_partkey") % 5).alias("deriv"), (F.floor("l_quantity").cast("long") - 25).alias("coeff"))
    return O.merge_terms(t, ["gamma", "deriv"])


@query("o3_operator_signs", "SELECT * FROM (SELECT n.range AS gamma, CASE WHEN n.range IN (5, 13) THEN -1 ELSE 1 END AS sign FROM range(16) n)")
def o3(spark, sf):
    terms = spark.range(16).select(F.col("id").alias("gamma"), F.lit(1).alias("coeff"))
    return O.signed(terms).select("gamma", F.col("coeff").alias("sign"))


@query("o5_momentum_lookup", f"WITH {MOM_SQL}\nSELECT mom, px, py, pz FROM m WHERE px = 0 AND py = 1 AND pz = -1")
def o5(spark, sf):
    return O.bind_momentum(_momenta(spark), (0, 1, -1))


@query("o6_insertion_rows")
def o6(spark, sf):
    """Rows of gamma families times derivative families, by Clebsch-Gordan coefficients."""
    out = []
    for family in ("pi", "rho", "b1"):
        for deriv in ("1", "nabla", "B"):
            for rep, n, terms in O.insertion(family, deriv):
                out += [(family, deriv, rep, n, g, p, round(float(c.real), 6), round(float(c.imag), 6)) for g, p, c in terms]
    return rows(spark, out, "family string, deriv string, rep string, r long, gamma long, path long, re double, im double")


# groups -------------------------------------------------------------------------------------


def _element_rows() -> list[tuple]:
    index = {k: i for i, k in enumerate(S.NAMES)}
    return [(index[k], i, j, int(m[i, j])) for k, m in S.vectors().items() if "r" not in k.replace("inv", "").split("c")[0] for i in range(3) for j in range(3) if m[i, j]]


EL_SQL = T.values_sql("el", "g, i, j, v", _element_rows())


@query(
    "y1_cayley_table",
    f"""WITH {EL_SQL},
sig AS (SELECT g, string_agg(i || ',' || j || ',' || v, ';' ORDER BY i, j) AS s FROM el GROUP BY g),
pr AS (SELECT a.g AS g, b.g AS h, a.i, b.j, a.v * b.v AS v FROM el a JOIN el b ON a.j = b.i),
ps AS (SELECT g, h, string_agg(i || ',' || j || ',' || v, ';' ORDER BY i, j) AS s FROM pr GROUP BY g, h)
SELECT ps.g, ps.h, sig.g AS gh FROM ps JOIN sig USING (s)""",
)
def y1(spark, sf):
    """Products of the 48 elements without 2 pi: a join of signed permutation matrices, matched by their entries."""
    el = rows(spark, _element_rows(), "g long, i long, j long, v long")
    b = el.select(F.col("g").alias("h"), F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("v2"))
    prod = el.join(b, F.col("j") == F.col("k")).select("g", "h", "i", F.col("j2").alias("j"), (F.col("v") * F.col("v2")).alias("v"))
    entry = F.struct("i", "j", "v")
    sig = el.groupBy("g").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("s")).withColumnRenamed("g", "gh")
    made = prod.groupBy("g", "h").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("s"))
    return made.join(F.broadcast(sig), "s").select("g", "h", "gh")


@query("y1_double_cover")
def y1_cover(spark, sf):
    return rows(spark, [(a, b, c) for (a, b), c in S.cayley().items()], "g string, h string, gh string")


@query("y2_irrep_matrices")
def y2(spark, sf):
    """Non-zero entries of all irreps of the 96 elements, even and odd."""
    out = [(r, p, g, int(i), int(j), float(m[i, j].real), float(m[i, j].imag)) for r in S.GENERATORS for p in (1, -1) for g, m in S.irrep(r, p).items() for i, j in zip(*np.nonzero(m), strict=True)]
    return rows(spark, out, "rep string, parity int, element string, i int, j int, re double, im double")


@query("y2_characters", "SELECT rep, CAST(norm AS DOUBLE) AS norm FROM (VALUES ('A_1', 1.0), ('A_2', 1.0), ('E', 1.0), ('T_1', 1.0), ('T_2', 1.0), ('G_1', 1.0), ('G_2', 1.0), ('H', 1.0)) v(rep, norm)")
def y2_characters(spark, sf):
    """Each irrep's mean |character|^2 over the group is 1."""
    chars = rows(spark, [(r, g, float(np.trace(m).real), float(np.trace(m).imag)) for r in S.GENERATORS for g, m in S.irrep(r).items()], "rep string, element string, re double, im double")
    return chars.groupBy("rep").agg(F.round(F.avg(F.col("re") ** 2 + F.col("im") ** 2), 6).alias("norm"))


@query("y3_little_irreps")
def y3(spark, sf):
    out = [("%d,%d,%d" % ref, r, g, int(i), int(j), float(m[i, j].real), float(m[i, j].imag)) for ref in S.LITTLE for r, mats in S.little_irreps(ref).items() for g, m in mats.items() for i, j in zip(*np.nonzero(m), strict=True)]
    return rows(spark, out, "momentum string, rep string, element string, i int, j int, re double, im double")


@query("y6_little_groups", f"WITH {EL_SQL}, m(p, x, y, z) AS (VALUES ('0,0,1', 0, 0, 1), ('0,1,1', 0, 1, 1), ('1,1,1', 1, 1, 1), ('2,1,1', 2, 1, 1), ('0,1,2', 0, 1, 2)), im AS (SELECT p, g, sum(CASE WHEN i = 0 THEN v * CASE j WHEN 0 THEN x WHEN 1 THEN y ELSE z END ELSE 0 END) AS a, sum(CASE WHEN i = 1 THEN v * CASE j WHEN 0 THEN x WHEN 1 THEN y ELSE z END ELSE 0 END) AS b, sum(CASE WHEN i = 2 THEN v * CASE j WHEN 0 THEN x WHEN 1 THEN y ELSE z END ELSE 0 END) AS c FROM m, el GROUP BY p, g) SELECT im.p AS momentum, g FROM im JOIN m ON m.p = im.p WHERE a = x AND b = y AND c = z")
def y6(spark, sf):
    index = {k: i for i, k in enumerate(S.NAMES)}
    plain = {r[0] for r in _element_rows()}
    return rows(spark, [("%d,%d,%d" % ref, index[g]) for ref in S.LITTLE for g in S.little_group(ref) if index[g] in plain], "momentum string, g long")


@query("y7_simplified_momenta")
def y7(spark, sf):
    return rows(spark, [("%d,%d,%d" % p, "%d,%d,%d" % S.simplified_momentum(p)) for p in M.momentum_list(3) + [(2, 1, 1), (1, 2, 2), (0, 1, 2), (0, 3, 3)]], "momentum string, simplified string")


@query("y8_wigner_rotations")
def y8(spark, sf):
    return rows(spark, [("%d,%d,%d" % p, g, S.wigner_rotation(p, g)) for p in ((0, 0, 1), (1, 0, 0), (0, 1, 1), (1, -1, 1)) for g in S.NAMES], "momentum string, element string, rotation string")


@query("y11_subduction")
def y11(spark, sf):
    return rows(spark, [("%d,%d,%d" % ref, a, p, b, n) for ref in S.LITTLE for (a, p, b), n in S.subduction(ref).items()], "momentum string, rep string, parity int, little string, n int")


@query("y14_projected_operators")
def y14(spark, sf):
    """Pairs of back-to-back momenta of shell 1 projected onto irreps: first rows and their number."""
    ps = M.shell(1)
    at = {p: i for i, p in enumerate(ps)}

    def action(g: str) -> np.ndarray:
        m = np.zeros((6, 6))
        for p, i in at.items():
            m[at[S.rotate(g, p)], i] = 1
        return m

    out = []
    for rep in ("A_1", "A_2", "E", "T_1", "T_2"):
        for parity in (1, -1):
            rows_ = list(S.project(S.irrep(rep, parity), action).T)
            for n, k in enumerate(S.independent(rows_)):
                out += [(rep, parity, n, "%d,%d,%d" % ps[i], round(float(rows_[k][i].real), 6)) for i in range(6) if abs(rows_[k][i]) > 1e-7]
    return rows(spark, out, "rep string, parity int, n int, momentum string, coeff double")


@query("y17_diagonalised", f"{REL},\nh AS (SELECT sum(re) FILTER (WHERE op_snk = 0 AND op_src = 0) AS a, sum(re) FILTER (WHERE op_snk = 1 AND op_src = 1) AS d, (coalesce(sum(re) FILTER (WHERE op_snk = 0 AND op_src = 1), 0) + coalesce(sum(re) FILTER (WHERE op_snk = 1 AND op_src = 0), 0)) / 2.0 AS br, (coalesce(sum(im) FILTER (WHERE op_snk = 0 AND op_src = 1), 0) - coalesce(sum(im) FILTER (WHERE op_snk = 1 AND op_src = 0), 0)) / 2.0 AS bi FROM rel WHERE dt = 0)\nSELECT CAST(n AS INTEGER) AS n, round((a + d) / 2.0 + (2 * n - 1) * sqrt(pow((a - d) / 2.0, 2) + br * br + bi * bi), 2) AS value FROM h, (VALUES (0), (1)) v(n)")
def y17(spark, sf):
    """Eigenvalues of the Hermitian part of the matrix of operator correlators at dt = 0, two operators."""
    b = Base(spark, sf)
    elem = b.elem().where("op < 2")
    got = C.relative(C.twopoint(b.tau(), b.v(elem), b.w(elem)), T.LT, ("op_snk", "op_src")).where("dt = 0").collect()
    c = np.zeros((2, 2), complex)
    for r in got:
        c[r.op_snk, r.op_src] = complex(r.re, r.im)
    return rows(spark, [(i, round(float(x), 2)) for i, x in enumerate(S.diagonalise((c + c.conj().T) / 2)[1])], "n int, value double")


@query("y18_link_orbits")
def y18(spark, sf):
    """Orbits of words of up to 3 letters and how many first rows each irrep has on them."""
    out = []
    for w, orbit in S.link_orbits(3).items():
        for rep in ("A_1", "A_2", "E", "T_1", "T_2"):
            for parity in (1, -1):
                for charge in (1, -1):
                    n = len(S.project_links(w, rep, parity, charge))
                    if n:
                        out.append(("".join(map(str, w)), len(orbit), rep, parity, charge, n))
    return rows(spark, out, "word string, size int, rep string, parity int, charge int, n int")


@query("y20_two_particle_bases")
def y20(spark, sf):
    return rows(spark, O.two_particle_rows(), "case string, j int, m int, px int, py int, pz int, sa int, sb int, re double, im double")


# more of the small operators ----------------------------------------------------------------


@query("f2_point_prefix", f"WITH {T.V_SQL},\n{T.POINTS_SQL}\nSELECT v.t, v.e, pts.p, v.x % {T.NC} AS c, v.re, v.im FROM v JOIN pts ON pts.t = v.t AND pts.x + {T.LX} * (pts.y + {T.LY} * pts.z) = v.x // {T.NC} WHERE p < 5")
def f2(spark, sf):
    """Overlaps of the first 5 points."""
    from tensorloom.operators.correlators import overlap

    return overlap(T.eigenvectors(spark, sf), T.points(spark, sf).where("p < 5"), T.LX, T.LY, T.NC).frame


@query("f7_nonlocal_terms")
def f7(spark, sf):
    """Contracted sums with and without the products that hold a local propagator."""
    out = []
    for name, flavours in (("neutral", ["uu", "dd"]), ("charged", ["ud", "du"]), ("mixed", ["uu", "uu"])):
        e = W.contract_quarks([W.Hadron(f, f"h{i}", i) for i, f in enumerate(flavours)])
        out.append((name, len(e), len(D.without_propagators(e, ["q_local"]))))
    return rows(spark, out, "case string, terms int, left int")


SQL["f7_nonlocal_terms"] = "SELECT * FROM (VALUES ('neutral', 1, 0), ('charged', 1, 1), ('mixed', 2, 1)) v(\"case\", terms, \"left\")"


@query("g11_displacement_phases", f"WITH {MOM_SQL}, {T.values_sql('dsp', 'disp, dx, dy, dz', [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, -1, 0, 0), (5, 0, -1, 0), (6, 0, 0, -1)])}\nSELECT mom, disp, round(cos(pi() * (px * dx / {T.LX}.0 + py * dy / {T.LY}.0 + pz * dz / {T.LZ}.0)), 6) + 0.0 AS re, round(sin(pi() * (px * dx / {T.LX}.0 + py * dy / {T.LY}.0 + pz * dz / {T.LZ}.0)), 6) + 0.0 AS im FROM m, dsp")
def g11(spark, sf):
    """exp(2 pi i p d / 2L): half the phase of a displacement."""
    from tensorloom.operators.points import displacements

    angle = np.pi * (F.col("px") * F.col("dx") / T.LX + F.col("py") * F.col("dy") / T.LY + F.col("pz") * F.col("dz") / T.LZ)
    both = _momenta(spark).join(F.broadcast(displacements(spark)))
    return both.select("mom", "disp", (F.round(F.cos(angle), 6) + 0.0).alias("re"), (F.round(F.sin(angle), 6) + 0.0).alias("im"))


SHELL_OPS = tuple((0, 15, 1, 0, m) for m in (1, 2))


@query("a11_shell_twopoint")
def a11_twopoint(spark, sf):
    """The pion summed over the momenta of a shell, each with weight 1 / sqrt(number)."""
    from tensorloom.catalog_correlators import Base
    from tensorloom.operators import correlators as C

    b = Base(spark, sf)
    elem = C.operator_elementals(T.operator_terms(spark, SHELL_OPS), b.phi())
    c = C.relative(C.twopoint(b.tau(), b.v(elem), b.w(elem)), T.LT, ("op_snk", "op_src"))
    return c.select("dt", (F.col("re") / len(SHELL_OPS)).alias("re"), (F.col("im") / len(SHELL_OPS)).alias("im"))


def _shell_sql() -> str:
    from tensorloom.catalog_correlators import REL

    return REL.replace(T.OP_SQL, T.values_sql("ops", "op, gamma, coeff, deriv, mom", list(SHELL_OPS))) + "\nSELECT dt, re / 2.0 AS re, im / 2.0 AS im FROM rel"


SQL["a11_shell_twopoint"] = _shell_sql()


@query("l5_sampling_groups")
def l5(spark, sf):
    """Which point positions of each state of a triangle draw from one sample, for two groups of vertices."""
    d = shape("triangle")
    out = []
    for k, x in enumerate(D.expand_currents(d, [True, True, False])):
        for g, positions in sorted(D.sampling_groups(x, [0, 1, 1]).items()):
            out += [(k, g, v, side) for v, side in positions]
    return rows(spark, out, "state int, grp int, vertex int, side string")


@query("l10_transformed_sums")
def l10(spark, sf):
    """Conjugating twice, renaming there and back, moving times there and back give the sum itself."""
    e = D.simplify_sum(W.contract_quarks([W.Hadron("ud", "a", 0), W.Hadron("ud", "b", 0), W.Hadron("du", "c", 1), W.Hadron("du", "d", 1)]))
    same = {
        "conjugate": D.conjugated(D.conjugated(e)) == e,
        "vertices": D.replace_vertices(D.replace_vertices(e, {"0": "x"}), {"x": "0"}) == e,
        "times": D.replace_times(D.replace_times(e, {1: 9}), {9: 1}) == e,
        "propagators": D.replace_propagators(D.replace_propagators(e, {"q": "w"}), {"w": "q"}) == e,
    }
    return rows(spark, sorted(same.items()), "op string, same boolean")


SQL["l10_transformed_sums"] = "SELECT * FROM (VALUES ('conjugate', true), ('vertices', true), ('times', true), ('propagators', true)) v(op, same)"


@query("o2_transformed_terms")
def o2(spark, sf):
    """Rows (gamma, link word) under each element: a join of the two transformation tables."""
    words = rows(spark, [(i, list(L.link_word(i))) for i in range(1, 37)], "word long, letters array<int>")
    maps = rows(spark, [(g, list(L.letter_map(m.tolist()))) for g, m in S.vectors().items()], "element string, map array<int>")
    gam = rows(spark, [(g, n, *G.rotation_image(m, n)) for g, m in S.spinors().items() for n in (1, 2, 4, 15)], "element string, gamma long, sign long, image long")
    moved = words.join(F.broadcast(maps)).select("word", "element", F.array_join(F.transform("letters", lambda x: F.element_at("map", x + 1).cast("string")), "").alias("moved"))
    return moved.join(F.broadcast(gam), "element").select("element", "gamma", "word", "sign", "image", "moved")


@query("o4_distance_terms", "SELECT l_linenumber % 4 AS gamma, CAST(2 AS INTEGER) AS deriv, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS coeff FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY 1")
def o4(spark, sf):
    t = T.table(spark, sf, "lineitem").select((F.col("l_linenumber") % 4).alias("gamma"), (F.col("l_partkey") % 5).alias("deriv"), F.floor("l_quantity").cast("long").alias("coeff"))
    return O.merge_terms(O.at_distance(t, 2), ["gamma", "deriv"])


@query("o8_little_group_insertions")
def o8(spark, sf):
    """Vector insertions seen from a moving frame: rows of T1 odd projected onto the little groups' irreps."""
    out = []
    t1 = S.irrep("T_1", -1)
    for ref in S.LITTLE:
        for rep, mats in S.little_irreps(ref).items():
            p = list(S.project(mats, lambda g: t1[g]).T)
            for n, k in enumerate(S.independent(p)):
                out += [("%d,%d,%d" % ref, rep, n, i, round(float(p[k][i].real), 6), round(float(p[k][i].imag), 6)) for i in range(3) if abs(p[k][i]) > 1e-7]
    return rows(spark, out, "momentum string, rep string, n int, r int, re double, im double")


@query("y10_row_connections")
def y10(spark, sf):
    """All rows of the E doublet of back-to-back momenta, from its first row; their norms agree."""
    ps = M.shell(1)
    at = {p: i for i, p in enumerate(ps)}

    def action(g: str) -> np.ndarray:
        m = np.zeros((6, 6))
        for p, i in at.items():
            m[at[S.rotate(g, p)], i] = 1
        return m

    mats = S.irrep("E", 1)
    first = list(S.project(mats, action).T)
    v = first[S.independent(first)[0]]
    out = [(k, "%d,%d,%d" % ps[i], round(float(w[i].real), 6)) for k, w in enumerate(S.connection(mats, action, v)) for i in range(6) if abs(w[i]) > 1e-7]
    return rows(spark, out, "r int, momentum string, coeff double")


@query("y13_rotated_momenta", f"WITH {EL_SQL}, {MOM_SQL}, im AS (SELECT mom, g, CAST(sum(CASE WHEN i = 0 THEN v * CASE j WHEN 0 THEN px WHEN 1 THEN py ELSE pz END ELSE 0 END) AS BIGINT) AS qx, CAST(sum(CASE WHEN i = 1 THEN v * CASE j WHEN 0 THEN px WHEN 1 THEN py ELSE pz END ELSE 0 END) AS BIGINT) AS qy, CAST(sum(CASE WHEN i = 2 THEN v * CASE j WHEN 0 THEN px WHEN 1 THEN py ELSE pz END ELSE 0 END) AS BIGINT) AS qz FROM m, el GROUP BY mom, g) SELECT mom, g, qx, qy, qz FROM im")
def y13(spark, sf):
    """Every momentum of the list under every element: a join on components and a sum."""
    el = rows(spark, _element_rows(), "g long, i long, j long, v long")
    m = _momenta(spark)
    part = m.select("mom", F.posexplode(F.array("px", "py", "pz")).alias("j2", "p"))
    both = part.join(F.broadcast(el), F.col("j2") == F.col("j"))
    return both.groupBy("mom", "g").agg(*[F.sum(F.when(F.col("i") == k, F.col("v") * F.col("p")).otherwise(0)).cast("long").alias(c) for k, c in enumerate(("qx", "qy", "qz"))])


@query("r4_unfinished_configurations", "SELECT DISTINCT o_custkey % 700 AS cfg FROM orders WHERE o_custkey % 700 NOT IN (SELECT o_custkey % 700 FROM orders WHERE o_orderstatus = 'P')")
def r4(spark, sf):
    """Configurations of which no result exists yet: an anti-join."""
    from tensorloom.streaming.configurations import unfinished

    o = T.table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("cfg"), "o_orderstatus")
    return unfinished(o.select("cfg").distinct(), o.where("o_orderstatus = 'P'"))
