"""Shared plans: diagrams of several configurations, identified points, word trees, seeded points, iterative modes."""

from fractions import Fraction
from itertools import combinations, product
from math import prod

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import catalog_diagrams as G
from tensorloom import catalog_fields as C
from tensorloom.catalog_correlators import Points
from tensorloom.functions import links as L
from tensorloom.operators import baryons as B
from tensorloom.operators import construction as O
from tensorloom.operators import fields as X
from tensorloom.operators import modes as M
from tensorloom.operators import points as P
from tensorloom.plans import diagrams as D
from tensorloom.plans import symmetry as S
from tensorloom.plans.einsum import Tensor
from tensorloom.plans.shared import Plan
from tensorloom.sources import derived as T
from tensorloom.sources.staging import cut

SF = "/root/testdata/sf0.001"


def made(spark, axes, x, cfg=None):
    rows = [(*map(int, i), int(x[i].real), int(x[i].imag)) for i in np.ndindex(*x.shape) if x[i] != 0]
    frame = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in [*axes, "re", "im"]))
    sizes = dict(zip(axes, x.shape, strict=True))
    if cfg is not None:
        frame, axes = frame.withColumn("cfg", F.explode(F.array(*[F.lit(c) for c in cfg]))), ("cfg", *axes)
    return Tensor(frame, axes, sizes)


def entries(rng, *shape):
    return rng.integers(-3, 4, shape) + 1j * rng.integers(-3, 4, shape)


def test_plan_shares_and_reduces(spark):
    """Two terms that differ in labels only are one node; repeated labels take the diagonal, lone ones are summed."""
    rng = np.random.default_rng(0)
    a, b = entries(rng, 3, 4), entries(rng, 4, 4)
    plan = Plan({"a": made(spark, ("i", "j"), a), "b": made(spark, ("j", "k"), b)})
    one = plan.add([("a", ("x", "u")), ("b", ("u", "v"))], ("x",), 2)
    two = plan.add([("b", ("w", "z")), ("a", ("x", "w"))], ("x",), Fraction(3))
    assert one == two and plan.joins == 1 and plan.apart == 2
    plan.add([("a", ("x", "u")), ("b", ("w", "w"))], ("x",), 1)
    got = {r.x: complex(r.re, r.im) for r in plan.total(("x",)).collect()}
    want = 5 * np.einsum("xu,uv->x", a, b) + a.sum(axis=1) * np.trace(b)
    assert all(abs(got.get(x, 0) - want[x]) < 1e-9 for x in range(3))


def test_plan_errors(spark):
    t = made(spark, ("i", "j"), np.ones((2, 2)) + 0j)
    with pytest.raises(ValueError):
        Plan({"a": t}).add([("a", ("x",))], ("x",))
    with pytest.raises(ValueError):
        Plan({"a": t}).add([("a", ("x", "y"))], ("z",))
    with pytest.raises(ValueError):
        Plan({"a": t}).total(())


def test_two_pions_share_their_plan(spark):
    """All terms need fewer joins together than one by one, and each configuration is what it gives alone."""
    plan = G.two_pion_plan(spark, SF)
    assert plan.joins < plan.apart
    both = {(r.cfg, r.s, r.t): (r.re, r.im) for r in plan.total(("s", "t"), T.kept).where("s = 1").collect()}
    props, vertices = G._tensors(spark, SF)
    alone = D.evaluate_sum(G.two_pions(), {"q": props["q"], "q_local": props["q"]}, {"pi": vertices["pi"], "pi†": vertices["b1"]}, {0: "s", 1: "t"}, ("s", "t"), T.kept).where("s = 1").collect()
    assert alone and len(both) == 4 * len(alone)
    for r in alone:
        for k in range(4):
            assert both[k, r.s, r.t] == ((k + 1) ** 4 * r.re, (k + 1) ** 4 * r.im)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_identifications_give_the_weights(n):
    """Summed over identifications that a tuple has, the factors are its weight."""
    positions = list(range(n))
    ways = D.identified_weights(positions, 9, 5)
    for points in product(range(3), repeat=n):
        total = sum(f for blocks, f in ways if all(len({points[p] for p in b}) == 1 for b in blocks))
        assert total == D.sampling_weight(9, 5, len(set(points)))


@pytest.mark.parametrize("n", [2, 3, 4])
def test_point_cycles(spark, n):
    """The mean of the estimator over all samples is the full sum; no intermediate has more than two points."""
    rng = np.random.default_rng(n)
    volume, sampled = 5, 4
    m = entries(rng, 1, 2, volume, 1)
    full = np.einsum("epc,eqd->pcqd", m[0], m[0].conj()).reshape(volume, volume)
    want = np.trace(np.linalg.matrix_power(full, n))
    total = 0
    for chosen in combinations(range(volume), sampled):
        plan = G.point_cycle_plan(made(spark, ("t", "e", "p", "c"), m[:, :, list(chosen)]), n, volume, sampled)
        if chosen[0] == 0 and chosen[-1] == sampled - 1:
            seen = [k for k in plan.nodes if k.made[0] == "pair"]
            assert seen and all(sum(s == sampled for s in k.sizes) <= 2 for k in seen)
        (r,) = plan.total(("t",), T.kept).collect()
        total += complex(r.re, r.im) / prod(sampled - i for i in range(n))
    assert abs(total / volume - want) < 1e-6 * abs(want)
    T.release()


def test_two_currents(spark):
    """Two current vertices at different times: 16 states, points of one time may coincide, of two they never meet."""
    rng = np.random.default_rng(4)
    ends = {"v": (2,), "p": (3, 1)}

    def tensor(kinds, lead, tag):
        names = [*lead, "x", "y"] + [f"{tag}{n}{i}" for n, k in enumerate(kinds) for i in range(len(ends[k]))]
        x = entries(rng, *([1] * len(lead)), 2, 2, *[s for k in kinds for s in ends[k]])
        return made(spark, tuple(names), x), x.reshape(2, 2, *[prod(ends[k]) for k in kinds])

    props, verts = {}, {}
    for k in ("vv", "vp", "pv", "pp"):
        props["q", k.upper()], verts["j", k] = tensor(k, "st", "a"), tensor(k, "t", "b")
    d = D.from_matrix([[0, 1], [1, 0]], [0, 1], ["j", "j"], [None, "q"])
    for volume, sampled in ((3, 3), (9, 3)):
        out = D.evaluate_currents(d, [True, True], [0, 1], {k: v[0] for k, v in props.items()}, {k: v[0] for k, v in verts.items()}, {0: "s", 1: "t"}, volume, sampled, hold=T.kept)
        (got,) = out.frame.collect()
        want = 0
        for l0, r0, l1, r1 in product("vp", repeat=4):
            p01, p10 = props["q", (r1 + l0).upper()][1], props["q", (r0 + l1).upper()][1]
            j0, j1 = verts["j", l0 + r0][1], verts["j", l1 + r1][1]
            weight = {}
            for name, (l, r) in (("0", (l0, r0)), ("1", (l1, r1))):
                w = np.ones((prod(ends[l]), prod(ends[r])))
                for a, b in np.ndindex(*w.shape):
                    w[a, b] = float(D.sampling_weight(volume, sampled, len({x for x, k in ((a, l), (b, r)) if k == "p"})))
                weight[name] = w
            want += sum(
                j0[a, b, m, n] * p01[c, a, o, m] * j1[e, c, q, o] * p10[b, e, n, q] * weight["0"][m, n] * weight["1"][q, o]
                for a, b, c, e in product(range(2), repeat=4)
                for m, n, q, o in product(*[range(prod(ends[k])) for k in (l0, r0, l1, r1)])
            )
        assert abs(got.re - want.real) < 1e-6 and abs(got.im - want.imag) < 1e-6
    T.release()


def test_triplets_are_determinants(spark):
    """Elementals of three modes against determinants site by site."""
    v = G.three_colours(spark, SF)
    v = Tensor(v.frame.where("t = 1"), v.axes, v.sizes)
    x = v.dense()[1]
    got = np.zeros((T.NE,) * 3, complex)
    for r in B.triplets(v).frame.collect():
        got[r.a, r.b, r.c] += r.re + 1j * r.im
    want = np.zeros_like(got)
    for a, b, c in product(range(T.NE), repeat=3):
        want[a, b, c] = sum(np.linalg.det(np.array([x[a, s], x[b, s], x[c, s]])) for s in range(G.SITES3))
    assert np.abs(want).max() > 1 and np.abs(got - want).max() < 1e-9


def test_link_operators_transform(spark):
    """Rows of an irrep over a word's orbit turn into each other by its matrices; parity and charge signs are as asked."""
    for word, rep, parity, charge in (((0,), "T_1", -1, -1), ((0,), "E", 1, 1), ((0, 1), "T_2", 1, 1), ((0, 1), "T_1", 1, -1)):
        rows = S.link_rows(word, rep, parity, charge)
        mats = S.irrep(rep, parity)
        maps = {g: L.letter_map(m.tolist()) for g, m in S.vectors().items()}
        for g in ("c4y", "c4z", "inviden", "c3delta"):
            for k, row in enumerate(rows):
                moved = {L.transform(w, maps[g]): c for w, c in row}
                want = {}
                for n, other in enumerate(rows):
                    for w, c in other:
                        want[w] = want.get(w, 0) + mats[g][n, k] * c
                assert all(abs(moved.get(w, 0) - want.get(w, 0)) < 1e-7 for w in {*moved, *want})
        for row in rows:
            turned = {L.conjugate(w): c for w, c in row}
            assert all(abs(turned[w] - charge * c) < 1e-9 for w, c in row)
    with pytest.raises(ValueError):
        S.link_rows((0,), "A_2", 1, 1)
    with pytest.raises(ValueError):
        O.whole_terms([[(0, (0,), 1.0), (0, (1,), 2**0.5)]])


def test_daggers_come_back(spark):
    """Twice daggered is the propagator itself, for every kind of ends."""
    rng = np.random.default_rng(8)
    for ends, (sink, source) in P.ENDS.items():
        axes = ("s", "t", "j", "i", *sink, *source)
        x = made(spark, axes, entries(rng, 2, 2, 4, 4, *[{"p": 3, "q": 3}.get(a, 2) for a in (*sink, *source)]))
        back = P.dagger(P.dagger(x, ends), ends[::-1])
        assert back.axes == x.axes and np.array_equal(back.dense(), x.dense())


def test_blocks_of_many_labels(spark):
    """More labels than letters, and results sent on one by one."""
    from tensorloom.plans import einsum as E

    rng = np.random.default_rng(9)
    names = [f"l{i}" for i in range(28)]
    x = [entries(rng, 3, *[2 if k in (i, i + 1) else 1 for k in range(i, i + 4)]) for i in range(0, 24, 4)]
    ops = [made(spark, ("k", *names[i : i + 4]), y) for i, y in zip(range(0, 24, 4), x, strict=True)]
    got = E.contract_blocks(ops, ("k",), ("k",)).dense()
    assert np.abs(got - np.prod([y.sum(axis=(1, 2, 3, 4)) for y in x], axis=0)).max() < 1e-6
    held, E.HELD_ENTRIES = E.HELD_ENTRIES, 1
    try:
        assert np.array_equal(E.contract_blocks(ops, ("k",), ("k",)).dense(), got)
    finally:
        E.HELD_ENTRIES = held


def test_invariant_sums_of_diagrams():
    """The sum over rows comes back from all 96 elements, a weighted one only from those that keep its axes apart; two elements in turn are their product."""
    same = G.vector_sum((1, 1, 1))
    for g in S.NAMES:
        got = G.turned_sum((1, 1, 1), g)
        assert set(got) == set(same) and all(abs(got[k] - same[k]) < 1e-7 for k in same)
    uneven = G.vector_sum((1, 2, 5))
    assert sum(set(G.turned_sum((1, 2, 5), g)) == set(uneven) and all(abs(G.turned_sum((1, 2, 5), g)[k] - c) < 1e-7 for k, c in uneven.items()) for g in S.NAMES) == 16
    image = lambda g: D.irrep_image({"h": "H"}, g, lambda rep: S.irrep(rep, 1))
    e = {(D.Diagram(((0, "h.0†"), (1, "h.1")), (D.Edge(0, 1, "q"), D.Edge(1, 0, "q"))),): Fraction(1)}
    for g, h in (("c4y", "c3delta"), ("rc4z", "invc2a")):
        one, two = D.acted(D.acted(e, image(h)), image(g)), D.acted(e, image(S.mul(g, h)))
        assert all(abs(one.get(k, 0) - two.get(k, 0)) < 1e-6 for k in {*one, *two})


def test_summed_high_mode(spark):
    """Summed inside the plan as summed from all pairs of points."""
    q = Points(spark, SF)
    cut_ = lambda t: Tensor(t.frame.where("s = 1 AND t = 2"), t.axes, t.sizes)
    tau, vsp, psv, m = cut_(q.tau()), cut_(q.vsp()), cut_(q.psv()), q.ov()
    psp = P.made_both_points(vsp, m)
    rows = P.high_mode_both(psp, P.high_mode_source(vsp, tau, m), psv, m).frame.groupBy("j", "i", "c", "d").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect()
    want = {(r.j, r.i, r.c, r.d): (r.re, r.im) for r in rows if r.re or r.im}
    plan = P.summed_high_mode_plan(vsp, psv, tau, m)
    got = {(r.j, r.i, r.c, r.d): (r.re, r.im) for r in plan.total(("j", "i", "c", "d")).collect() if r.re or r.im}
    assert want and got == want


# --- fields ----------------------------------------------------------------------------------


def test_word_tree_walks_each_edge_once():
    tree = X.WordTree(C.WORDS, forward=False)
    assert len(tree.place) == 43 and tree.edges == 42 and [len(x) for x in tree.levels] == [6, 36]
    some = X.WordTree([(0, 1, 2), (0, 1), (0, 1, 5), (3,)], forward=True)
    assert some.edges == 5


def test_words_of_a_tree_equal_single_words(spark):
    """Fields moved along a word hop by hop, and transports one by one, against the tree's."""
    f, u = C.field(spark, SF).where("t < 2"), C.gauge(spark, SF).where("t < 2")
    words = [(0, 4), (5,), (1, 1, 3), ()]
    tree, moved = C.word_fields(f, u, words)
    keys = ["t", "x", "y", "z", "c", "e"]
    for n, w in enumerate(words):
        one = f
        for d in reversed(w):
            one = X.hop(one, u, d, C.EXT, ("e",))
        want = {tuple(r[k] for k in keys): (r.re, r.im) for r in one.collect() if r.re or r.im}
        assert want and {tuple(r[k] for k in keys): (r.re, r.im) for r in tree.named(moved, words).where(f"w = {n}").collect() if r.re or r.im} == want
    pts = T.points(spark, SF).where("t < 2")
    ahead = X.WordTree(words, forward=True)
    ends = ahead.named(X.transported_by_words(u, pts, ahead, C.EXT, T.NC, T.kept), words)
    keys = ["t", "p", "x", "y", "z", "a", "b"]
    for n, w in enumerate(words):
        want = {tuple(r[k] for k in keys): (r.re, r.im) for r in X.transport(u, pts, w, C.EXT, T.NC).collect() if r.re or r.im}
        assert want and {tuple(r[k] for k in keys): (r.re, r.im) for r in ends.where(f"w = {n}").collect() if r.re or r.im} == want
    T.release()


def test_stencils_join_once(spark):
    plan = X.laplacian(C.field(spark, SF), C.gauge(spark, SF), C.EXT, ("e",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


@pytest.mark.parametrize(("modes", "guard"), [(6, 6), (5, 3)])
def test_iterative_modes_equal_dense_ones(spark, modes, guard):
    """Values, and the spaces of values that lie apart from the next, against dense matrices of whole slices."""
    u = cut(X.projected(C._regular(C.gauge(spark, SF)), C.EXT, T.NC).where("t < 2"))
    got = M.lowest(u, C.EXT, modes, guard).collect()
    for t in range(2):
        block = X.gauge_block(u.where(f"t = {t}").toPandas(), C.EXT, T.NC)
        values, dense = X.lowest_modes(block, modes + 1)
        mine, v = np.zeros(modes), np.zeros((modes, T.LZ, T.LY, T.LX, T.NC), complex)
        for r in got:
            if r.t == t:
                mine[r.e], v[r.e, r.z, r.y, r.x, r.c] = r.value, r.re + 1j * r.im
        assert np.abs(mine - values[:modes]).max() < 1e-8
        v, dense = v.reshape(modes, -1), dense.reshape(modes + 1, -1)
        assert np.abs(v @ v.conj().T - np.eye(modes)).max() < 1e-8
        first = v[:, 0]
        assert np.abs(first.imag).max() < 1e-12 and first.real.min() >= 0
        h = X.laplacian_matrix(block)
        assert max(np.linalg.norm(h @ x - e * x) for x, e in zip(v, mine, strict=True)) < 1e-8
        for n in range(1, modes + 1):
            if values[n] - values[n - 1] > 1e-3:
                mine_p, dense_p = v[:n].T @ v[:n].conj(), dense[:n].T @ dense[:n].conj()
                assert np.abs(mine_p - dense_p).max() < 1e-5


def test_modes_give_up(spark):
    u = cut(X.projected(C._regular(C.gauge(spark, SF)), C.EXT, T.NC).where("t = 0"))
    with pytest.raises(ArithmeticError):
        M.lowest(u, C.EXT, 2, 0, degree=1, rounds=1)
    with pytest.raises(ValueError):
        M.lowest(u, C.EXT, 999)


# --- points ----------------------------------------------------------------------------------


def test_seeded_points(spark):
    """Unique, in range, the same for a seed, other for another."""
    seeds = spark.createDataFrame([("a", 42), ("b", 42), ("c", 43)], "cfg string, seed long")
    rows = P.sampled_points(seeds, (10, 6, 4, 5), 50).collect()
    by = {}
    for r in rows:
        assert 0 <= r.x < 10 and 0 <= r.y < 6 and 0 <= r.z < 4 and 0 <= r.t < 5 and 0 <= r.p < 50
        by.setdefault((r.cfg, r.t), {})[r.p] = (r.x, r.y, r.z)
    assert len(by) == 15 and all(len(x) == 50 == len(set(x.values())) for x in by.values())
    assert all(by["a", t] == by["b", t] != by["c", t] for t in range(5))
    assert len({tuple(sorted(by["a", t].values())) for t in range(5)}) == 5


def test_all_points_of_a_slice(spark):
    rows = P.sampled_points(spark.createDataFrame([(7,)], "seed long"), (3, 2, 2, 2), 12).collect()
    assert len({(r.t, r.x, r.y, r.z) for r in rows}) == 24


@pytest.mark.parametrize(("size", "points", "text"), [((24, 24, 24), 216, "4 elements"), ((5, 5, 5, 10), 200, "exceeds spatial volume"), ((8, 8, 8, 8), 0, "must be positive"), ((8, 8, 8, 8), -10, "must be positive")])
def test_seeded_points_errors(spark, size, points, text):
    with pytest.raises(ValueError, match=text):
        P.sampled_points(spark.createDataFrame([(1,)], "seed long"), size, points)
