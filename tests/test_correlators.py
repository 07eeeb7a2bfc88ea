from functools import reduce

import numpy as np
from pyspark.sql import DataFrame

from tensorloom.catalog_correlators import Base, Points
from tensorloom.functions.gamma import gamma, source_dagger
from tensorloom.operators import correlators as C
from tensorloom.operators import points as P
from tensorloom.plans.einsum import Tensor
from tensorloom.sources import derived as D

SF = "/root/testdata/sf0.001"
G5 = gamma(15)


def dense(spark):
    b = Base(spark, SF)
    tau, phi = b.tau().dense(), b.phi().dense()
    return b, tau, phi


def test_backward_is_hermitian_conjugate(spark):
    b, tau, _ = dense(spark)
    got = D.backward(b.tau()).dense()
    want = np.einsum("ik,stlkba,lj->stijab", G5, tau.conj(), G5)
    assert np.abs(got - want).max() == 0


def test_twopoint_equals_einsum_and_blocks(spark):
    b, tau, phi = dense(spark)
    elem = b.elem().where("op = 0")
    v, w = b.v(elem), b.w(elem)
    rel = C.twopoint(b.tau(), v, w, ()).dense()
    blk = C.twopoint(b.tau(), v, w, (), blocks=True).dense()
    bw = np.einsum("ik,stlkba,lj->stijab", G5, tau.conj(), G5)
    p = phi[0, 0]
    want = -np.einsum("stijab,jk,tbc,stklcd,li,sad->st", bw, G5, p, tau, source_dagger(G5), p.conj(), optimize=True)
    assert np.abs(rel - want).max() == 0
    assert np.abs(blk - want).max() < 1e-6 * np.abs(want).max()


def test_pion_sign_cancels(spark):
    """For gamma 15 the overall minus meets the minus of its source dagger: C = + sum A B."""
    assert np.allclose(source_dagger(G5), -G5)


def test_high_modes_are_orthogonal_to_modes(spark):
    """Projecting twice removes nothing more when overlaps are orthonormal: here the made local term alone is left."""
    q = Points(spark, SF)
    tau, m = q.tau(), q.ov()
    got = P.high_mode_source(q.vsp(), tau, m).dense()
    b, p, c = np.indices((6, 12, 2))
    local = (b + p + c) % 3 - 1j * ((b * p + c) % 2)
    present = np.abs(P.low_source(tau, m).dense()) > 0
    assert np.abs((got - local) * present).max() == 0


def test_psp_projection_equals_loops(spark):
    q = Points(spark, SF)
    tau, m, vsp, psv = q.tau(), q.ov(), q.vsp(), q.psv()
    psp = P.made_both_points(vsp, m)
    high = P.high_mode_both(psp, P.high_mode_source(vsp, tau, m), psv, m)
    one = high.where("s = 1 AND t = 2 AND j = 0 AND i = 3")
    got = np.zeros((12, 2, 12, 2), complex)
    for r in one.frame.collect():
        got[r.p, r.c, r.q, r.d] += r.re + 1j * r.im
    M, T = m.dense(), tau.dense()[1, 2, 0, 3]
    V, S = vsp.dense()[1, 2, 0, 3], psv.dense()[1, 2, 0, 3]
    full = np.einsum("bpc,bqd->pcqd", M[2], V)
    hv = V - np.einsum("ba,apc->bpc", T, M[1].conj())
    want = full - np.einsum("bpc,bqd->pcqd", M[2], hv) - np.einsum("pca,aqd->pcqd", S, M[1].conj())
    assert np.abs(got - want).max() == 0


def test_full_sampling_estimator_is_exact():
    from itertools import combinations

    from tensorloom.plans.diagrams import sampling_weight

    rng = np.random.default_rng(0)
    x = rng.integers(-5, 5, (5, 5, 5))
    total = 0.0
    for s in combinations(range(5), 3):
        total += sum(float(sampling_weight(5, 3, len({a, b, c}))) * x[a, b, c] for a in s for b in s for c in s)
    assert abs(total / 10 - x.sum()) < 1e-9


def test_current_vertices_sum_over_ends_and_points(spark):
    """One current and one meson vertex on a loop, random entries, against explicit loops over points."""
    from itertools import product

    from tensorloom.plans import diagrams as X
    from tensorloom.plans.einsum import Tensor

    rng = np.random.default_rng(4)
    def made(kinds, lead):
        names, shape = [*lead, "x", "y"], [1] * len(lead) + [2, 2]
        for n, k in enumerate(kinds.lower()):
            names += [f"m{n}"] if k == "v" else [f"p{n}", f"c{n}"]
            shape += [2] if k == "v" else [3, 1]
        x = rng.integers(-3, 4, shape) + 1j * rng.integers(-3, 4, shape)
        rows = [(*map(int, i), int(x[i].real), int(x[i].imag)) for i in np.ndindex(*shape)]
        frame = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in [*names, "re", "im"]))
        return Tensor(frame, tuple(names), dict(zip(names, shape, strict=True))), x

    props, verts = {}, {}
    for k in ("VV", "VP", "PV", "PP"):
        props["q", k] = made(k, "st")
        verts["j", k.lower()] = made(k, "t")
    verts["m", "vv"] = made("vv", "t")
    d = X.from_matrix([[0, 1], [1, 0]], [0, 1], ["j", "m"], [None, "q"])
    for volume, sampled in ((3, 3), (9, 3)):
        got = X.evaluate_currents(d, [True, False], [0, 0], {k: v[0] for k, v in props.items()}, {k: v[0] for k, v in verts.items()}, {0: "s", 1: "t"}, volume, sampled).frame.collect()[0]
        want = 0
        for left, right in product("vp", repeat=2):
            out = props["q", f"V{left.upper()}"][1][0, 0].reshape(2, 2, 2, -1)
            back = props["q", f"{right.upper()}V"][1][0, 0].reshape(2, 2, -1, 2)
            j = verts["j", left + right][1][0].reshape(2, 2, out.shape[3], back.shape[2])
            m = verts["m", "vv"][1][0]
            for a, b in product(range(out.shape[3]), range(back.shape[2])):
                points = {x for x, k in ((a, left), (b, right)) if k == "p"}
                w = float(X.sampling_weight(volume, sampled, len(points)))
                want += w * sum(
                    out[snk, src, n, a] * j[src, snk2, a, b] * back[snk2, src2, b, o] * m[src2, snk, o, n]
                    for snk, src, n, snk2, src2, o in product(range(2), repeat=6)
                )
        assert abs(got.re - want.real) < 1e-6 and abs(got.im - want.imag) < 1e-6


def test_configurations_never_meet(spark):
    """Two configurations in one contraction give what each gives alone, as joins and as blocks."""
    rng = np.random.default_rng(11)
    gammas = D.gammas(spark)

    def frame(cfg, axes, x):
        rows = [(cfg, *map(int, i), int(x[i].real), int(x[i].imag)) for i in np.ndindex(*x.shape) if x[i] != 0]
        return spark.createDataFrame(rows, f"cfg string, {', '.join(f'{a} long' for a in axes)}, re long, im long")

    def entries(*shape):
        return rng.integers(-2, 3, shape) * (rng.random(shape) < 0.3) + 1j * rng.integers(-2, 3, shape)

    axes = ("s", "t", "j", "i", "b", "a"), ("op", "gamma", "t", "b", "c")
    sizes = {"s": 2, "t": 2, "j": 4, "i": 4, "b": 3, "a": 3, "op": 1, "gamma": 16, "c": 3}
    one = [(entries(2, 2, 4, 4, 3, 3), np.where(np.arange(16)[None, :, None, None, None] == 15, entries(1, 16, 2, 3, 3), 0)) for _ in range(2)]
    got = {}
    for name, picked in (("both", (0, 1)), ("first", (0,)), ("second", (1,))):
        tau, elem = (Tensor(reduce(DataFrame.unionByName, [frame(f"c{k}", axes[n], one[k][n]) for k in picked]), ("cfg", *axes[n]), sizes) for n in (0, 1))
        v, w = C.vertex(elem, gammas), C.source_vertex(elem, D.gammas(spark, True))
        for blocks in (True, False):
            rows = C.relative(C.twopoint(tau, v, w, (), blocks=blocks), 2, ()).collect()
            got[name, blocks] = {(r.cfg, r.dt): (r.re, r.im) for r in rows if r.re or r.im}
    assert got["both", True] == got["both", False] == got["first", True] | got["second", True]
    assert got["first", True] == got["first", False] and {c for c, _ in got["both", True]} == {"c0", "c1"}
