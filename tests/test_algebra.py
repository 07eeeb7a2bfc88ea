from fractions import Fraction

import numpy as np
import pytest

from tensorloom.functions import gamma as G
from tensorloom.functions import links as L
from tensorloom.functions import momenta as M
from tensorloom.plans import diagrams as D
from tensorloom.plans import symmetry as S
from tensorloom.plans import wick as W


def test_gamma():
    assert np.allclose(G.gamma(0), np.eye(4)) and np.allclose(G.gamma(15), np.diag([1, 1, -1, -1]))
    for a in (1, 2, 4, 8):
        for b in (1, 2, 4, 8):
            assert np.allclose(G.gamma(a) @ G.gamma(b) + G.gamma(b) @ G.gamma(a), 2 * np.eye(4) * (a == b))
    with pytest.raises(ValueError):
        G.gamma(16)
    assert [G.label(n) for n in (0, 15, 7, 8, 14, 5)] == ["", "γ5", "γ5γ4", "γ4", "γ1γ5", "γ2γ5γ4"]


def test_links():
    assert [L.words_shorter(k) for k in range(1, 6)] == [1, 7, 37, 187, 937]
    assert all(L.link_index(L.link_word(i)) == i for i in range(937))
    assert L.conjugate((1, 2, 3)) == (0, 5, 4) and L.inverse((1, 2)) == (4, 5)
    assert L.displacement((0, 0, 4)) == (2, -1, 0)
    with pytest.raises(ValueError):
        L.link_index((0, 3))
    assert L.derivative_path(0) == () and L.derivative_path(11) == (2, 1) and L.derivative_label(-1, 9) == "-dzdy"


def test_momenta():
    assert [len(M.momentum_list(k)) for k in (1, 3, 9, 0)] == [1, 27, 123, 23]
    assert M.momentum_list(3)[:8] == [(0, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 1)]
    with pytest.raises(ValueError):
        M.momentum_list(5)


def test_sampling():
    assert D.sampling_weight(1000, 10, 2) == Fraction(1000 * 999, 90)
    assert all(D.sampling_weight(27, 27, k) == 1 for k in range(28))
    assert D.sampling_weight(1000, 3, 4) == 0 and D.sampling_weight(2, 5, 3) == 0
    assert [len(D.point_scenes(r, 27, 5)) for r in (1, 2, 3, 4)] == [1, 2, 3, 5]
    assert D.integer_partitions(3) == [[1, 1, 1], [2, 1], [3]]
    assert [len(D.set_partitions(list(range(n)))) for n in range(5)] == [1, 1, 2, 5, 15]


def matrix(m, times, names, props=(None, "p1", "p2")):
    return D.from_matrix(m, times, names, list(props))


def test_simplify():
    d = matrix([[0, 1], [0, 0]], [1, 0], ["v2", "v1"])
    assert D.simplify(d) == (matrix([[0, 0], [1, 0]], [0, 1], ["v1", "v2"]),)
    d = matrix([[0, 0, 1], [0, 0, 0], [0, 0, 0]], [0, 1, 2], ["v1", "r", "v2"])
    assert D.simplify(d) == (matrix([[0, 1], [0, 0]], [0, 2], ["v1", "v2"]),)
    d = matrix([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 2]], [0, 1, 2, 3], ["v1", "v2", "v3", "v4"])
    assert set(D.simplify(d)) == {matrix([[0, 1], [1, 0]], [0, 1], ["v1", "v2"]), matrix([[2]], [3], ["v4"])}
    a = matrix([[0, 0, 1], [0, [[1, 1, 1]], 0], [0, 1, 0]], [0, 0, 0], ["v1", "v2", "v2"])
    b = matrix([[0, 1, 0], [0, 0, 1], [0, 0, [[1, 1, 1]]]], [0, 0, 0], ["v1", "v2", "v2"])
    assert D.simplify(a) == D.simplify(b) and D.simplify(a)[0].digest == D.simplify(b)[0].digest


def test_operands_and_states():
    two = matrix([[0, 1], [1, 0]], [0, 1], ["a", "b"])
    assert D.analyse(two)[0].subscripts() == "BAON,DCQP,ADNQ,CBPO"
    assert len(D.expand_currents(two, [True, False])) == 4
    three = matrix([[0, 1, 0], [0, 0, 1], [1, 0, 0]], [0, 1, 2], ["a", "b", "c"])
    assert len(D.expand_currents(three, [True, True, False])) == 16


def test_wick():
    (key,) = W.contract_quarks([W.Hadron("uu", time=0), W.Hadron("dd", time=1)])
    assert {(e.src, e.snk) for e in key[0].edges} == {(0, 0), (1, 1)}
    e = W.contract_quarks([W.Hadron("ud", time=0), W.Hadron("du", time=1)])
    assert list(e.values()) == [-1]
    assert W.contract_quarks([W.Hadron("ud"), W.Hadron("ud")]) == {}
    assert len(W.contract_quarks([W.Hadron("uud", time=0), W.Hadron("bar{uud}", time=1)])) == 2
    for a, b in (("ud", "du"), ("uds", "bar{uds}"), ("bar{uds}", "uds")):
        assert W.Hadron(a).conjugate().flavour == b


def test_group_axioms():
    names = S.NAMES
    assert len(set(S.cayley().values())) == 96
    assert S.mul("c4x", "c4x") == "c2x" and S.mul("c4x", "c4x^-1") == "iden"
    for a in names[::11]:
        assert S.mul(a, S.inverses()[a]) == "iden"
        for b in names[::13]:
            for c in names[::17]:
                assert S.mul(S.mul(a, b), c) == S.mul(a, S.mul(b, c))


@pytest.mark.parametrize("rep", sorted(S.GENERATORS))
def test_irreps_are_representations(rep):
    m = S.irrep(rep, -1)
    for a in S.NAMES[::5]:
        for b in S.NAMES[::7]:
            assert np.abs(m[a] @ m[b] - m[S.mul(a, b)]).max() < 1e-6


def test_little_groups():
    for ref in S.LITTLE:
        group = set(S.little_group(ref))
        for mats in S.little_irreps(ref).values():
            assert set(mats) == group
        assert sum(len(m["iden"]) ** 2 for m in S.little_irreps(ref).values()) == len(group)
        for rep, (y, _) in S.GENERATORS.items():
            got = sum(n * len(S.little_irreps(ref)[b]["iden"]) for (a, p, b), n in S.subduction(ref).items() if a == rep and p == 1)
            assert got == len(y)
    for g in S.NAMES[::3]:
        assert S.wigner_rotation((1, 0, 0), g) in S.little_group((0, 0, 1))


def test_projectors():
    for rep in ("A_1", "E", "T_1"):
        reg = S.irrep("T_1", -1)

        def action(g):
            return np.kron(reg[g], reg[g])

        p = S.project(S.irrep(rep, 1), action)
        assert np.abs(p @ p - p).max() < 1e-6
    assert len(S.clebsch_gordan("T_1", "T_1", "A_2")) == 0
    assert S.independent([np.array([1, 0]), np.array([2, 0]), np.array([1, 1])]) == [0, 2]
