"""Derivative elementals against numpy."""

import numpy as np
import pytest

from tensorloom import catalog_fields as C
from tensorloom.operators import fields as X
from tensorloom.sources import derived as D

SF = "/root/testdata/sf0.001"


def test_derivative_elementals(spark):
    f, u = C.field(spark, SF).where("t = 1"), C.gauge(spark, SF).where("t = 1")
    v, g = np.zeros((D.NE, 2, 2, 4, 2), complex), np.zeros((3, 2, 2, 4, 2, 2), complex)
    for r in f.collect():
        v[r.e, r.z, r.y, r.x, r.c] += r.re + 1j * r.im
    for r in u.collect():
        g[r.mu, r.z, r.y, r.x, r.a, r.b] += r.re + 1j * r.im

    def grad(w, d):
        back = np.einsum("zyxba,ezyxb->ezyxa", g[d].conj(), w)
        return np.einsum("zyxab,ezyxb->ezyxa", g[d], np.roll(w, -1, 3 - d)) - np.roll(back, 1, 3 - d)

    z, y, x = np.indices((2, 2, 4))
    ph = [1j ** ((p[0] * x + 2 * p[1] * y + 2 * p[2] * z) % 4) for p in D.MOMENTA]
    dot = lambda a, b: np.array([np.einsum("zyx,ezyxc,fzyxc->ef", q, a.conj(), b) for q in ph])
    d0, d1 = grad(v, 0), grad(v, 1)
    want = [dot(grad(d1, 0), v) - dot(d1, d0) - dot(d0, d1) + dot(v, grad(d0, 1)), dot(d0, v) - dot(v, d0)]
    got = np.zeros((2, len(ph), D.NE, D.NE), complex)
    for r in C.derivative_elementals(f, u, ((0, 1), (0,))).collect():
        got[r.path, r.mom, r.b, r.c] += r.re + 1j * r.im
    assert np.abs(want).max() > 0 and np.allclose(got, want)


def series_exp(a):
    """exp by its power series, halved and squared."""
    out, term = np.eye(len(a), dtype=complex), np.eye(len(a), dtype=complex)
    for k in range(1, 40):
        term = term @ a / k / 64 * 1.0
        out = out + term
    for _ in range(6):
        out = out @ out
    return out


def test_stout_against_loops_over_sites():
    """Every link from its four staples, site by site; unsmeared links differ."""
    rng = np.random.default_rng(5)
    lx, ly, lz, n = 3, 2, 4, 3
    u = X.unitary(rng.standard_normal((3, lz, ly, lx, n, n)) + 1j * rng.standard_normal((3, lz, ly, lx, n, n)))
    size = {0: lx, 1: ly, 2: lz}

    def step(x, mu, by):
        return tuple((c + by * (mu == k)) % size[k] for k, c in enumerate(x))

    def link(v, mu, x):
        return v[mu, x[2], x[1], x[0]]

    def once(v):
        new = np.empty_like(v)
        for mu in range(3):
            for x in np.ndindex(lx, ly, lz):
                staples = 0
                for nu in {0, 1, 2} - {mu}:
                    up = step(x, nu, 1)
                    staples = staples + link(v, nu, x) @ link(v, mu, up) @ link(v, nu, step(x, mu, 1)).conj().T
                    down = step(x, nu, -1)
                    staples = staples + link(v, nu, down).conj().T @ link(v, mu, down) @ link(v, nu, step(down, mu, 1))
                omega = 0.1 * staples @ link(v, mu, x).conj().T
                anti = 0.5 * (omega - omega.conj().T)
                anti = anti - np.trace(anti) / n * np.eye(n)
                new[mu, x[2], x[1], x[0]] = series_exp(anti) @ link(v, mu, x)
        return new

    got = X.stout(u, 2, 0.1)
    want = once(once(u))
    assert np.allclose(got, want, atol=1e-10)
    assert not np.allclose(got, u, atol=1e-3)


def test_fields_of_several_configurations_are_refused(spark):
    f, u = C.field(spark, SF).selectExpr("'c0' AS cfg", "*"), C.gauge(spark, SF)
    with pytest.raises(ValueError):
        X.hop(f, u, 0, C.EXT, ("e",))
    with pytest.raises(ValueError):
        X.projected(u.selectExpr("'c0' AS cfg", "*"), C.EXT, D.NC)
