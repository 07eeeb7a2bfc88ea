"""Operator construction: terms as rows, products of families, two-particle bases."""

from __future__ import annotations

from math import factorial, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.gamma import FLIPPED, family, sign
from tensorloom.functions.links import DERIVATIVE_TRAITS, DERIVATIVES
from tensorloom.functions.momenta import Vec, shell
from tensorloom.plans.einsum import Tensor
from tensorloom.plans.symmetry import clebsch_gordan, irrep, link_rows


def merge_terms(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Equal terms summed, zeros dropped."""
    return terms.groupBy(*keys).agg(F.sum("coeff").alias("coeff")).where("coeff <> 0")


def signed(terms: DataFrame) -> DataFrame:
    """Members 5 and 13 of vector families change sign."""
    return terms.withColumn("coeff", F.when(F.col("gamma").isin(*FLIPPED), -F.col("coeff")).otherwise(F.col("coeff")))


def at_distance(terms: DataFrame, distance: int) -> DataFrame:
    """Displaced operators: terms without derivatives get a distance in their place."""
    return terms.where("deriv = 0").withColumn("deriv", F.lit(distance))


def bind_momentum(momenta: DataFrame, p: Vec) -> DataFrame:
    return momenta.where((F.col("px") == p[0]) & (F.col("py") == p[1]) & (F.col("pz") == p[2]))


def insertion(gamma_family: str, derivative: str) -> list[tuple[str, int, list[tuple[int, int, complex]]]]:
    """(irrep, row, [(gamma, path, coefficient)]) of every irrep in the product of a spin and a derivative family."""
    f = family(gamma_family)
    d = DERIVATIVES[derivative]
    out = []
    for rep in ("A_1", "A_2", "E", "T_1", "T_2"):
        rows: dict[int, dict[tuple[int, int], complex]] = {}
        for a, b, k, c in clebsch_gordan(f.group, DERIVATIVE_TRAITS[derivative][0], rep):
            n = f.members[a]
            for coeff, path in d[b]:
                key = (n, path)
                rows.setdefault(k, {})
                rows[k][key] = rows[k].get(key, 0) + c * coeff * sign(n)
        out += [(rep, k, [(n, p, c) for (n, p), c in sorted(terms.items()) if abs(c) > 1e-9]) for k, terms in sorted(rows.items())]
    return out


LinkTerm = tuple[int, tuple[int, ...], complex]


def link_insertion(gamma_family: str, word: tuple[int, ...], rep: str, parity: int, charge: int, total: str, which: int = 0) -> list[list[LinkTerm]]:
    """Rows of the irrep `total` in the product of a spin family and a link family: (gamma, word, coefficient).

    The link family is the multiplet of irrep rep, parity and charge sign over the
    orbit of a word; rows are joined by Clebsch-Gordan coefficients. No rows where
    total does not occur.
    """
    f, links = family(gamma_family), link_rows(word, rep, parity, charge, which)
    rows: dict[int, dict[tuple[int, tuple[int, ...]], complex]] = {}
    for a, b, k, c in clebsch_gordan(f.group, rep, total):
        n = f.members[a]
        for w, x in links[b]:
            own = rows.setdefault(k, {})
            own[n, w] = own.get((n, w), 0) + c * x * sign(n)
    return [[(n, w, c) for (n, w), c in sorted(own.items()) if abs(c) > 1e-9] for _, own in sorted(rows.items())]


def whole_terms(rows: list[list[LinkTerm]]) -> list[list[tuple[int, tuple[int, ...], int]]]:
    """The rows over their smallest coefficient, which must leave whole numbers: operators are defined up to a factor."""
    least = min((c for row in rows for *_, c in row), key=abs)
    out = [[(n, w, c / least) for n, w, c in row] for row in rows]
    if any(abs(c - round(c.real)) > 1e-9 for row in out for *_, c in row):
        raise ValueError("coefficients are no whole multiples of the smallest one")
    return [[(n, w, round(c.real)) for n, w, c in row] for row in out]


def bind_links(terms: DataFrame, displaced: Tensor) -> Tensor:
    """Elementals of operators (op, gamma, t, b, c) from terms (op, gamma, w, coeff) and displaced elementals (w, t, b, c)."""
    rows = displaced.frame.join(F.broadcast(terms), "w")
    axes = (*displaced.batch, "op", "gamma", "t", "b", "c")
    frame = rows.groupBy(*axes).agg(F.sum(F.col("coeff") * F.col("re")).alias("re"), F.sum(F.col("coeff") * F.col("im")).alias("im"))
    return Tensor(frame, axes, {**displaced.sizes, "op": 4, "gamma": 16}, rows=8.0 * displaced.sizes["t"] * displaced.sizes["b"] * displaced.sizes["c"])


def su2_clebsch(j1: int, m1: int, j2: int, m2: int, j: int, m: int) -> float:
    """<j1 m1 j2 m2 | j m> for integer spins, by Racah's sum."""
    if m1 + m2 != m or not abs(j1 - j2) <= j <= j1 + j2 or abs(m) > j or abs(m1) > j1 or abs(m2) > j2:
        return 0.0
    f = factorial
    front = sqrt((2 * j + 1) * f(j + j1 - j2) * f(j - j1 + j2) * f(j1 + j2 - j) / f(j1 + j2 + j + 1))
    front *= sqrt(f(j + m) * f(j - m) * f(j1 - m1) * f(j1 + m1) * f(j2 - m2) * f(j2 + m2))
    total = 0.0
    for k in range(j1 + j2 - j + 1):
        parts = [k, j1 + j2 - j - k, j1 - m1 - k, j2 + m2 - k, j - j2 + m1 + k, j - j1 - m2 + k]
        if min(parts) >= 0:
            den = 1
            for x in parts:
                den *= f(x)
            total += (-1) ** k / den
    return front * total


def harmonic(l: int, m: int, p: Vec) -> complex:
    """sqrt(4 pi) Y_lm of a momentum's direction, for l up to 1."""
    if l == 0:
        return 1.0
    r = sqrt(sum(x * x for x in p)) or 1.0
    x, y, z = (c / r for c in p)
    return {1: -sqrt(1.5) * (x + 1j * y), 0: sqrt(3) * z, -1: sqrt(1.5) * (x - 1j * y)}[m]


def two_particle(j: int, m: int, l: int, s: int, s1: int, s2: int, n: int) -> list[tuple[Vec, int, int, complex]]:
    """(p, spin of a, spin of b, coefficient): total j, m from orbital l and spin s of two particles with momenta p, -p of shell n."""
    out = []
    for p in shell(n):
        for a in range(-s1, s1 + 1):
            for b in range(-s2, s2 + 1):
                c = sum(su2_clebsch(l, ml, s, a + b, j, m) * su2_clebsch(s1, a, s2, b, s, a + b) * harmonic(l, ml, p) for ml in range(-l, l + 1))
                if abs(c) > 1e-9:
                    out.append((p, a, b, c))
    return out


def two_particle_rows() -> list[tuple]:
    """Pseudoscalar-vector and vector-vector bases in S and P wave, J up to 1, shell 1."""
    out = []
    for case, s1, s2, s in (("PV", 0, 1, 1), ("VV", 1, 1, 0), ("VV1", 1, 1, 1)):
        for l in (0, 1):
            for j in range(abs(l - s), min(1, l + s) + 1):
                for m in range(-j, j + 1):
                    out += [(f"{case}-{'SP'[l]}", j, m, *p, a, b, round(complex(c).real, 6), round(complex(c).imag, 6)) for p, a, b, c in two_particle(j, m, l, s, s1, s2, 1)]
    return out


_ = irrep
