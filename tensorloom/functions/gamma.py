"""Spin matrices: 16 products of four generators, their names and families."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The four generators as (row, column) -> power of i.
GENERATORS = (
    {(0, 3): 1, (1, 2): 1, (2, 1): 3, (3, 0): 3},
    {(0, 3): 2, (1, 2): 0, (2, 1): 0, (3, 0): 2},
    {(0, 2): 1, (1, 3): 3, (2, 0): 3, (3, 1): 1},
    {(0, 2): 0, (1, 3): 0, (2, 0): 0, (3, 1): 0},
)
UNITS = (1, 1j, -1, -1j)


def gamma(n: int) -> np.ndarray:
    """The product of the generators whose bits are set in n, lowest first."""
    if not 0 <= n <= 15:
        raise ValueError("gamma index must be in 0..15")
    out = np.eye(4, dtype=complex)
    for bit, entries in enumerate(GENERATORS):
        if n >> bit & 1:
            m = np.zeros((4, 4), complex)
            for (i, j), p in entries.items():
                m[i, j] = UNITS[p]
            out = out @ m
    return out


def entries(m: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Non-zero entries (i, j, re, im) of a matrix over the Gaussian integers."""
    return [(int(i), int(j), int(round(m[i, j].real)), int(round(m[i, j].imag))) for i, j in zip(*np.nonzero(np.abs(m) > 1e-9), strict=True)]


def source_dagger(m: np.ndarray) -> np.ndarray:
    """gamma_8 m^dagger gamma_8."""
    g = gamma(8)
    return g @ m.conj().T @ g


def label(n: int) -> str:
    """The usual name of gamma(n)."""
    axes = {14: 1, 13: 2, 11: 3, 1: 1, 2: 2, 4: 3, 9: 1, 10: 2, 12: 3, 6: 1, 5: 2, 3: 3}
    tail = {0: "", 15: "γ5", 7: "γ5γ4", 8: "γ4"}
    if n in tail:
        return tail[n]
    end = "γ5" if n in (14, 13, 11) else "γ4" if n in (9, 10, 12) else "γ5γ4" if n in (6, 5, 3) else ""
    return f"γ{axes[n]}{end}"


@dataclass(frozen=True)
class Family:
    name: str
    members: tuple[int, ...]
    group: str
    parity: int
    charge: int
    hermitian: int


#: The eight families of bilinears.
FAMILIES = (
    Family("a0", (0,), "A_1", 1, 1, 1),
    Family("pi", (15,), "A_1", -1, 1, -1),
    Family("pi2", (7,), "A_1", -1, 1, 1),
    Family("b0", (8,), "A_1", 1, -1, 1),
    Family("a1", (14, 13, 11), "T_1", 1, 1, -1),
    Family("rho", (1, 2, 4), "T_1", -1, -1, -1),
    Family("rho2", (9, 10, 12), "T_1", -1, -1, 1),
    Family("b1", (6, 5, 3), "T_1", 1, -1, -1),
)


def family(name: str) -> Family:
    return next(f for f in FAMILIES if f.name == name)


#: Members of a vector family that carry a minus sign: gamma_1 gamma_3 stands for the second axis with the opposite order.
FLIPPED = (5, 13)


def sign(n: int) -> int:
    return -1 if n in FLIPPED else 1


def rotation_image(spinor: np.ndarray, n: int) -> tuple[int, int]:
    """(sign, m) with spinor gamma(n) spinor^-1 = sign gamma(m), for spinors of the cubic group that permute the family."""
    moved = spinor @ gamma(n) @ np.linalg.inv(spinor)
    for m in range(16):
        got = np.trace(gamma(m).conj().T @ moved) / 4
        if abs(abs(got) - 1) < 1e-6 and abs(got.imag) < 1e-6:
            return int(round(got.real)), m
    raise ValueError("no single image")


def conjugate_image(n: int) -> tuple[int, int]:
    """(sign, n) of gamma_8 gamma(n)^dagger gamma_8."""
    m = source_dagger(gamma(n))
    got = np.trace(gamma(n).conj().T @ m) / 4
    return int(round(got.real)), n
