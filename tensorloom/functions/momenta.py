"""Momentum lists, shells and phases."""

from __future__ import annotations

from itertools import product

Vec = tuple[int, int, int]

#: The list of one momentum a shell that tests use.
TEST_LIST: tuple[Vec, ...] = (
    (0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 1, 1), (0, 0, 2), (0, 1, 2), (1, 1, 2), (0, 2, 2), (1, 2, 2), (0, 0, 3), (0, 1, 3), (1, 1, 3),
    (0, 2, 3), (1, 2, 3), (2, 2, 3), (0, 3, 3), (1, 3, 3), (2, 3, 3), (3, 3, 3), (0, 0, 4), (0, 0, 5), (0, 0, 6), (0, 0, 7),
)


def upto(most: int) -> list[Vec]:
    """All momenta with p^2 <= most: by shell, then magnitudes rising, then positions, + before -."""
    reach = int(most**0.5)
    every = [p for p in product(range(-reach, reach + 1), repeat=3) if sum(x * x for x in p) <= most]
    return sorted(every, key=lambda p: (sum(x * x for x in p), sorted(map(abs, p)), [abs(x) for x in p], [x < 0 for x in p]))


def momentum_list(kind: int) -> list[Vec]:
    """1: zero only; 3: all with p^2 up to it, by shell; 9: likewise, by (pz, py, px); 0: the test list."""
    if kind == 0:
        return list(TEST_LIST)
    if kind in (1, 3):
        return upto(kind if kind > 1 else 0)
    if kind == 9:
        return sorted(upto(9), key=lambda p: p[::-1])
    raise ValueError(f"unknown momentum list {kind}")


def shell(n: int, reach: int = 3) -> list[Vec]:
    """Momenta of [-reach, reach]^3 with p^2 = n."""
    return [p for p in product(range(-reach, reach + 1), repeat=3) if sum(x * x for x in p) == n]


def back_to_back(n: int) -> list[tuple[Vec, Vec]]:
    return [(p, tuple(-x for x in p)) for p in shell(n)]
