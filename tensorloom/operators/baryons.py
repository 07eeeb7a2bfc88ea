"""Three-quark vertices: antisymmetric colour elementals of ordered mode triples, and spin structures on them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.plans.einsum import Tensor, contract


def parity(order: tuple[int, ...]) -> int:
    return -1 if sum(a > b for i, a in enumerate(order) for b in order[i + 1 :]) % 2 else 1


#: (places of the three modes, sign) of every order of a triple.
ORDERS = [(p, parity(p)) for p in permutations(range(3))]


def _product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def triplets(v: Tensor) -> Tensor:
    """(t, a, b, c): sum over sites of the determinant of three modes' colours, from modes v(t, e, x, c) of three colours.

    Made for a < b < c only, one sixth of all, then written in all orders with
    their signs: joins by site of two modes of different colours, then of the third
    mode at the colour that is left.
    """
    lead = v.batch
    own = [*lead, "t", "x"]
    f = v.frame

    def mode(n: int) -> DataFrame:
        return f.select(*own, F.col("e").alias(f"e{n}"), F.col("c").alias(f"c{n}"), F.col("re").alias(f"r{n}"), F.col("im").alias(f"i{n}"))

    both = mode(0).join(mode(1), own).where("e0 < e1 AND c0 <> c1")
    re, im = _product((F.col("r0"), F.col("i0")), (F.col("r1"), F.col("i1")))
    odd = F.when(F.pmod(F.col("c1") - F.col("c0"), F.lit(3)) == 1, 1).otherwise(-1)  # the sign of (c0, c1, the third)
    both = both.select(*own, "e0", "e1", (3 - F.col("c0") - F.col("c1")).alias("c2"), (re * odd).alias("re"), (im * odd).alias("im"))
    both = both.groupBy(*own, "e0", "e1", "c2").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    all3 = both.join(mode(2), [*own, "c2"]).where("e1 < e2")
    re, im = _product((F.col("re"), F.col("im")), (F.col("r2"), F.col("i2")))
    rising = all3.select(*lead, "t", "e0", "e1", "e2", re.alias("re"), im.alias("im")).groupBy(*lead, "t", "e0", "e1", "e2").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    modes = ("e0", "e1", "e2")
    every = F.explode(F.array(*[F.struct(*[F.col(modes[k]).alias(n) for k, n in zip(p, "abc", strict=True)], F.lit(s).alias("s")) for p, s in ORDERS])).alias("w")
    frame = rising.select(*lead, "t", every, "re", "im").select(*lead, "t", "w.a", "w.b", "w.c", (F.col("re") * F.col("w.s")).alias("re"), (F.col("im") * F.col("w.s")).alias("im"))
    n = v.sizes["e"]
    return Tensor(frame, (*lead, "t", "a", "b", "c"), {"t": v.sizes["t"], "a": n, "b": n, "c": n}, None if n is None else float(v.sizes["t"] * n * (n - 1) * (n - 2)))


def vertex(elementals: Tensor, spins: Tensor) -> Tensor:
    """(t, i, j, k, a, b, c): spins (i, j, k) of a baryon's quarks times its elementals."""
    return contract([spins, elementals], ("t", "i", "j", "k", "a", "b", "c"))
