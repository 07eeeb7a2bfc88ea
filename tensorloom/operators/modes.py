"""Lowest modes of the covariant Laplacian by Chebyshev-filtered subspace iteration on rows.

A block of fields is rows (t, site, colour, e). The operator is a table of links
that the block is joined with; a filter of degree k is k joins in a row, each row
carrying the last two terms of the recurrence. Orthonormalising and choosing the
best combinations (Rayleigh-Ritz) needs two small matrices a slice, made by grouped
sums, so that a task never holds a slice's fields or its operator: at most a block's
coefficients. Each round is checkpointed, which cuts its lineage, and rounds end
when the largest residual |H v - value v| is small enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.fields import SITE, Extents, linked
from tensorloom.sources.staging import cut

#: No eigenvalue of the Laplacian of unitary links is larger.
TOP = 12.0
PART = ("re", "im")


def matrix_rows(gauge: DataFrame, ext: Extents) -> DataFrame:
    """The Laplacian as rows: field site and colour (t, fx, fy, fz, k), target (x, y, z, c), entry (wr, wi), own for the diagonal."""
    near = linked(gauge, ext).select("t", "fx", "fy", "fz", "k", "x", "y", "z", "c", (-F.col("ur")).cast("double").alias("wr"), (-F.col("ui")).cast("double").alias("wi"), F.lit(False).alias("own"))
    sites = gauge.select("t", "x", "y", "z", F.explode(F.array("a", "b")).alias("c")).distinct()
    own = sites.select("t", *[F.col(c).alias(f"f{c}") for c in "xyz"], F.col("c").alias("k"), "x", "y", "z", "c", F.lit(6.0).alias("wr"), F.lit(0.0).alias("wi"), F.lit(True).alias("own"))
    return near.unionByName(own)


def start_block(matrix: DataFrame, size: int, seed: int) -> DataFrame:
    """size fields of numbers in [-1, 1) that depend on the seed, the place and e only."""
    e = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("e")
    rows = matrix.where("own").select(*SITE, e).withColumn("e", F.col("e").cast("long"))
    return rows.select(*SITE, "e", *[(F.pmod(F.xxhash64(F.lit(seed), F.lit(p), *SITE, "e"), F.lit(1 << 30)) / float(1 << 29) - 1).alias(p) for p in PART])


def _meets(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """rows (t, x, y, z, c, ...) joined with the entries that they multiply; the rows' place goes by _t, _x, ..."""
    r = rows.select(*[F.col(c).alias(f"_{c}") for c in SITE], *[c for c in rows.columns if c not in SITE])
    return r.join(matrix, [F.col(f"_{a}") == F.col(b) for a, b in zip(SITE, ("t", "fx", "fy", "fz", "k"), strict=True)])


def filtered(block: DataFrame, matrix: DataFrame, degree: int, low: float, top: float = TOP) -> DataFrame:
    """The Chebyshev polynomial of a degree in the operator, small on [low, top] and growing below: (t, x, y, z, c, e, re, im)."""
    centre, half = (top + low) / 2, (top - low) / 2
    wr = (F.col("wr") - F.when(F.col("own"), centre).otherwise(0.0)) / half
    wi = F.col("wi") / half
    now = block.withColumn("pr", F.lit(0.0)).withColumn("pi", F.lit(0.0))
    for step in range(degree):
        own = F.col("own")
        times = 1.0 if step == 0 else 2.0

        def only(x: Column, own=own) -> Column:
            return F.sum(F.when(own, x).otherwise(0.0))

        now = _meets(now, matrix).groupBy(*SITE, "e").agg(
            (F.sum((wr * F.col("re") - wi * F.col("im")) * times) - only(F.col("pr"))).alias("nr"), (F.sum((wr * F.col("im") + wi * F.col("re")) * times) - only(F.col("pi"))).alias("ni"),
            only(F.col("re")).alias("pr"), only(F.col("im")).alias("pi"),
        ).select(*SITE, "e", F.col("nr").alias("re"), F.col("ni").alias("im"), "pr", "pi")
    return now.drop("pr", "pi")


def with_image(block: DataFrame, matrix: DataFrame) -> DataFrame:
    """block with (hr, hi), the operator applied to it, on the same rows: one join."""
    own = F.col("own")
    return _meets(block, matrix).groupBy(*SITE, "e").agg(
        F.sum(F.when(own, F.col("re")).otherwise(0.0)).alias("re"), F.sum(F.when(own, F.col("im")).otherwise(0.0)).alias("im"),
        F.sum(F.col("wr") * F.col("re") - F.col("wi") * F.col("im")).alias("hr"), F.sum(F.col("wr") * F.col("im") + F.col("wi") * F.col("re")).alias("hi"),
    )


def gram(block: DataFrame) -> DataFrame:
    """(t, e, f, gr, gi, kr, ki): overlaps of fields e and f, and of e with the image of f; block has images."""
    other = block.select(*SITE, F.col("e").alias("f"), *[F.col(c).alias(f"f{c}") for c in ("re", "im", "hr", "hi")])
    both = block.select(*SITE, "e", *PART).join(other, list(SITE))

    def dot(a: str, b: str) -> tuple[Column, Column]:
        return F.sum(F.col("re") * F.col(a) + F.col("im") * F.col(b)), F.sum(F.col("re") * F.col(b) - F.col("im") * F.col(a))

    (gr, gi), (kr, ki) = dot("fre", "fim"), dot("fhr", "fhi")
    return both.groupBy("t", "e", "f").agg(gr.alias("gr"), gi.alias("gi"), kr.alias("kr"), ki.alias("ki"))


def _ritz(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Best combinations of one slice's block: values rising, coefficients (n, e). Directions that the block lacks are left out."""
    m = int(rows["e"].max()) + 1
    g, k = np.zeros((m, m), complex), np.zeros((m, m), complex)
    at = rows["e"].to_numpy(int), rows["f"].to_numpy(int)
    g[at] = rows["gr"].to_numpy(float) + 1j * rows["gi"].to_numpy(float)
    k[at] = rows["kr"].to_numpy(float) + 1j * rows["ki"].to_numpy(float)
    size = np.sqrt(np.abs(np.diag(g)))
    scale = 1 / np.where(size > 0, size, 1)
    g, k = g * scale[:, None] * scale, k * scale[:, None] * scale
    weight, base = np.linalg.eigh((g + g.conj().T) / 2)
    good = weight > 1e-13 * weight.max(initial=0)
    base = base[:, good] / np.sqrt(weight[good])
    small = base.conj().T @ k @ base
    values, own = np.linalg.eigh((small + small.conj().T) / 2)
    c = scale[:, None] * (base @ own)
    i = np.indices(c.shape).reshape(2, -1)
    return pd.DataFrame({"t": int(key[0]), "n": i[1], "f": i[0], "cr": c.reshape(-1).real, "ci": c.reshape(-1).imag, "value": values[i[1]]})


def combined(block: DataFrame) -> DataFrame:
    """The block's best combinations, rising: (t, x, y, z, c, e, re, im, hr, hi, value)."""
    c = gram(block).groupBy("t").applyInPandas(_ritz, "t long, n long, f long, cr double, ci double, value double").withColumnRenamed("f", "e")
    both = block.join(c, ["t", "e"])

    def times(a: str, b: str) -> list[Column]:
        return [F.sum(F.col("cr") * F.col(a) - F.col("ci") * F.col(b)).alias(a), F.sum(F.col("cr") * F.col(b) + F.col("ci") * F.col(a)).alias(b)]

    return both.groupBy(*SITE, F.col("n").alias("e")).agg(*times("re", "im"), *times("hr", "hi"), F.first("value").alias("value"))


def residuals(block: DataFrame) -> DataFrame:
    """(t, e, value, residual) of fields with images."""
    off = (F.col("hr") - F.col("value") * F.col("re")) ** 2 + (F.col("hi") - F.col("value") * F.col("im")) ** 2
    return block.groupBy("t", "e").agg(F.first("value").alias("value"), F.sqrt(F.sum(off)).alias("residual"))


def lowest(gauge: DataFrame, ext: Extents, modes: int, guard: int | None = None, degree: int = 8, tol: float = 1e-9, rounds: int = 40, seed: int = 1, top: float = TOP) -> DataFrame:
    """(t, e, value, x, y, z, c, re, im): the lowest modes of each slice, values rising.

    guard: fields that the block has beyond the modes (by default as many as
    modes); degree: of the filter of a round; rounds: after so many without
    residuals below tol it gives up with an error. A mode's first entry (of the
    smallest z, y, x, c) is real and not negative. gauge: unitary links (t, x, y, z,
    mu, a, b, re, im); top: a bound of all eigenvalues. To the driver come three
    numbers a round.
    """
    size = modes + (modes if guard is None else guard)
    matrix = cut(matrix_rows(gauge, ext))
    least = matrix.where("own").groupBy("t").count().agg(F.min("count")).first()[0] or 0
    if modes > least:
        raise ValueError(f"{modes} modes of slices with {least} entries")
    block, low = start_block(matrix, min(size, least), seed), top / 2
    for _ in range(rounds):
        block = cut(combined(with_image(filtered(block, matrix, degree, low, top), matrix)))
        state = residuals(block).agg(F.max(F.when(F.col("e") < modes, F.col("residual"))).alias("worst"), F.max("value").alias("high")).first()
        if state["worst"] <= tol:
            break
        low = min(max(state["high"], 0.01 * top), 0.95 * top)
        block = block.select(*SITE, "e", *PART)
    else:
        raise ArithmeticError(f"residuals of {state['worst']:.2g} after {rounds} rounds")
    block = block.where(F.col("e") < modes)
    first = block.groupBy("t", "e").agg(F.min(F.struct("z", "y", "x", "c", "re", "im")).alias("first")).select("t", "e", F.col("first.re").alias("ar"), F.col("first.im").alias("ai"))
    size_ = F.sqrt(F.col("ar") ** 2 + F.col("ai") ** 2)
    turn = [F.when(size_ > 1e-14, F.col("ar") / size_).otherwise(1.0), F.when(size_ > 1e-14, -F.col("ai") / size_).otherwise(0.0)]
    both = block.join(first, ["t", "e"])
    return both.select("t", "e", "value", "x", "y", "z", "c", (F.col("re") * turn[0] - F.col("im") * turn[1]).alias("re"), (F.col("re") * turn[1] + F.col("im") * turn[0]).alias("im"))
