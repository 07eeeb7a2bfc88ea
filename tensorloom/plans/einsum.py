"""Contractions over named axes.

A tensor is a frame of its non-zero entries: one integer column an axis, and the
two parts `re`, `im`. Contracting is joining on shared labels and summing what
no one needs any more. Catalyst never moves a sum below a join, so this planner
does: it always contracts the pair whose result is expected to be smallest and
sums at once. The same expression can also be written as one flat SQL query
(the oracle), or run as dense blocks through numpy.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a literal table (gamma entries, operator terms) is broadcast.
LITERAL_ROWS = 4096
#: Rows that the product of two parts without a common label may have.
CROSS_ROWS = 1e8
#: Entries that one batch key's largest operand or result may have to be contracted as dense blocks in one task.
BLOCK_ENTRIES = 1 << 24
#: Entries of results that a task holds before it sends them on, or one result if that is larger.
HELD_ENTRIES = 1 << 20
CFG = "cfg"


@dataclass(frozen=True)
class Tensor:
    """axes: the columns of frame besides re and im; sizes: their extents; rows: expected non-zero entries; literal: a fixed small table."""

    frame: DataFrame
    axes: tuple[str, ...]
    sizes: dict[str, int] = field(default_factory=dict)
    rows: float | None = None
    literal: bool = False

    def renamed(self, *labels: str) -> Tensor:
        if len(labels) != len(self.axes):
            raise ValueError(f"{len(labels)} labels for axes {self.axes}")
        sizes = {b: self.sizes.get(a, 8) for a, b in zip(self.axes, labels, strict=True)}
        columns = [F.col(a).alias(b) for a, b in zip(self.axes, labels, strict=True)]
        return replace(self, frame=self.frame.select(*columns, "re", "im"), axes=labels, sizes=sizes)

    def relabelled(self, **names: str) -> Tensor:
        """Axes by name; those not named stay, `cfg` among them."""
        return self.renamed(*[names.get(a, a) for a in self.axes])

    @property
    def batch(self) -> tuple[str, ...]:
        """("cfg",) if the tensor holds more than one configuration: a label that no contraction sums over."""
        return tuple(a for a in self.axes if a == CFG)

    def ordered(self, *axes: str) -> Tensor:
        return replace(self, frame=self.frame.select(*axes, "re", "im"), axes=axes)

    def conj(self) -> Tensor:
        return replace(self, frame=self.frame.withColumn("im", -F.col("im")))

    def where(self, condition: Column | str) -> Tensor:
        return replace(self, frame=self.frame.where(condition), rows=None if self.rows is None else self.rows / 2)

    def scaled(self, re: float | Column, im: float | Column = 0) -> Tensor:
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (re, im))
        return replace(self, frame=self.frame.select(*self.axes, (F.col("re") * a - F.col("im") * b).alias("re"), (F.col("re") * b + F.col("im") * a).alias("im")))

    def expected(self) -> float:
        return self.rows if self.rows is not None else float(np.prod([self.sizes.get(a, 8) for a in self.axes]))

    def dense(self) -> np.ndarray:
        """For tests and small results only."""
        out = np.zeros([self.sizes[a] for a in self.axes], complex)
        for r in self.frame.toPandas().itertuples(index=False):
            d = r._asdict()
            out[tuple(int(d[a]) for a in self.axes)] += d["re"] + 1j * d["im"]
        return out


def add(*terms: Tensor) -> Tensor:
    """The sum of tensors over the same axes."""
    first = terms[0]
    frame = reduce(DataFrame.unionByName, [t.frame.select(*first.axes, "re", "im") for t in terms])
    return replace(first, frame=summed(frame, first.axes), rows=None)


def summed(frame: DataFrame, keep: Iterable[str]) -> DataFrame:
    return frame.groupBy(*keep).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def pair(a: Tensor, b: Tensor, keep: set[str]) -> Tensor:
    """Join on the shared labels, multiply, and sum out the labels not in keep."""
    shared = [x for x in a.axes if x in b.axes]
    keep = set(keep) | {CFG}
    if not shared and a.expected() * b.expected() > CROSS_ROWS:
        raise ValueError(f"{a.axes} and {b.axes} share no label and are too large to multiply")
    left, right = (a, b) if not a.literal else (b, a)
    r = right.frame.select(*[F.col(x).alias(f"r_{x}") for x in right.axes], F.col("re").alias("r_re"), F.col("im").alias("r_im"))
    r = F.broadcast(r) if right.literal and right.expected() <= LITERAL_ROWS else r
    on = [F.col(x) == F.col(f"r_{x}") for x in shared]
    joined = left.frame.join(r, on, "inner") if on else left.frame.crossJoin(r)
    axes = [*left.axes, *[x for x in right.axes if x not in shared]]
    columns = [F.col(x if x in left.axes else f"r_{x}").alias(x) for x in axes]
    product = joined.select(
        *columns,
        (F.col("re") * F.col("r_re") - F.col("im") * F.col("r_im")).alias("re"),
        (F.col("re") * F.col("r_im") + F.col("im") * F.col("r_re")).alias("im"),
    )
    sizes = {**a.sizes, **b.sizes}
    out = tuple(x for x in axes if x in keep)
    dense = float(np.prod([sizes.get(x, 8) for x in out]))
    product = summed(product, out) if len(out) < len(axes) else product
    literal = a.literal and b.literal
    return Tensor(product, out, sizes, min(dense, a.expected() * b.expected()), literal)


def cost(a: Tensor, b: Tensor, keep: set[str]) -> tuple[float, float]:
    """Expected rows of the result after the sum, and of the join before it."""
    sizes = {**a.sizes, **b.sizes}
    both = set(a.axes) | set(b.axes)
    shared = float(np.prod([sizes.get(x, 8) for x in set(a.axes) & set(b.axes)] or [1]))
    after = float(np.prod([sizes.get(x, 8) for x in both & keep] or [1]))
    before = a.expected() * b.expected() / shared
    return max(after, 1.0) + before, before


def contract(operands: list[Tensor], out: tuple[str, ...]) -> Tensor:
    """The contraction of all operands; out: the labels that stay, `cfg` with them where an operand has it. Pairs without a shared label are multiplied last."""
    work = list(operands)
    out = with_batch(operands, out)
    if len(work) == 1:
        t = work[0]
        return replace(t, frame=summed(t.frame, out), axes=tuple(out), rows=None)
    while len(work) > 1:
        best = None
        for i in range(len(work)):
            for j in range(i + 1, len(work)):
                rest = set(out).union(*[t.axes for k, t in enumerate(work) if k not in (i, j)])
                apart = not set(work[i].axes) & set(work[j].axes)
                rank = (apart, *cost(work[i], work[j], rest))
                if best is None or rank < best[0]:
                    best = (rank, i, j, rest)
        _, i, j, rest = best
        made = pair(work[i], work[j], rest)
        work = [t for k, t in enumerate(work) if k not in (i, j)] + [made]
    last = work[0]
    frame = last.frame if set(last.axes) == set(out) else summed(last.frame, out)
    return replace(last, frame=frame.select(*out, "re", "im"), axes=tuple(out))


def with_batch(operands: list[Tensor], out: tuple[str, ...]) -> tuple[str, ...]:
    """out with `cfg` first if any operand has it: entries of two configurations never meet, tensors without `cfg` hold for all."""
    return (CFG, *out) if CFG not in out and any(t.batch for t in operands) else tuple(out)


def blocks_fit(operands: list[Tensor], out: tuple[str, ...], batch: tuple[str, ...]) -> bool:
    """Whether the contraction can run as dense blocks: all extents known, every block small, the entries of a key many enough to pay."""
    sizes = {k: v for t in operands for k, v in t.sizes.items()}
    inner = [[a for a in t.axes if a not in (*batch, CFG)] for t in operands] + [[a for a in out if a not in (*batch, CFG)]]
    if any(a not in sizes for x in inner for a in x):
        return False
    return 16 <= max(float(np.prod([sizes[a] for a in x])) for x in inner) <= BLOCK_ENTRIES


def contract_blocks(operands: list[Tensor], out: tuple[str, ...], batch: tuple[str, ...]) -> Tensor:
    """The same by dense blocks: the entries of one batch key (labels that out keeps) meet in one numpy einsum.

    An operand becomes one row of packed entries for each value of its own batch
    labels, so only those rows, not single entries, are repeated for the keys of
    the other operands. Blocks are dense in the task only; zeros are left out again. Whole numbers stay
    whole numbers as long as sums are below 2**53.
    """
    out = with_batch(operands, out)
    batch = with_batch(operands, batch)
    labels = sorted({a for t in operands for a in t.axes})
    number_of = {a: i for i, a in enumerate(labels)}
    sizes = {k: v for t in operands for k, v in t.sizes.items()}
    inner = [[a for a in t.axes if a not in batch] for t in operands]
    free = [a for a in out if a not in batch]
    shapes = [[sizes[a] for a in x] for x in inner]
    places, result = [[number_of[a] for a in x] for x in inner], [number_of[a] for a in free]

    def operands_of(dense: list[np.ndarray]) -> list:
        return [y for x, at in zip(dense, places, strict=True) for y in (x, at)] + [result]

    path = np.einsum_path(*operands_of([np.broadcast_to(0j, x) for x in shapes]), optimize="optimal")[0]
    whole = all(dict(t.frame.dtypes)[c] in ("bigint", "int") for t in operands for c in ("re", "im"))
    kinds = {b: dict(t.frame.dtypes)[b] for t in operands for b in t.axes if b in batch}
    both, names = None, []
    for i, (t, own) in sorted(enumerate(zip(operands, inner, strict=True)), key=lambda x: -len([b for b in batch if b in x[1][0].axes])):
        flat = F.lit(0).cast("long")
        for a in own:
            flat = flat * sizes[a] + F.col(a)
        on = [b for b in batch if b in t.axes]
        entry = F.struct(flat.alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
        rows = t.frame.select(*on, entry.alias("x")).groupBy(*on).agg(F.collect_list("x").alias("x"))
        rows = rows.select(*on, *[F.col("x")[c].alias(f"{c}{i}") for c in ("at", "re", "im")])
        common = [b for b in on if b in names]
        both = rows if both is None else (both.join(rows, common) if common else both.crossJoin(rows))
        names += [b for b in on if b not in names]
    number = "long" if whole else "double"
    schema = ", ".join([f"{a} {kinds.get(a, 'long')}" for a in out] + [f"re {number}", f"im {number}"])

    def written(frame: pd.DataFrame, rows: list[int], made: list[np.ndarray]) -> pd.DataFrame:
        got = np.array(made)
        n = got[0].size
        at = np.indices(got.shape[1:]).reshape(len(free), n) if free else np.zeros((0, n), int)
        columns = {a: np.tile(at[i], len(made)) for i, a in enumerate(free)} | {b: np.repeat(frame[b].to_numpy()[rows], n) for b in batch}
        re, im = got.real.reshape(-1), got.imag.reshape(-1)
        if whole:
            if max(np.abs(re).max(initial=0), np.abs(im).max(initial=0)) >= 2.0**53:
                raise OverflowError("sums beyond 2**53: use joins")
            re, im = np.rint(re).astype("i8"), np.rint(im).astype("i8")
        return pd.DataFrame({**columns, "re": re, "im": im})[[*out, "re", "im"]][(re != 0) | (im != 0)]

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        """Results go on as soon as HELD_ENTRIES are together, so a task holds little more than its largest one."""
        for frame in frames:
            made: list[np.ndarray] = []
            rows: list[int] = []
            for k, row in enumerate(frame.to_dict("records")):
                dense = []
                for i, shape in enumerate(shapes):
                    x = np.zeros(int(np.prod(shape)) if shape else 1, complex)
                    np.add.at(x, np.asarray(row[f"at{i}"], np.int64), np.asarray(row[f"re{i}"], float) + 1j * np.asarray(row[f"im{i}"], float))
                    dense.append(x.reshape(shape))
                made.append(np.einsum(*operands_of(dense), optimize=path))
                rows.append(k)
                if len(made) * made[0].size >= HELD_ENTRIES:
                    yield written(frame, rows, made)
                    made, rows = [], []
            if made:
                yield written(frame, rows, made)

    return Tensor(both.mapInPandas(run, schema), tuple(out), sizes)


def evaluate(operands: list[Tensor], out: tuple[str, ...], batch: tuple[str, ...]) -> Tensor:
    """As dense blocks where they fit a task, else by joins."""
    return contract_blocks(operands, out, batch) if blocks_fit(operands, out, batch) else contract(operands, out)


# --- the same expression as flat SQL ---------------------------------------------------------


def _times(parts: list[tuple[str, str]]) -> tuple[str, str]:
    re, im = parts[0]
    for r, i in parts[1:]:
        re, im = f"({re}*{r} - {im}*{i})", f"({re}*{i} + {im}*{r})"
    return re, im


def flat_sql(operands: list[tuple[str, tuple[str, ...], tuple[str, ...], bool]], out: tuple[str, ...], minus: bool = False, extra: str = "") -> str:
    """SELECT over one join of all operands (relation, its columns, labels, conj); labels of out stay."""
    seen: dict[str, str] = {}
    on, parts = [], []
    for k, (_, columns, labels, conj) in enumerate(operands):
        for c, label in zip(columns, labels, strict=True):
            if label.lstrip("-").isdigit():
                on.append(f"o{k}.{c} = {label}")
            elif label in seen:
                on.append(f"o{k}.{c} = {seen[label]}")
            else:
                seen[label] = f"o{k}.{c}"
        parts.append((f"o{k}.re", f"(-o{k}.im)" if conj else f"o{k}.im"))
    re, im = _times(parts)
    sign = "-" if minus else ""
    group = ", ".join(seen[x] for x in out)
    head = "".join(f"{seen[x]} AS {x}, " for x in out)
    froms = ", ".join(f"{r} o{k}" for k, (r, *_) in enumerate(operands))
    where = f" WHERE {' AND '.join(on + ([extra] if extra else []))}" if on or extra else ""
    return f"SELECT {head}CAST({sign}sum({re}) AS BIGINT) AS re, CAST({sign}sum({im}) AS BIGINT) AS im FROM {froms}{where}" + (f" GROUP BY {group}" if group else "")
