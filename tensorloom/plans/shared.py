"""One plan for many contractions.

A term is a product of tensors by name with labels on their axes. Terms are
contracted pair by pair, and a partial contraction is a node known by its form:
which nodes it joins, which of their axes meet, which stay. Two partial
contractions of equal form are one node whatever their labels are called, in one
term or in several, so a sum of diagrams makes each sub-contraction once. The
order is greedy by expected rows, a pair that is a node already costs nothing.

`cfg` is no label of a term: a tensor that has it keeps it, entries of two
configurations never meet, and it is a key of the final sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.plans.einsum import CFG, CROSS_ROWS, Tensor, pair, summed

#: (name, labels): an operand of a term. A label that is repeated within an operand takes its diagonal.
Operand = tuple[Hashable, tuple[str, ...]]


@dataclass(frozen=True)
class Part:
    """A node with this term's labels of its axes."""

    node: int
    labels: tuple[str, ...]


@dataclass
class Node:
    """made: ("leaf", name), ("one", node, numbers, kept) or ("pair", node, node, numbers, numbers, kept)."""

    made: tuple
    sizes: tuple[int, ...]
    rows: float


class Plan:
    """leaves: tensors by name, of the axes that the terms label in order, `cfg` aside."""

    def __init__(self, leaves: dict[Hashable, Tensor]):
        self.leaves = leaves
        self.nodes: list[Node] = []
        self.place: dict[tuple, int] = {}
        self.terms: list[tuple[Fraction, Part]] = []
        self.apart = 0  # joins that the terms would need one by one
        self.widest: Counter = Counter()

    # --- making nodes -------------------------------------------------------------------------

    def _node(self, made: tuple, sizes: tuple[int, ...], rows: float) -> int:
        if made not in self.place:
            self.place[made] = len(self.nodes)
            self.nodes.append(Node(made, sizes, rows))
        return self.place[made]

    def _leaf(self, name: Hashable, labels: tuple[str, ...]) -> Part:
        t = self.leaves[name]
        axes = [a for a in t.axes if a != CFG]
        if len(axes) != len(labels):
            raise ValueError(f"{len(labels)} labels for axes {axes} of {name}")
        return Part(self._node(("leaf", name), tuple(t.sizes.get(a, 8) for a in axes), t.expected()), tuple(labels))

    def _one(self, x: Part, keep: set[str]) -> Part:
        """x without repeated labels and without those not kept."""
        names = list(dict.fromkeys(x.labels))
        out = tuple(a for a in names if a in keep)
        if out == x.labels:
            return x
        numbers = tuple(names.index(a) for a in x.labels)
        size = dict(zip(x.labels, self.nodes[x.node].sizes, strict=True))
        sizes = tuple(size[a] for a in out)
        dense = float(np.prod([size[a] for a in names] or [1])) if len(names) < len(x.labels) else self.nodes[x.node].rows
        made = ("one", x.node, numbers, tuple(names.index(a) for a in out))
        return Part(self._node(made, sizes, min(dense, self.nodes[x.node].rows, float(np.prod(sizes or [1])))), out)

    def _form(self, a: Part, b: Part, keep: set[str]) -> tuple[tuple, tuple[str, ...]]:
        """What the pair is as a node, and the labels of its axes; the order of the two does not matter."""
        best = None
        for x, y in ((a, b), (b, a)):
            names = list(dict.fromkeys(x.labels + y.labels))
            out = tuple(n for n in names if n in keep)
            made = ("pair", x.node, y.node, tuple(names.index(n) for n in x.labels), tuple(names.index(n) for n in y.labels), tuple(names.index(n) for n in out))
            if best is None or made < best[0]:
                best = (made, out)
        return best

    def _rank(self, a: Part, b: Part, keep: set[str]) -> tuple:
        made, out = self._form(a, b, keep)
        size = dict(zip(a.labels, self.nodes[a.node].sizes, strict=True)) | dict(zip(b.labels, self.nodes[b.node].sizes, strict=True))
        common = set(a.labels) & set(b.labels)
        before = self.nodes[a.node].rows * self.nodes[b.node].rows / float(np.prod([size[n] for n in common] or [1]))
        after = float(np.prod([size[n] for n in out] or [1]))
        return (not common, made not in self.place, before + after, before, made)

    def _pair(self, a: Part, b: Part, keep: set[str]) -> Part:
        made, out = self._form(a, b, keep)
        size = dict(zip(a.labels, self.nodes[a.node].sizes, strict=True)) | dict(zip(b.labels, self.nodes[b.node].sizes, strict=True))
        sizes = tuple(size[n] for n in out)
        return Part(self._node(made, sizes, min(float(np.prod(sizes or [1])), self.nodes[a.node].rows * self.nodes[b.node].rows)), out)

    def add(self, operands: Iterable[Operand], out: tuple[str, ...], weight: Fraction | float = 1) -> Part:
        """One term more: the contraction of operands to the labels of out."""
        work = [self._leaf(name, labels) for name, labels in operands]
        self.apart += len(work) - 1
        for i, x in enumerate(work):
            rest = set(out).union(*[y.labels for j, y in enumerate(work) if j != i])
            work[i] = self._one(x, rest)
        while len(work) > 1:
            ranked = []
            for i in range(len(work)):
                for j in range(i + 1, len(work)):
                    rest = set(out).union(*[t.labels for k, t in enumerate(work) if k not in (i, j)])
                    ranked.append((self._rank(work[i], work[j], rest), i, j, rest))
            _, i, j, rest = min(ranked, key=lambda r: r[:3])
            made = self._pair(work[i], work[j], rest)
            work = [t for k, t in enumerate(work) if k not in (i, j)] + [made]
        missing = set(out) - set(work[0].labels)
        if missing:
            raise ValueError(f"a term does not depend on {sorted(missing)}")
        self.terms.append((weight, work[0]))
        return work[0]

    # --- what the plan costs ------------------------------------------------------------------

    @property
    def joins(self) -> int:
        """Joins that the whole plan makes."""
        return sum(n.made[0] == "pair" for n in self.nodes)

    def uses(self) -> Counter:
        """How many nodes and terms read each node; an equal term counts once."""
        out: Counter = Counter({part.node for _, part in self.terms})
        for n in self.nodes:
            if n.made[0] == "one":
                out[n.made[1]] += 1
            elif n.made[0] == "pair":
                out.update(n.made[1:3])
        return out

    def _weights(self) -> dict[tuple[int, tuple[str, ...]], Fraction | float]:
        out: dict = {}
        for w, part in self.terms:
            out[part.node, part.labels] = out.get((part.node, part.labels), 0) + w
        return {k: w for k, w in out.items() if w != 0}

    def _wanted(self) -> set[int]:
        """Nodes that terms of some weight need."""
        out, open_ = set(), [node for node, _ in self._weights()]
        while open_:
            n = open_.pop()
            if n not in out:
                out.add(n)
                made = self.nodes[n].made
                open_ += made[1:2] if made[0] == "one" else made[1:3] if made[0] == "pair" else ()
        return out

    # --- frames -------------------------------------------------------------------------------

    def tensors(self, hold: Callable[[DataFrame], DataFrame]) -> list[Tensor]:
        """The nodes' tensors, axes x0, x1, ...; pairs that are read more than once go through hold."""
        uses, made, wanted = self.uses(), [], self._wanted()
        for at, n in enumerate(self.nodes):
            if at not in wanted:
                made.append(None)
                continue
            if n.made[0] == "leaf":
                t = self.leaves[n.made[1]]
                axes = [a for a in t.axes if a != CFG]
                t = t.relabelled(**{a: f"x{i}" for i, a in enumerate(axes)})
            elif n.made[0] == "one":
                t = self._reduced(made[n.made[1]], n)
            else:
                t = self._joined(made[n.made[1]], made[n.made[2]], n)
                if uses[at] > 1:
                    t = Tensor(hold(t.frame), t.axes, t.sizes, t.rows, t.literal)
            made.append(t)
        return made

    @staticmethod
    def _named(n: Node, batch: tuple[str, ...], t: Tensor, kept: tuple[int, ...]) -> Tensor:
        """t, of axes n0, n1, ..., with those of kept as x0, x1, ..."""
        frame = t.frame.select(*batch, *[F.col(f"n{k}").alias(f"x{i}") for i, k in enumerate(kept)], "re", "im")
        return Tensor(frame, (*batch, *[f"x{i}" for i in range(len(kept))]), {f"x{i}": s for i, s in enumerate(n.sizes)}, n.rows, t.literal)

    def _reduced(self, t: Tensor, n: Node) -> Tensor:
        _, _, numbers, kept = n.made
        frame = t.frame
        for i, k in enumerate(numbers):
            if numbers.index(k) != i:
                frame = frame.where(F.col(f"x{i}") == F.col(f"x{numbers.index(k)}"))
        first = {k: numbers.index(k) for k in numbers}
        frame = frame.select(*t.batch, *[F.col(f"x{i}").alias(f"n{k}") for k, i in first.items()], "re", "im")
        if len(kept) < len(first):
            frame = summed(frame, (*t.batch, *[f"n{k}" for k in kept]))
        return self._named(n, t.batch, Tensor(frame, t.batch, literal=t.literal), kept)

    def _joined(self, a: Tensor, b: Tensor, n: Node) -> Tensor:
        _, _, _, left, right, kept = n.made
        a = a.relabelled(**{f"x{i}": f"n{k}" for i, k in enumerate(left)})
        b = b.relabelled(**{f"x{i}": f"n{k}" for i, k in enumerate(right)})
        if not set(left) & set(right) and not (a.batch and b.batch) and a.expected() * b.expected() > CROSS_ROWS:
            raise ValueError("two parts share no label and are too large to multiply")
        got = pair(a, b, {f"n{k}" for k in kept})
        return self._named(n, got.batch, got, kept)

    def total(self, out: tuple[str, ...], hold: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
        """(cfg, out, re, im): the weighted sum of all terms. Whole numbers stay whole if all weights are."""
        made = self.tensors(hold)
        frames, batch = [], ()
        for (node, labels), w in self._weights().items():
            t = made[node]
            batch = batch or t.batch
            if t.batch != batch:
                raise ValueError("some terms have configurations and some have none")
            c = int(w) if float(w) == int(w) else float(w)
            frames.append(t.frame.select(*batch, *[F.col(f"x{labels.index(a)}").alias(a) for a in out], (F.col("re") * c).alias("re"), (F.col("im") * c).alias("im")))
        if not frames:
            raise ValueError("no term is left")
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        return summed(every, (*batch, *out))
