"""Quark diagrams as immutable edge tables, and sums of their products.

A diagram has vertices (time, name) and edges: a propagator from a quark of one
vertex to a quark of another. Canonical forms make equal diagrams equal values,
so shared diagrams of a sum are found by hashing and evaluated once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from fractions import Fraction
from itertools import permutations, product
from math import factorial, prod

from tensorloom.plans.einsum import Tensor
from tensorloom.plans.shared import Operand, Plan


@dataclass(frozen=True, order=True)
class Edge:
    src: int
    snk: int
    prop: str
    q_src: int = 0
    q_snk: int = 0


@dataclass(frozen=True, order=True)
class Diagram:
    vertices: tuple[tuple[int, str], ...]
    edges: tuple[Edge, ...]

    @property
    def digest(self) -> str:
        body = [list(self.vertices), [[e.src, e.snk, e.prop, e.q_src, e.q_snk] for e in self.edges]]
        return hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()

    def props(self) -> set[str]:
        return {e.prop for e in self.edges}


#: A sum: product of diagrams (sorted) -> coefficient.
Expression = dict[tuple[Diagram, ...], Fraction]


def from_matrix(matrix: list[list], times: list[int], vertices: list[str], props: list[str | None]) -> Diagram:
    """From an adjacency matrix: an entry is 0, a propagator number, a list of them (parallel edges), or a table by quarks."""
    edges = []
    for i, row in enumerate(matrix):
        for j, x in enumerate(row):
            if isinstance(x, list) and x and isinstance(x[0], list):
                edges += [Edge(i, j, props[p], a, b) for a, own in enumerate(x) for b, p in enumerate(own) if p]
            elif isinstance(x, list):
                edges += [Edge(i, j, props[p], k, k) for k, p in enumerate(x) if p]
            elif x:
                edges.append(Edge(i, j, props[x]))
    return Diagram(tuple(zip(times, vertices, strict=True)), tuple(edges))


def parts(d: Diagram) -> list[list[int]]:
    """Connected sets of vertices that have an edge, in order of their first vertex."""
    near: dict[int, set[int]] = {}
    for e in d.edges:
        near.setdefault(e.src, set()).add(e.snk)
        near.setdefault(e.snk, set()).add(e.src)
    seen, out = set(), []
    for v in sorted(near):
        if v in seen:
            continue
        group, open_ = set(), [v]
        while open_:
            x = open_.pop()
            if x not in group:
                group.add(x)
                open_ += near[x] - group
        seen |= group
        out.append(sorted(group))
    return out


def _kept(d: Diagram, order: list[int]) -> Diagram:
    at = {v: i for i, v in enumerate(order)}
    edges = sorted(Edge(at[e.src], at[e.snk], e.prop, e.q_src, e.q_snk) for e in d.edges if e.src in at)
    return Diagram(tuple(d.vertices[v] for v in order), tuple(edges))


def canonical(d: Diagram) -> Diagram:
    """Vertices by (time, name); of orders of equal vertices the one of the smallest edge table."""
    groups: dict[tuple[int, str], list[int]] = {}
    for i, v in enumerate(d.vertices):
        groups.setdefault(v, []).append(i)
    keys = sorted(groups)
    choices = product(*[permutations(groups[k]) for k in keys])
    return min(_kept(d, [v for group in c for v in group]) for c in choices)


def simplify(d: Diagram) -> tuple[Diagram, ...]:
    """The product of its canonical connected parts; isolated vertices go."""
    return tuple(sorted(canonical(_kept(d, p)) for p in parts(d)))


def simplify_sum(e: Expression) -> Expression:
    out: Expression = {}
    for factors, c in e.items():
        key = tuple(sorted(x for d in factors for x in simplify(d)))
        out[key] = out.get(key, Fraction(0)) + c
    return {k: c for k, c in out.items() if c}


def mapped(e: Expression, f: Callable[[Diagram], Diagram]) -> Expression:
    return simplify_sum({tuple(f(d) for d in k): c for k, c in e.items()}) if len({tuple(f(d) for d in k) for k in e}) == len(e) else _merged((tuple(f(d) for d in k), c) for k, c in e.items())


def _merged(items: Iterable[tuple[tuple[Diagram, ...], Fraction]]) -> Expression:
    out: Expression = {}
    for k, c in items:
        k = tuple(sorted(x for d in k for x in simplify(d)))
        out[k] = out.get(k, Fraction(0)) + c
    return {k: c for k, c in out.items() if c}


def replace_vertices(e: Expression, names: dict[str, str]) -> Expression:
    return mapped(e, lambda d: Diagram(tuple((t, names.get(v, v)) for t, v in d.vertices), d.edges))


def replace_times(e: Expression, times: dict[int, int]) -> Expression:
    return mapped(e, lambda d: Diagram(tuple((times.get(t, t), v) for t, v in d.vertices), d.edges))


def replace_propagators(e: Expression, names: dict[str, str]) -> Expression:
    return mapped(e, lambda d: Diagram(d.vertices, tuple(Edge(x.src, x.snk, names.get(x.prop, x.prop), x.q_src, x.q_snk) for x in d.edges)))


def conjugated(e: Expression) -> Expression:
    """The dagger mark of every vertex changes; times and edges stay."""
    return mapped(e, lambda d: Diagram(tuple((t, v[:-1] if v.endswith("†") else v + "†") for t, v in d.vertices), d.edges))


def acted(e: Expression, image: Callable[[str], list[tuple[complex, str]]], tol: float = 1e-9) -> Expression:
    """A sum after a linear map of its vertices: image gives each vertex name as a combination of names.

    Products of vertices are multiplied out, and equal products of canonical
    diagrams are merged, so an invariant sum comes back as itself. Coefficients below tol are dropped.
    """
    out: dict = {}
    for factors, weight in e.items():
        terms: list[tuple[complex, tuple[Diagram, ...]]] = [(weight, ())]
        for d in factors:
            images = [image(name) for _, name in d.vertices]
            own = []
            for choice in product(*images):
                c = prod((x for x, _ in choice), start=1)
                own.append((c, Diagram(tuple((t, name) for (t, _), (_, name) in zip(d.vertices, choice, strict=True)), d.edges)))
            terms = [(w * c, (*ds, x)) for w, ds in terms for c, x in own]
        for w, ds in terms:
            key = tuple(sorted(x for d in ds for x in simplify(d)))
            out[key] = out.get(key, 0) + w
    clean = {k: complex(w) for k, w in out.items()}
    return {k: w.real if abs(w.imag) <= tol else w for k, w in clean.items() if abs(w) > tol}


def irrep_image(families: dict[str, str], element: str, matrices: Callable[[str], dict]) -> Callable[[str], list[tuple[complex, str]]]:
    """For acted(): vertex `name.k` (or its dagger `name.k†`) is row k of an irrep; an element takes it to the sum over n of D[n, k] (conjugated for daggers) `name.n`.

    families: irrep of each name; matrices: irrep -> element -> matrix. Other vertices stay.
    """

    def image(vertex: str) -> list[tuple[complex, str]]:
        name, _, row = vertex.removesuffix("†").rpartition(".")
        if name not in families:
            return [(1, vertex)]
        mark = "†" if vertex.endswith("†") else ""
        m = matrices(families[name])[element]
        return [(complex(m[n, int(row)]).conjugate() if mark else complex(m[n, int(row)]), f"{name}.{n}{mark}") for n in range(len(m)) if abs(m[n, int(row)]) > 1e-12]

    return image


def without_unexpected(e: Expression, fine: Callable[[str], bool]) -> Expression:
    """Products in which every propagator is fine."""
    return {k: c for k, c in e.items() if all(fine(p) for d in k for p in d.props())}


def without_propagators(e: Expression, names: Iterable[str]) -> Expression:
    """Products free of the listed (local) propagators."""
    bad = set(names)
    return {k: c for k, c in e.items() if not any(bad & d.props() for d in k)}


def distinct(e: Expression) -> list[Diagram]:
    return sorted({d for k in e for d in k})


# --- analysis: operands and subscripts -------------------------------------------------------

UPPER, MODES = "ABCDEFGHIJKLM", "NOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Part:
    """edges in visit order, vertices, and the label of each edge end: 2k at the source, 2k + 1 at the sink."""

    edges: tuple[Edge, ...]
    vertices: tuple[int, ...]

    def out_ends(self, v: int) -> list[int]:
        return [2 * k for k, e in enumerate(self.edges) if e.src == v]

    def in_ends(self, v: int) -> list[int]:
        return [2 * k + 1 for k, e in enumerate(self.edges) if e.snk == v]

    def subscripts(self) -> str:
        """Letters (spins A.., modes N..) of propagators, sink end first, then of vertices, source ends of their edges first; up to 6 edges."""
        if len(self.edges) > 6:
            raise ValueError("letters end at 6 edges; labels of contractions do not")
        words = [UPPER[2 * k + 1] + UPPER[2 * k] + MODES[2 * k + 1] + MODES[2 * k] for k in range(len(self.edges))]
        for v in self.vertices:
            ends = self.out_ends(v) + self.in_ends(v)
            words.append("".join(UPPER[x] for x in ends) + "".join(MODES[x] for x in ends))
        return ",".join(words)


def analyse(d: Diagram) -> list[Part]:
    """Per connected part: edges in breadth-first order of their source vertex."""
    out = []
    for group in parts(d):
        order, edges = [group[0]], []
        for v in order:
            own = sorted(e for e in d.edges if e.src == v)
            edges += own
            order += [x for x in dict.fromkeys([e.snk for e in own] + sorted(e.src for e in d.edges if e.snk == v)) if x not in order]
        out.append(Part(tuple(edges), tuple(group)))
    return out


# --- current vertices: mode or point ends ----------------------------------------------------

STATES = tuple(product("vp", repeat=2))


@dataclass(frozen=True)
class Expanded:
    """states: (left, right) of each vertex; kinds: per edge what its (sink, source) ends are."""

    states: tuple[tuple[str, str], ...]
    kinds: tuple[str, ...]
    weight: Fraction | float = 1


def expand_currents(d: Diagram, current: list[bool]) -> list[Expanded]:
    """All choices of mode or point ends of the current vertices: 4 for each. An edge leaves by its source's left end and arrives at its sink's right end."""
    choices = [STATES if c else (("v", "v"),) for c in current]
    out = []
    for states in product(*choices):
        kinds = tuple((states[e.snk][1] + states[e.src][0]).upper() for e in d.edges)
        out.append(Expanded(states, kinds))
    return out


def sampling_groups(x: Expanded, group_of: list[int]) -> dict[int, list[tuple[int, str]]]:
    """Point positions (vertex, side) that draw from the same sample."""
    out: dict[int, list[tuple[int, str]]] = {}
    for v, (left, right) in enumerate(x.states):
        for side, s in (("left", left), ("right", right)):
            if s == "p":
                out.setdefault(group_of[v], []).append((v, side))
    return out


def integer_partitions(n: int, most: int | None = None) -> list[list[int]]:
    """All partitions of n, parts falling, in rising order of the parts."""
    if n == 0:
        return [[]]
    return [[k, *rest] for k in range(1, min(n, most or n) + 1) for rest in integer_partitions(n - k, k)]


def sampling_weight(volume: int, sampled: int, k: int) -> Fraction:
    """Product of (V - i) / (N - i) for k different points; 1 for none, 0 where there can't be k."""
    if k > min(volume, sampled):
        return Fraction(0)
    return Fraction(prod(volume - i for i in range(k)), prod(sampled - i for i in range(k)))


def point_scenes(r: int, volume: int, sampled: int) -> list[tuple[list[int], Fraction]]:
    return [(p, sampling_weight(volume, sampled, len(p))) for p in integer_partitions(r)]


def set_partitions(items: list) -> list[list[list]]:
    if not items:
        return [[]]
    out = []
    for rest in set_partitions(items[1:]):
        out.append([[items[0]], *rest])
        out += [[*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]] for i in range(len(rest))]
    return out


def scene_constraints(groups: dict[int, list[tuple[int, str]]], volume: int, sampled: int) -> list[tuple[dict[tuple[int, str], tuple[int, int]], Fraction]]:
    """Every way in which positions of a group coincide: position -> (group, point number), with the product of the weights. Set partitions, so none is missed."""
    choices = []
    for g, positions in sorted(groups.items()):
        choices.append([({x: (g, i) for i, block in enumerate(sorted(p)) for x in block}, sampling_weight(volume, sampled, len(p))) for p in set_partitions(positions)])
    out = []
    for combo in product(*choices):
        merged: dict = {}
        for m, _ in combo:
            merged |= m
        out.append((merged, prod([w for _, w in combo], start=Fraction(1))))
    return out


def _splits(n: int, m: int) -> int:
    """Partitions of n things into m parts."""
    return int(n == m) if n == 0 or m == 0 else m * _splits(n - 1, m) + _splits(n - 1, m - 1)


def identified_weights(positions: list, volume: int, sampled: int) -> list[tuple[list[list], Fraction]]:
    """Every way to identify positions, with the factor that makes free sums over identified points the weighted sum.

    The weight of a row depends on how many different points it has. Moebius
    inversion over set partitions turns it into a sum over identifications, each
    with one factor for all rows; points may then coincide or not, so that their
    sums can be done one by one.
    """
    out = []
    for blocks in set_partitions(positions):  # of no positions: one, empty
        by_number = {0: 1}  # number of parts that a block's positions fall into, all blocks together -> signed count
        for block in blocks:
            own = {m: _splits(len(block), m) * (-1) ** (m - 1) * factorial(m - 1) for m in range(1, len(block) + 1)}
            by_number = {n: sum(c * own.get(n - k, 0) for k, c in by_number.items()) for n in range(1, len(positions) + 1)}
        factor = sum((c * sampling_weight(volume, sampled, n) for n, c in by_number.items()), Fraction(0))
        if factor:
            out.append((blocks, factor))
    return out


# --- evaluation ------------------------------------------------------------------------------


def diagram_operands(d: Diagram, time_label: dict[int, str], states: tuple | None = None, points: dict[tuple[int, str], str] | None = None) -> list[Operand]:
    """The tensors of all parts of d by name, with labels.

    Propagators are ("prop", name, ends) of axes (s, t, spin at sink, spin at source,
    sink end, source end), or ("equal", name, ends) without s between equal times. A
    meson vertex is ("vertex", name, ends) of (t, left spin, right spin, left end,
    right end); a vertex of several quarks has the spins of its outgoing ends by
    quark number, then those of its incoming ones, then the ends in that order. An end
    is a mode, or by states a point and its colour; points gives labels to points.
    """
    states = states or (("v", "v"),) * len(d.vertices)
    out: list[Operand] = []
    for n, part in enumerate(analyse(d)):

        def end(x: int, kind: str, v: int, side: str, n: int = n) -> list[str]:
            return [f"m{n}.{x}"] if kind == "v" else [(points or {}).get((v, side), f"p{n}.{x}"), f"c{n}.{x}"]

        for k, e in enumerate(part.edges):
            s, t = (time_label[d.vertices[v][0]] for v in (e.src, e.snk))
            left, right = states[e.src][0], states[e.snk][1]
            labels = [f"s{n}.{2 * k + 1}", f"s{n}.{2 * k}", *end(2 * k + 1, right, e.snk, "right"), *end(2 * k, left, e.src, "left")]
            kinds = (right + left).upper()
            out.append((("equal", e.prop, kinds), (t, *labels)) if s == t else (("prop", e.prop, kinds), (s, t, *labels)))
        for v in part.vertices:
            time, name = d.vertices[v]
            left = sorted(part.out_ends(v), key=lambda x, part=part: part.edges[x // 2].q_src)
            right = sorted(part.in_ends(v), key=lambda x, part=part: part.edges[x // 2].q_snk)
            ends = [(x, states[v][0], "left") for x in left] + [(x, states[v][1], "right") for x in right]
            kinds = "".join(k for _, k, _ in ends)
            out.append((("vertex", name, kinds), (time_label[time], *[f"s{n}.{x}" for x, _, _ in ends], *[y for x, k, side in ends for y in end(x, k, v, side)])))
    return out


def leaves_of(operands: Iterable[Operand], propagators: dict, vertices: dict) -> dict:
    """Tensors of the operands; propagators and vertices are by name, or by (name, ends)."""
    out = {}
    for key in dict.fromkeys(name for name, _ in operands):
        kind, name, ends = key
        table = vertices if kind == "vertex" else propagators
        x = table[name, ends] if (name, ends) in table else table[name]
        if kind == "equal":
            x = Tensor(x.frame.where("s = t").drop("s"), tuple(a for a in x.axes if a != "s"), x.sizes, None if x.rows is None else x.rows / x.sizes.get("s", 8))
        out[key] = x
    return out


def _times(operands: list[Operand], time_label: dict[int, str]) -> tuple[str, ...]:
    return tuple(t for t in dict.fromkeys(time_label.values()) if any(t in labels for _, labels in operands))


def evaluate(d: Diagram, propagators: dict, vertices: dict, time_label: dict[int, str]) -> Tensor:
    """The value of d for all times (and configurations) at once: its axes are the time labels it has."""
    own = diagram_operands(d, time_label)
    times = _times(own, time_label)
    plan = Plan(leaves_of(own, propagators, vertices))
    part = plan.add(own, times)
    t = plan.tensors(lambda x: x)[part.node]
    return t.relabelled(**{f"x{i}": a for i, a in enumerate(part.labels)}).ordered(*t.batch, *times)


def current_terms(d: Diagram, current: list[bool], group_of: list[int], time_label: dict[int, str], volume: int, sampled: int) -> list[tuple[Fraction, list[Operand]]]:
    """A diagram with current vertices as terms of free sums: all choices of ends, all identifications of points of a sampling group."""
    out = []
    for x in expand_currents(d, current):
        scenes: list[tuple[dict, Fraction]] = [({}, Fraction(1))]
        for g, positions in sorted(sampling_groups(x, group_of).items()):
            ways = identified_weights(positions, volume, sampled)
            scenes = [(names | {p: f"q{g}.{i}" for i, block in enumerate(blocks) for p in block}, w * f) for names, w in scenes for blocks, f in ways]
        out += [(w, diagram_operands(d, time_label, x.states, names)) for names, w in scenes]
    return out


def plan_currents(d: Diagram, current: list[bool], group_of: list[int], propagators: dict, vertices: dict, time_label: dict[int, str], volume: int, sampled: int, scale: int = 1) -> Plan:
    """One plan for all of current_terms; scale makes weights whole."""
    terms = current_terms(d, current, group_of, time_label, volume, sampled)
    plan = Plan(leaves_of([o for _, own in terms for o in own], propagators, vertices))
    for w, own in terms:
        plan.add(own, _times(own, time_label), w * scale)
    return plan


def evaluate_currents(
    d: Diagram, current: list[bool], group_of: list[int], propagators: dict[tuple[str, str], Tensor], vertices: dict[tuple[str, str], Tensor], time_label: dict[int, str], volume: int, sampled: int, scale: int = 1, hold=lambda x: x
) -> Tensor:
    """A diagram with current vertices, summed over all choices of mode and point ends, times scale.

    propagators by (name, ends sink-source, such as `PV`), vertices by (name,
    ends left-right, such as `vp`); a point end is two axes, point and colour.
    Points are summed inside the plan, each identification with its own factor; all
    terms share their sub-contractions.
    """
    plan = plan_currents(d, current, group_of, propagators, vertices, time_label, volume, sampled, scale)
    times = tuple(dict.fromkeys(time_label.values()))
    own = tuple(t for t in times if t in plan.terms[0][1].labels)
    frame = plan.total(own, hold)
    return Tensor(frame, tuple(c for c in frame.columns if c not in ("re", "im")), {})


def plan_sum(e: Expression, propagators: dict, vertices: dict, time_label: dict[int, str], axes: tuple[str, ...]) -> Plan:
    """One plan for all terms of a sum: equal sub-contractions of any two diagrams are one node."""
    terms = []
    for factors, c in sorted(e.items()):
        own: list[Operand] = []
        for i, d in enumerate(factors):
            times = set(time_label.values())
            own += [(name, tuple(a if a in times else f"{i}/{a}" for a in labels)) for name, labels in diagram_operands(d, time_label)]
        terms.append((c, own))
    plan = Plan(leaves_of([o for _, own in terms for o in own], propagators, vertices))
    for c, own in terms:
        plan.add(own, axes, c)
    return plan


def evaluate_sum(e: Expression, propagators: dict, vertices: dict, time_label: dict[int, str], axes: tuple[str, ...], hold=lambda x: x):
    """(cfg if there is one, axes, re, im): the sum, by one plan; what several nodes read goes through hold."""
    return plan_sum(e, propagators, vertices, time_label, axes).total(axes, hold)


def to_dot(d: Diagram) -> str:
    """The diagram as DOT text."""
    lines = ["digraph {"]
    lines += [f'  v{i} [label="{name} @ {t}"];' for i, (t, name) in enumerate(d.vertices)]
    lines += [f'  v{e.src} -> v{e.snk} [label="{e.prop}"];' for e in d.edges]
    return "\n".join([*lines, "}"])
