"""Fields on sites: stencils, link products, smearing, eigenmodes, noise.

What is a join stays one: stencils and link products move coordinates and
multiply small matrices as join and sum. Dense linear algebra of one time slice
(eigenmodes, smearing) runs as blocks, a slice a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extents = tuple[int, int, int]


def one_configuration(*frames: DataFrame) -> None:
    """Fields carry no configuration: rows of several would mix, so such frames are refused."""
    if any("cfg" in f.columns for f in frames):
        raise ValueError("fields hold one configuration: choose it and drop cfg")


def moved(direction: int, ext: Extents, steps: int = 1) -> dict[str, Column]:
    """Coordinates one step ahead in a direction 0..2 (back for 3..5), periodic."""
    out = {c: F.col(c) for c in ("x", "y", "z")}
    c = ("x", "y", "z")[direction % 3]
    step = steps if direction < 3 else -steps
    out[c] = F.pmod(F.col(c) + step, F.lit(ext[direction % 3]))
    return out


def oriented(gauge: DataFrame) -> DataFrame:
    """Every link once in each direction it can be walked: (t, fx, fy, fz, k) field site and colour, (dir, x, y, z, c) what they reach, (ur, ui).

    (U_d F)(x) = U_d(x) F(x + d) for d of 0..2, and U_d^dagger(x - d) F(x - d) for
    3..5. gauge: (t, x, y, z, mu, a, b, re, im); the extents come with `linked`.
    """
    ways = F.array(
        F.struct(F.lit(True).alias("ahead"), F.col("mu").alias("dir"), F.col("a").alias("c"), F.col("b").alias("k"), F.col("im").alias("ui")),
        F.struct(F.lit(False).alias("ahead"), (F.col("mu") + 3).alias("dir"), F.col("b").alias("c"), F.col("a").alias("k"), (-F.col("im")).alias("ui")),
    )
    return gauge.where("mu < 3").select("t", "x", "y", "z", "mu", F.explode(ways).alias("w"), F.col("re").alias("ur")).select("t", "x", "y", "z", "mu", "w.*", "ur")


def linked(gauge: DataFrame, ext: Extents) -> DataFrame:
    """oriented() with both sites: the field's (fx, fy, fz) and the target's (x, y, z)."""
    one_configuration(gauge)
    here, there = {c: F.col(c) for c in "xyz"}, {}
    for i, c in enumerate("xyz"):
        there[c] = F.pmod(F.col(c) + (F.col("mu") == i).cast("long"), F.lit(ext[i]))
    near = F.col("ahead")  # walked ahead, the field stands one step on; walked back, the target does
    sites = [F.when(near, there[c]).otherwise(here[c]).alias(f"f{c}") for c in "xyz"] + [F.when(near, here[c]).otherwise(there[c]).alias(c) for c in "xyz"]
    return oriented(gauge).select("t", *sites, "dir", "c", "k", "ur", "ui")


def walked(field: DataFrame, links: DataFrame, keys: tuple[str, ...], own_way: bool = False) -> DataFrame:
    """Every field entry times every link it meets, not yet summed: (dir, t, x, y, z, c, keys, re, im).

    One join whatever the number of directions. own_way: field rows have a column
    dir and go that way only.
    """
    one_configuration(field)
    f = field.select(*[F.col(c).alias(f"_{c}") for c in ("t", "x", "y", "z", "c", *(["dir"] if own_way else []))], *keys, F.col("re").alias("fr"), F.col("im").alias("fi"))
    on = [F.col(f"_{c}") == F.col(n) for c, n in (("t", "t"), ("x", "fx"), ("y", "fy"), ("z", "fz"), ("c", "k"))]
    on += [F.col("_dir") == F.col("dir")] if own_way else []
    return f.join(links, on).select(
        "dir", "t", "x", "y", "z", "c", *keys, (F.col("ur") * F.col("fr") - F.col("ui") * F.col("fi")).alias("re"), (F.col("ur") * F.col("fi") + F.col("ui") * F.col("fr")).alias("im")
    )


SITE = ("t", "x", "y", "z", "c")


def _summed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def hop(field: DataFrame, gauge: DataFrame, direction: int, ext: Extents, keys: tuple[str, ...]) -> DataFrame:
    """Covariant shift in one direction: (U_d F)(x) = U_d(x) F(x + d), or U_d^dagger(x - d) F(x - d) for directions 3..5."""
    return _summed(walked(field, linked(gauge, ext).where(F.col("dir") == direction), keys), (*SITE, *keys))


def laplacian(field: DataFrame, gauge: DataFrame, ext: Extents, keys: tuple[str, ...]) -> DataFrame:
    """6 F - sum over the six covariant neighbours: one join with the links, one sum."""
    own = (*SITE, *keys)
    near = walked(field, linked(gauge, ext), keys).select(*own, (-F.col("re")).alias("re"), (-F.col("im")).alias("im"))
    return _summed(field.select(*own, (6 * F.col("re")).alias("re"), (6 * F.col("im")).alias("im")).unionByName(near), own)


def straight(field: DataFrame, gauge: DataFrame, steps: int, ext: Extents, keys: tuple[str, ...]) -> DataFrame:
    """The field moved `steps` times straight ahead in each of the six directions: (dir, t, x, y, z, c, keys), a join a step."""
    links = linked(gauge, ext)
    now = field.withColumn("dir", F.explode(F.array(*[F.lit(d).cast("long") for d in range(6)])))
    for _ in range(steps):
        now = _summed(walked(now, links, keys, own_way=True), ("dir", *SITE, *keys))
    return now


# --- trees of words ---------------------------------------------------------------------------


class WordTree:
    """Words that share their walk: a node is a word, its parent the word without the letter that is walked last.

    forward: letters are walked from the first (transport from a point); else from
    the last (a field moved by U_w F = U_first(U_rest F)). Each edge is walked once,
    all edges of a depth in one join. number: each node's number, by depth, then letters.
    """

    def __init__(self, words: list[tuple[int, ...]], forward: bool):
        walked_ = {w: w if forward else w[::-1] for w in words}
        paths = sorted({p[:k] for p in walked_.values() for k in range(len(p) + 1)}, key=lambda p: (len(p), p))
        self.place = {p: i for i, p in enumerate(paths)}
        self.number = {w: self.place[p] for w, p in walked_.items()}
        self.levels = [[(self.place[p], self.place[p[:-1]], p[-1]) for p in paths if len(p) == k] for k in range(1, max(map(len, paths), default=0) + 1)]

    @property
    def edges(self) -> int:
        return sum(map(len, self.levels))

    def named(self, frame: DataFrame, words: list[tuple[int, ...]], label: str = "w") -> DataFrame:
        """frame with, for each of words, its place in the list instead of its node."""
        rows = frame.sparkSession.createDataFrame([(self.number[w], i) for i, w in enumerate(words)], f"_node long, {label} long")
        return frame.join(F.broadcast(rows), F.col("node") == F.col("_node")).drop("node", "_node")

    def children(self, links: DataFrame, depth: int) -> DataFrame:
        """links of the edges of a depth: with columns node and parent."""
        rows = links.sparkSession.createDataFrame(self.levels[depth], "node long, parent long, way long")
        return links.join(F.broadcast(rows), F.col("dir") == F.col("way")).drop("way")


def moved_by_words(field: DataFrame, gauge: DataFrame, tree: WordTree, ext: Extents, keys: tuple[str, ...], hold=lambda x: x) -> DataFrame:
    """(node, t, x, y, z, c, keys, re, im): U_w F for every node of the tree. hold keeps a level that the next one and the result read."""
    return _grown(field.withColumn("node", F.lit(0).cast("long")), linked(gauge, ext), tree, keys, hold)


def derived_by_paths(field: DataFrame, gauge: DataFrame, tree: WordTree, ext: Extents, keys: tuple[str, ...], hold=lambda x: x) -> DataFrame:
    """The same with a derivative a letter: covariant forward minus backward hop in directions 0..2."""
    back = F.col("dir") >= 3
    links = linked(gauge, ext).select("t", "fx", "fy", "fz", "x", "y", "z", F.when(back, F.col("dir") - 3).otherwise(F.col("dir")).alias("dir"), "c", "k", *[F.when(back, -F.col(u)).otherwise(F.col(u)).alias(u) for u in ("ur", "ui")])
    return _grown(field.withColumn("node", F.lit(0).cast("long")), links, tree, keys, hold)


def _grown(now: DataFrame, links: DataFrame, tree: WordTree, keys: tuple[str, ...], hold) -> DataFrame:
    own = ("node", *SITE, *keys)
    every = now.select(*own, "re", "im")
    for depth in range(len(tree.levels)):
        f = now.select(*[F.col(c).alias(f"_{c}") for c in ("node", *SITE)], *keys, F.col("re").alias("fr"), F.col("im").alias("fi"))
        on = [F.col(f"_{c}") == F.col(n) for c, n in (("node", "parent"), ("t", "t"), ("x", "fx"), ("y", "fy"), ("z", "fz"), ("c", "k"))]
        both = f.join(tree.children(links, depth), on)
        now = hold(_summed(both.select(*own, (F.col("ur") * F.col("fr") - F.col("ui") * F.col("fi")).alias("re"), (F.col("ur") * F.col("fi") + F.col("ui") * F.col("fr")).alias("im")), own))
        every = every.unionByName(now)
    return every


def transported_by_words(gauge: DataFrame, start: DataFrame, tree: WordTree, ext: Extents, colours: int, hold=lambda x: x) -> DataFrame:
    """(node, t, p, x, y, z, a, b, re, im): the product of links along each node's word from each start (t, p, x, y, z), x y z where it ends.

    The tree is a forward one. A row (a, b) grows by the links that leave its end:
    those whose target it is, read towards the field's site.
    """
    one_configuration(start)
    unit = F.explode(F.array(*[F.lit(i).cast("long") for i in range(colours)]))
    now = start.select(F.lit(0).cast("long").alias("node"), "t", "p", "x", "y", "z", unit.alias("a")).select("*", F.col("a").alias("b"), F.lit(1).cast("long").alias("re"), F.lit(0).cast("long").alias("im"))
    every, links = now, linked(gauge, ext)
    own = ("node", "t", "p", "x", "y", "z", "a", "b")
    for depth in range(len(tree.levels)):
        f = now.select(*[F.col(c).alias(f"_{c}") for c in ("node", "t", "x", "y", "z", "b")], "p", "a", F.col("re").alias("fr"), F.col("im").alias("fi"))
        on = [F.col(f"_{c}") == F.col(n) for c, n in (("node", "parent"), ("t", "t"), ("x", "x"), ("y", "y"), ("z", "z"), ("b", "c"))]
        both = f.join(tree.children(links, depth), on)
        ends = ["node", "t", "p", *[F.col(f"f{c}").alias(c) for c in "xyz"], "a", F.col("k").alias("b")]
        now = hold(_summed(both.select(*ends, (F.col("fr") * F.col("ur") - F.col("fi") * F.col("ui")).alias("re"), (F.col("fr") * F.col("ui") + F.col("fi") * F.col("ur")).alias("im")), own))
        every = every.unionByName(now)
    return every


def transport(gauge: DataFrame, start: DataFrame, word: tuple[int, ...], ext: Extents, colours: int) -> DataFrame:
    """Transport along a word from each starting point: (t, p, x, y, z, a, b, re, im), x y z where it ends.

    start: (t, p, x, y, z). A forward letter reads the link here and then moves;
    a backward one moves and then reads the daggered link.
    """
    one_configuration(gauge, start)
    unit = F.explode(F.array(*[F.lit(i).cast("long") for i in range(colours)]))
    now = start.select("t", "p", "x", "y", "z", unit.alias("a")).select("t", "p", "x", "y", "z", "a", F.col("a").alias("b"), F.lit(1).cast("long").alias("re"), F.lit(0).cast("long").alias("im"))
    for d in word:
        u = gauge.where(F.col("mu") == d % 3)
        if d >= 3:
            at = moved(d, ext)
            now = now.select("t", "p", *[at[c].alias(c) for c in ("x", "y", "z")], "a", "b", "re", "im")
            link = u.select("t", "x", "y", "z", F.col("b").alias("k"), F.col("a").alias("b2"), F.col("re").alias("ur"), (-F.col("im")).alias("ui"))
        else:
            link = u.select("t", "x", "y", "z", F.col("a").alias("k"), F.col("b").alias("b2"), F.col("re").alias("ur"), F.col("im").alias("ui"))
        both = now.withColumnRenamed("b", "k").join(link, ["t", "x", "y", "z", "k"])
        now = both.groupBy("t", "p", "x", "y", "z", "a", F.col("b2").alias("b")).agg(
            F.sum(F.col("re") * F.col("ur") - F.col("im") * F.col("ui")).alias("re"), F.sum(F.col("re") * F.col("ui") + F.col("im") * F.col("ur")).alias("im")
        )
        if d < 3:
            at = moved(d, ext)
            now = now.select("t", "p", *[at[c].alias(c) for c in ("x", "y", "z")], "a", "b", "re", "im")
    return now


def relayout(ext4: tuple[int, int, int, int]) -> dict[str, Column]:
    """Even-odd layout of a site (t, z, y, x): its parity and its place among the sites of that parity."""
    lx = ext4[0]
    flat = F.floor(F.col("x") / 2) + (lx // 2) * (F.col("y") + ext4[1] * (F.col("z") + ext4[2] * F.col("t")))
    return {"parity": F.pmod(F.col("t") + F.col("z") + F.col("y") + F.col("x"), F.lit(2)), "place": flat.cast("long")}


# --- blocks: one time slice in numpy ----------------------------------------------------------


def gauge_block(rows: pd.DataFrame, ext: Extents, colours: int) -> np.ndarray:
    """U[mu, z, y, x, a, b] of one slice."""
    u = np.zeros((3, ext[2], ext[1], ext[0], colours, colours), complex)
    u[tuple(rows[c].to_numpy(int) for c in ("mu", "z", "y", "x", "a", "b"))] = rows["re"].to_numpy(float) + 1j * rows["im"].to_numpy(float)
    return u


def block_rows(u: np.ndarray, **fixed) -> pd.DataFrame:
    at = np.indices(u.shape).reshape(u.ndim, -1)
    out = pd.DataFrame({c: at[i] for i, c in enumerate(("mu", "z", "y", "x", "a", "b"))})
    return out.assign(re=u.reshape(-1).real, im=u.reshape(-1).imag, **fixed)


def dagger(u: np.ndarray) -> np.ndarray:
    return u.conj().swapaxes(-1, -2)


def unitary(u: np.ndarray, tol: float = 1e-15, most: int = 200) -> np.ndarray:
    """The nearest unitary matrices, by Newton's iteration U <- (U + U^-dagger) / 2."""
    for _ in range(most):
        inv = dagger(np.linalg.inv(u))
        if np.abs(u - inv).max() <= tol:
            break
        new = 0.5 * (u + inv)
        if np.abs(new - u).max() <= tol:
            return new
        u = new
    return u


def stout(u: np.ndarray, steps: int, rho: float) -> np.ndarray:
    """Stout smearing within a slice: staples of the other two spatial directions, exponential of the traceless Hermitian part."""
    n = u.shape[-1]
    axis = {0: 2, 1: 1, 2: 0}

    def ahead(f: np.ndarray, mu: int, k: int = 1) -> np.ndarray:
        return np.roll(f, -k, axis[mu])

    for _ in range(steps):
        q = np.zeros_like(u)
        for mu in range(3):
            for nu in range(3):
                if nu == mu:
                    continue
                q[mu] += u[nu] @ ahead(u[mu], nu) @ dagger(ahead(u[nu], mu))
                back = ahead(u[nu], nu, -1)
                q[mu] += dagger(back) @ ahead(u[mu], nu, -1) @ ahead(back, mu)
        omega = rho * q @ dagger(u)
        h = 0.5j * (dagger(omega) - omega)
        h -= np.trace(h, axis1=-2, axis2=-1)[..., None, None] / n * np.eye(n)
        values, vecs = np.linalg.eigh(h)
        u = (vecs * np.exp(1j * values)[..., None, :]) @ dagger(vecs) @ u
    return u


def laplacian_matrix(u: np.ndarray) -> np.ndarray:
    """The dense operator of a slice on (z, y, x, colour)."""
    _, lz, ly, lx, n, _ = u.shape
    size = lz * ly * lx
    index = np.arange(size).reshape(lz, ly, lx)
    out = 6 * np.eye(size * n, dtype=complex).reshape(size, n, size, n)
    for mu, axis in ((0, 2), (1, 1), (2, 0)):
        to = np.roll(index, -1, axis).reshape(-1)
        link = u[mu].reshape(size, n, n)
        for s in range(size):
            out[s, :, to[s], :] -= link[s]
            out[to[s], :, s, :] -= link[s].conj().T
    return out.reshape(size * n, size * n)


def lowest_modes(u: np.ndarray, modes: int) -> tuple[np.ndarray, np.ndarray]:
    """(values rising, vectors [mode, z, y, x, c]); each vector's first component is real and not negative."""
    values, vecs = np.linalg.eigh(laplacian_matrix(u))
    v = vecs[:, :modes].T.copy()
    first = v[:, :1]
    v *= np.where(np.abs(first) > 1e-14, first.conj() / np.maximum(np.abs(first), 1e-300), 1)
    return values[:modes], v.reshape(modes, *u.shape[1:4], u.shape[-1])


def by_slice(gauge: DataFrame, ext: Extents, colours: int, work: Callable[[np.ndarray, int], pd.DataFrame], schema: str) -> DataFrame:
    """work on each time slice's links, as blocks; a slice fits a task."""
    one_configuration(gauge)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return work(gauge_block(rows, ext, colours), int(key[0]))

    return gauge.groupBy("t").applyInPandas(run, schema)


def smeared(gauge: DataFrame, ext: Extents, colours: int, steps: int, rho: float) -> DataFrame:
    return by_slice(gauge, ext, colours, lambda u, t: block_rows(stout(u, steps, rho), t=t), "mu long, z long, y long, x long, a long, b long, re double, im double, t long")


def projected(gauge: DataFrame, ext: Extents, colours: int) -> DataFrame:
    """The nearest unitary links, each by itself: a link's entries are packed to a row, and a task takes them a batch at a time."""
    one_configuration(gauge)
    own = ("t", "x", "y", "z", "mu")
    packed = gauge.groupBy(*own).agg(F.collect_list(F.struct((F.col("a") * colours + F.col("b")).alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("v"))
    packed = packed.select(*own, *[F.col("v")[c].alias(c) for c in ("at", "re", "im")])
    n = colours * colours

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            u = np.zeros((len(frame), n), complex)
            row = np.repeat(np.arange(len(frame)), frame["at"].map(len))
            u[row, np.concatenate(frame["at"].to_list()).astype(int)] = np.concatenate(frame["re"].to_list()) + 1j * np.concatenate(frame["im"].to_list())
            u = unitary(u.reshape(-1, colours, colours)).reshape(-1)
            a, b = np.divmod(np.tile(np.arange(n), len(frame)), colours)
            yield pd.DataFrame({c: np.repeat(frame[c].to_numpy(), n) for c in own} | {"a": a, "b": b, "re": u.real, "im": u.imag})

    return packed.mapInPandas(run, "t long, x long, y long, z long, mu long, a long, b long, re double, im double").select("mu", "z", "y", "x", "a", "b", "re", "im", "t")


def eigenvalues(gauge: DataFrame, ext: Extents, colours: int, modes: int) -> DataFrame:
    """(t, e, value): the lowest modes of each slice."""
    return by_slice(gauge, ext, colours, lambda u, t: pd.DataFrame({"t": t, "e": np.arange(modes), "value": lowest_modes(u, modes)[0]}), "t long, e long, value double")


def eigenmodes(gauge: DataFrame, ext: Extents, colours: int, modes: int) -> DataFrame:
    """(t, e, z, y, x, c, re, im)."""

    def work(u: np.ndarray, t: int) -> pd.DataFrame:
        v = lowest_modes(u, modes)[1]
        at = np.indices(v.shape).reshape(v.ndim, -1)
        return pd.DataFrame({"t": t, **{c: at[i] for i, c in enumerate(("e", "z", "y", "x", "c"))}, "re": v.reshape(-1).real, "im": v.reshape(-1).imag})

    return by_slice(gauge, ext, colours, work, "t long, e long, z long, y long, x long, c long, re double, im double")


def noise(v: DataFrame, blocks: list[tuple[int, int]], seed: int, high: int = 0) -> DataFrame:
    """Noise vectors (t, n, x, re, im) from modes (t, e, x, re, im).

    blocks: (modes, vectors) one after the other: as many vectors as modes are
    copies, one vector has U(1) phases, else a Haar-random frame's first columns.
    high: more vectors, random but orthogonal to the used modes and each other.
    Seeds come from the seed, the slice and the block, so reruns agree.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = int(key[0])
        ne, nx = int(rows["e"].max()) + 1, int(rows["x"].max()) + 1
        m = np.zeros((ne, nx), complex)
        m[rows["e"].to_numpy(int), rows["x"].to_numpy(int)] = rows["re"].to_numpy(float) + 1j * rows["im"].to_numpy(float)
        out, at = [], 0
        for k, (modes, vectors) in enumerate(blocks):
            rng = np.random.default_rng([seed, t, k])
            own = m[at : at + modes]
            if modes == vectors:
                out.append(own)
            elif vectors == 1:
                out.append(np.exp(2j * np.pi * rng.random(modes))[None, :] @ own)
            else:
                q, r = np.linalg.qr(rng.standard_normal((modes, modes)) + 1j * rng.standard_normal((modes, modes)))
                q = q * (np.diag(r) / np.abs(np.diag(r)))
                out.append(q[:, :vectors].T @ own)
            at += modes
        base = np.linalg.qr(m[:at].T)[0].T if at else np.zeros((0, nx), complex)
        for k in range(high):
            rng = np.random.default_rng([seed, t, len(blocks) + k])
            x = rng.standard_normal(nx) + 1j * rng.standard_normal(nx)
            for _ in range(2):
                x = x - (base.conj() @ x) @ base
            x /= np.linalg.norm(x)
            base = np.vstack([base, x])
            out.append(x[None])
        full = np.vstack(out)
        i = np.indices(full.shape).reshape(2, -1)
        return pd.DataFrame({"t": t, "n": i[0], "x": i[1], "re": full.reshape(-1).real, "im": full.reshape(-1).imag})

    return v.groupBy("t").applyInPandas(run, "t long, n long, x long, re double, im double")
