"""Jaccard join of shingle sets as a blocked sparse product of document by shingle incidence.

Rows are distinct sets (copies of a set are one row), columns are shingles. The
product of the incidence with its transpose holds every pair's overlap; it is
never formed whole:

* Columns: similar sets share LEAST shingles among the first n - ceil(t n) + LEAST of
  each under any one order of all shingles. Only those entries are multiplied. The
  order puts shingles last that share a counter with many documents; the counters
  (a fixed number) are counted over the whole corpus.
* Counts: columns of few rows give their pairs, and overlaps are added up over all
  such columns; a pair of fewer than LEAST that meets in no larger column is dropped.
* Blocks: a larger column is a unit of work. One of more than BLOCK rows is dealt
  into row blocks, and each pair of blocks is a unit of its own, so that no task
  holds more than 2 BLOCK rows. Columns of the same rows are one, with their number.
* Bounds: a unit drops a pair whose sizes differ too much, or whose parity bits
  differ in more places than similar sets of these sizes can (a shingle flips one
  bit). What is left is accumulated exactly, one range of columns after the
  other, until the overlap is reached or cannot be reached any more.
* Pairs within one component need no product. A unit of more passing pairs than
  rows first gives each row its nearest partner only; those links join rows into
  components, and the unit is asked again for pairs of different components. As
  soon as few of the answers link, it gives all that is left. So a group of many
  near copies costs about its rows, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.components import components
from tensorloom.llm.sieve import sieved
from tensorloom.llm.simhash import fingerprint, near_pairs, shingle_hashes, signed
from tensorloom.llm.staging import placed, ship_code, stage

WIDTH, SIMILAR = 3, (9, 10)
#: Counters that order shingles, dealt by the top bits of their hashes, and counters in a row of the sum.
COUNTERS, CHUNK = 1 << 18, 1 << 12
#: Shingles that the multiplied entries of similar sets share at least.
LEAST = 3
#: Rows of a column that gives its pairs; larger ones are units. Rows that one task compares among themselves; larger columns are split.
FEW, BLOCK = 8, 1 << 14
#: A unit is asked for nearest partners again while more than one answer in so many links. No link depends on it.
WORTH = 8
#: Shingles of a range of columns when overlaps are accumulated.
COLUMNS = 1 << 12
#: Least parity bits of a row, as a power of two.
LEAST_BITS = 11
#: Pairs that a unit holds before it sends them on.
PAIRS = 1 << 18


# --- sets and bounds -------------------------------------------------------------------------


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes; empty without words."""
    parts = list(shingle_hashes(text if isinstance(text, str) else "", width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def needed(sizes, similar: tuple[int, int] = SIMILAR):
    """Least overlap of similar sets whose sizes add up to `sizes`."""
    p, q = similar
    return -(-p * sizes // (p + q))


def least_shared(similar: tuple[int, int]) -> int:
    """LEAST, or the overlap of the smallest similar sets that differ, if that is less."""
    p, q = similar
    return min(LEAST, int(needed(2 * -(-p // (q - p)) + 1, similar)))


def reaches(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether two sorted sets share `need` shingles, accumulated over ranges of columns; ends as soon as that is certain."""
    got, i, j = 0, 0, 0
    while got < need and got + min(len(a) - i, len(b) - j) >= need:
        top = min(a[min(i + COLUMNS, len(a)) - 1], b[min(j + COLUMNS, len(b)) - 1])
        i2, j2 = int(np.searchsorted(a, top, "right")), int(np.searchsorted(b, top, "right"))
        got += len(np.intersect1d(a[i:i2], b[j:j2], assume_unique=True))
        i, j = i2, j2
    return got >= need


def similar_sets(a: np.ndarray, b: np.ndarray, similar: tuple[int, int] = SIMILAR) -> bool:
    return reaches(a, b, needed(len(a) + len(b), similar))


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix(hashes: np.ndarray, counts: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The entries of a row that are multiplied: its first n - ceil(t n) + least_shared() shingles by (counter, hash)."""
    n, (p, q) = len(hashes), similar
    return hashes[np.lexsort((hashes, counts[counter_of(hashes)]))[: n + (-p * n // q) + least_shared(similar)]]


def parity(hashes: np.ndarray) -> bytes:
    """2**LEAST_BITS parity bits or more, about as many as shingles; a shingle flips one."""
    bits = 1 << max(LEAST_BITS, len(hashes).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (uint64, last axis) folded to so many words: what a row of fewer bits would have."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def near(s: int, t: int, p: bytes, q: bytes, similar: tuple[int, int]) -> bool:
    """Whether rows of sizes s and t with these parity bits can be similar."""
    if similar[0] * max(s, t) > similar[1] * min(s, t):
        return False
    one, two = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    words = min(len(one), len(two))
    return int(np.bitwise_count(folded(one, words) ^ folded(two, words)).sum(dtype=np.int64)) <= s + t - 2 * needed(s + t, similar)


# --- tasks -----------------------------------------------------------------------------------


def _counted(width: int) -> Callable:
    """How many documents have a shingle in each counter, CHUNK counters a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in b["text"]:
                own = counter_of(shingle_set(x, width))
                if len(own) > COUNTERS // 16:
                    total += np.bincount(own, minlength=COUNTERS)
                else:
                    np.add.at(total, own, 1)
        chunks = total.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        yield pd.DataFrame({"chunk": some, "counts": [chunks[i].tobytes() for i in some]})

    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b["chunk"], b["counts"], strict=True):
            sums[c] = sums[c] + np.frombuffer(x, np.int64) if c in sums else np.frombuffer(x, np.int64)
    yield pd.DataFrame({"chunk": list(sums), "counts": [x.tobytes() for x in sums.values()]})


def counters(docs: DataFrame, width: int) -> np.ndarray:
    """COUNTERS numbers, whatever the corpus: all of them come to the driver (2 MB) and go to all tasks."""
    parts = docs.select("text").mapInPandas(_counted(width), "chunk long, counts binary")
    total = np.zeros(COUNTERS, np.int64)
    for r in parts.repartition("chunk").mapInPandas(_added, "chunk long, counts binary").collect():  # COUNTERS / CHUNK rows
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["counts"], np.int64)
    return total


def _described(counts: np.ndarray, width: int, similar: tuple[int, int], marked: int | None) -> Callable:
    rank = np.minimum(counts, 2**31 - 1).astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, q = similar
        for b in batches:
            sets = [shingle_set(x, width) for x in b["text"]]
            lone = [n * q // p <= n and -(-n * p // q) >= n for n in map(len, sets)]  # similar to equal sets only
            own = {} if marked is None else {"mark": [0 if y else signed(fingerprint(x if isinstance(x, str) else "", marked)) for x, y in zip(b["text"], lone, strict=True)]}
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "row": b["row"], "file": b["file"], "line": b["line"], "size": [len(x) for x in sets],
                "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "bits": [b"" if y else parity(x) for x, y in zip(sets, lone, strict=True)],
                "head": [[] if y else prefix(x, rank, similar).view(np.int64) for x, y in zip(sets, lone, strict=True)], **own,
            })

    return run


def _by_unit(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """The frames of whole units, of rows sorted by unit; the last unit is held until it is whole."""
    held: list[pd.DataFrame] = []
    names = ["h", "i", "j"]
    for x in batches:
        if not len(x):
            continue
        last = (x[names] == x[names].iloc[-1]).all(axis=1).to_numpy()
        if held and last.all() and (held[-1][names].iloc[-1] == x[names].iloc[-1]).all():
            held.append(x)
            continue
        at = int(last.argmax())
        yield [*held, x.iloc[:at]]
        held = [x.iloc[at:]]
    yield held


class _Unit:
    """The rows of one unit by size, and which of the later ones a row can be similar to."""

    def __init__(self, x: pd.DataFrame, similar: tuple[int, int]):
        x = x.iloc[np.argsort(x["size"].to_numpy("int64"), kind="stable")]
        self.size, self.row, self.comp = (x[c].to_numpy("int64") for c in ("size", "row", "comp"))
        self.block = x["block"].to_numpy("int64") if x["i"].iloc[0] != x["j"].iloc[0] else None
        self.bits = [np.frombuffer(b, np.uint64) for b in x["bits"]]
        self.words = np.array([len(b) for b in self.bits])
        self.coarse = np.array([folded(b, 4) for b in self.bits])
        self.end = np.searchsorted(self.size, self.size * similar[1] // similar[0], side="right")
        self.similar = similar
        self.levels: dict[int, tuple[int, np.ndarray]] = {}

    def level(self, words: int) -> tuple[int, np.ndarray]:
        """Parity bits of the rows of so many words and, folded, of twice as many; a similar set has no more."""
        if words not in self.levels:
            lo, hi = np.searchsorted(self.words, words), np.searchsorted(self.words, 2 * words, side="right")
            self.levels = {words: (int(lo), np.array([folded(b, words) for b in self.bits[lo:hi]]))}
        return self.levels[words]

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(i + 1, self.end[i])
        fine = self.comp[at] != self.comp[i]
        if self.block is not None:
            fine &= self.block[at] != self.block[i]
        at = at[fine]
        if not len(at):
            return at, at
        sizes = self.size[at] + self.size[i]
        most = sizes - 2 * needed(sizes, self.similar)
        near = np.bitwise_count(self.coarse[at] ^ self.coarse[i]).sum(axis=1, dtype=np.int64) <= most
        at, most = at[near], most[near]
        if not len(at):
            return at, at
        lo, bits = self.level(int(self.words[i]))
        apart = np.bitwise_count(bits[at - lo] ^ bits[i - lo]).sum(axis=1, dtype=np.int64)
        return at[apart <= most], apart[apart <= most]


PAIR, NEAREST, AGAIN = 0, 1, 2
FOUND = "kind int, a long, b long, apart long, h long, i int, j int"


def _products(similar: tuple[int, int], whole: bool) -> Callable:
    """Rows sorted by unit to pairs that pass the bounds (PAIR).

    A unit of more of them than rows gives each row's nearest partner instead
    (NEAREST: b asks) and one row AGAIN, unless `whole`.
    """

    def rows(kind: int, a, b, apart) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "a": a, "b": b, "apart": apart, "h": 0, "i": 0, "j": 0})

    def unit(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        u, n, count = _Unit(x, similar), len(x), 0
        best, whom = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        a, b = [], []
        for i in range(n - 1):
            at, apart = u.partners(i)
            if not len(at):
                continue
            count += len(at)
            if whole or count <= n:
                a.append(np.full(len(at), u.row[i]))
                b.append(u.row[at])
                if whole and sum(map(len, a)) > PAIRS:
                    yield rows(PAIR, np.concatenate(a), np.concatenate(b), 0)
                    a, b = [], []
            if not whole:
                j = int(apart.argmin())
                if apart[j] < best[i]:
                    best[i], whom[i] = apart[j], u.row[at[j]]
                closer = apart < best[at]
                best[at[closer]], whom[at[closer]] = apart[closer], u.row[i]
        if whole or count <= n:
            if a:
                yield rows(PAIR, np.concatenate(a), np.concatenate(b), 0)
            return
        asks = best < np.iinfo(np.int64).max
        yield rows(NEAREST, whom[asks], u.row[asks], best[asks])
        yield pd.DataFrame({"kind": AGAIN, "a": 0, "b": 0, "apart": 0, "h": x["h"].iloc[:1], "i": x["i"].iloc[:1], "j": x["j"].iloc[:1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frames in _by_unit(batches):
            x = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame()
            if not len(x):
                continue
            h, i, j = (x[c].to_numpy() for c in ("h", "i", "j"))
            edge = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            starts, ends = np.append(0, edge), np.append(edge, len(x))
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                yield from unit(x.iloc[lo:hi])

    return run


def _verified(width: int, similar: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.zeros(0, np.uint64)
        for x in batches:
            ok = []
            for b, p, q in zip(x["b"], x["p"], x["q"], strict=True):
                if b != last:
                    last, held = b, shingle_set(q, width)
                ok.append(similar_sets(shingle_set(p, width), held, similar))
            yield x[["a", "b"]][np.array(ok, bool)].rename(columns={"a": "u", "b": "v"})

    return run


# --- the join --------------------------------------------------------------------------------


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """Those of the staged pairs (a, b) that are similar, as (u, v): whole sets, made again from the texts of the pairs' rows."""
    wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    places = stage(nodes.join(wanted, "row", "left_semi"), "pair-places")
    found, _ = sieved(docs.select("file", "line", "text"), F.xxhash64("file", "line"), places.select(F.xxhash64("file", "line")))
    texts = stage(found.join(places, ["file", "line"]).select("row", "text"), "pair-texts")
    left, right = texts.select(F.col("row").alias("a"), F.col("text").alias("p")), texts.select(F.col("row").alias("b"), F.col("text").alias("q"))
    return stage(pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInPandas(_verified(width, similar), "u long, v long"), "similar")


def _entries(heads: DataFrame) -> DataFrame:
    """(h, n, times, row, size): the entries of columns of several rows; of columns of the same rows one, times being their number."""
    index = heads.select("row", "size", F.explode("head").alias("h"))
    several = stage(index.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "columns")
    some, _ = sieved(index, F.col("h"), several.select("h"))  # most shingles are in one row only: their entries are not shuffled again
    entries = stage(some.join(several, "h"), "all-entries")
    marks = [F.bit_xor(F.xxhash64("row")).alias("m0"), F.bit_xor(F.xxhash64(F.lit("second"), "row")).alias("m1")]
    alike = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *marks).groupBy("n", "m0", "m1").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("times"))
    return stage(entries.join(alike.select("h", "times"), "h"), "entries")


def _apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components; group (row, comp): rows that are not the least of their component."""
    both = pairs.join(group.select(F.col("row").alias("a"), F.col("comp").alias("c")), "a", "left").join(group.select(F.col("row").alias("b"), F.col("comp").alias("d")), "b", "left")
    return both.where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b")


def _counted_pairs(entries: DataFrame, marks: DataFrame, similar: tuple[int, int], group: DataFrame | None) -> DataFrame:
    """(a, b): rows of different components that share LEAST columns of at most FEW rows, and pass the bounds. marks: (row, size, bits)."""
    p, q = similar
    few = entries.where(F.col("n") <= FEW)
    left = few.select("h", "times", F.col("row").alias("a"), F.col("size").alias("s"))
    right = few.select("h", F.col("row").alias("b"), F.col("size").alias("t"))
    both = left.join(right, "h").where((F.col("a") < F.col("b")) & (p * F.greatest("s", "t") <= q * F.least("s", "t")))
    pairs = both.groupBy("a", "b").agg(F.sum("times").alias("shared")).where(F.col("shared") >= least_shared(similar)).select("a", "b")
    pairs = stage(pairs if group is None else _apart(pairs, group), "counted")
    wanted = pairs.select(F.xxhash64("a").alias("k")).unionByName(pairs.select(F.xxhash64("b").alias("k"))).distinct()
    own, _ = sieved(marks, F.xxhash64("row"), wanted)
    own = stage(own, "counted-bits")
    both = pairs.join(own.select(F.col("row").alias("a"), F.col("size").alias("s"), F.col("bits").alias("p")), "a").join(own.select(F.col("row").alias("b"), F.col("size").alias("t"), F.col("bits").alias("q")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fits = [near(*r, similar) for r in zip(x["s"], x["t"], x["p"], x["q"], strict=True)]
            yield x[["a", "b"]][np.array(fits, bool)]

    return both.mapInPandas(run, "a long, b long")


def _between(units: DataFrame, group: DataFrame) -> DataFrame:
    """The units whose rows are of several components, with `comp`."""
    named = units.drop("comp").join(group, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    named = stage(named, "units-again")
    mixed = named.groupBy("h", "i", "j").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    return named.join(mixed.select("h", "i", "j"), ["h", "i", "j"], "left_semi")


def _units(entries: DataFrame, marks: DataFrame, group: DataFrame | None) -> DataFrame:
    """(h, i, j, block, row, comp, size, bits): the rows of each unit of several components; i and j are a pair of row blocks of column h. marks: (row, size, bits)."""
    large = entries.where(F.col("n") > FEW)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = large.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row")
    large = large.withColumn("comp", F.col("row")) if group is None else _between(large, group)
    wanted, _ = sieved(marks, F.xxhash64("row"), large.select(F.xxhash64("row")).distinct())
    return stage(large.join(wanted, "row"), "units")


def _groups(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("u").alias("row"), F.col("v").alias("comp"))


def class_links(docs: DataFrame, heads: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """(u, v): links between rows of heads that join exactly the components of all similar pairs.

    docs: (file, line, text); heads: (row, file, line, size, bits, head), distinct
    sets. With a column `mark` covering SimHash comes first: its pairs are checked on whole
    sets, and the product is asked only for links between the components these make.
    """
    nodes, marks = heads.select("row", "file", "line"), heads.select("row", "size", "bits")
    links = _links(docs, nodes, near_pairs(heads.select("row", "mark")), width, similar) if "mark" in heads.columns else None
    group = None if links is None else _groups(links)
    entries = _entries(heads)
    units, more = _units(entries, marks, group), _counted_pairs(entries, marks, similar, group)
    open_, whole = units, False
    while True:
        work = open_.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
        found = stage(work.mapInPandas(_products(similar, whole), FOUND), "products")
        asked = found.where(F.col("kind") == NEAREST).groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b")
        pairs = found.where(F.col("kind") == PAIR).select("a", "b").unionByName(asked)
        pairs, more = (pairs.unionByName(more), None) if more is not None else (pairs, None)
        pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        new = _links(docs, nodes, pairs, width, similar)
        links = new if links is None else links.unionByName(new)
        again = found.where(F.col("kind") == AGAIN).select("h", "i", "j")
        if whole or again.isEmpty():
            return links
        whole = WORTH * new.count() <= pairs.count()
        open_ = _between(units.join(again, ["h", "i", "j"], "left_semi"), _groups(links))


def classes(base: DataFrame, width: int, similar: tuple[int, int], empty_links: bool, marked: int | None = None) -> DataFrame:
    """base (doc_id LONG, text, file, line) as (doc_id, n_shingles, component_id, kept, file, line); empty_links: sets without shingles are one class.

    marked: the words of a shingle of the SimHash fingerprints whose links are taken first; None: none are.
    """
    ship_code(base.sparkSession)
    rows = base.withColumn("row", F.monotonically_increasing_id())
    kind = "doc_id long, row long, file long, line long, size long, digest binary, bits binary, head array<long>" + ("" if marked is None else ", mark long")
    sets = stage(rows.mapInPandas(_described(counters(base, width), width, similar, marked), kind), "sets")
    some = sets.select("doc_id", "row", "file", "line", "size", "digest")
    linked = some if empty_links else some.where("size > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("best")
    alike = stage(linked.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")), "set-classes")
    copies = stage(linked.join(alike.where("n > 1"), "digest").where("row <> best.row").select("row"), "copies")
    maybe, clean = sieved(sets.where(F.size("head") > 0).select("row", "file", "line", "size", "bits", "head", *(() if marked is None else ("mark",))), F.xxhash64("row"), copies.select(F.xxhash64("row")))
    heads = stage(maybe.join(copies, "row", "left_anti").unionByName(clean), "heads")
    roots = components(class_links(base, heads, width, similar))
    owner = stage(alike.join(roots.withColumnRenamed("v", "root"), F.col("best.row") == F.col("u"), "left").select("digest", "best", F.coalesce("root", "best.row").alias("root")), "class-roots")
    final = owner.select("digest", "root").join(owner.groupBy("root").agg(F.min("best").alias("top")), "root").select("digest", "top")
    out = linked.join(final, "digest").select("doc_id", F.col("size").alias("n_shingles"), F.col("top.doc_id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("kept"), "file", "line")
    if empty_links:
        return out
    return out.unionByName(some.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "file", "line"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the one row of each component that stays), file, line (where the row lies).

    Documents link when the Jaccard similarity of their sets of `width`-word
    shingles is p / q or more, similar being (p, q); with fewer words the whole
    sequence is the one shingle. component_id is the smallest id reachable over
    links. Documents without words (null, empty) link with nothing. Very long texts
    are compared whole. Equal sets, repeated rows among them, are one component. A
    null id is a component's only if it has no other. Of equal smallest ids the
    first row read is kept. Extra columns are not read; no rows give no rows.
    """
    base = placed(docs).select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), F.col(f"row.{text_col}").cast("string").alias("text"), "file", "line")
    return classes(base, width, similar, False)
