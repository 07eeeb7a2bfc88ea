"""SimHash near-deduplication by covering locality-sensitive hashing.

A bit of the fingerprint is given one of the 15 non-zero vectors of 4 bits. For
each such vector a there is a table whose mask holds the bits with odd inner
product with a. Three differing bits leave three equations in four unknowns, so
some non-zero a is even on all of them: in that table the two fingerprints agree
on the whole mask. Every pair within the radius thus meets in some table.

Buckets hold distinct fingerprints. One with more than SMALL of them is dealt
again by its mask plus each quarter of its free bits: a pair that differs in 3
bits agrees on one of 4 quarters, so no link is lost, and after at most a few
rounds the free bits leave room for SMALL only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.components import components
from tensorloom.llm.staging import ship_code, stage

BITS, RADIUS, SEED = 64, 3, 42
SMALL = 2048
BLOCK = 1 << 19
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2**(radius + 1) - 1 masks; any `radius` bits are all outside at least one of them."""
    size = 1 << (radius + 1)
    vectors = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, v in enumerate(vectors) if bin(v & a).count("1") % 2) for a in range(1, size)]


def split_masks(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The mask with each of radius + 1 parts of its free bits."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j :: radius + 1]) for j in range(radius + 1)]


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, some at a time; words are lower-cased in A-Z only.

    Fewer words than width: the whole sequence is one shingle; no word: none.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    keep = word.copy()
    keep[starts[1:] - 1] = True
    raw[blank] = 32
    norm = raw[keep].tobytes()
    place = np.cumsum(keep) - 1
    begin = place[starts]
    end = np.append(begin[1:] - 1, len(norm))
    n = max(1, len(begin) - width + 1)
    begin, end = begin[:n], end[-n:]
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        a, b = begin[lo : lo + BLOCK].tolist(), end[lo : lo + BLOCK].tolist()
        yield np.array([digest(norm[x:y], SEED) for x, y in zip(a, b, strict=True)], np.uint64)


def fingerprint(text: str, width: int) -> int:
    """A bit is set where over half of the shingles have it; zero without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, width):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 1 << 14):
            ones += bits[lo : lo + (1 << 14)].sum(axis=0, dtype=np.uint16)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()) if n else 0


def _fingerprints(width: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [signed(fingerprint(x if isinstance(x, str) else "", width)) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "row": b["row"], **{c: b[c] for c in carry}, "mark": np.array(marks, np.int64)})

    return run


def _star(marks: np.ndarray) -> list[tuple[int, int]]:
    """Links of one bucket, as a star about the first of each of its components."""
    out, open_ = [], np.arange(len(marks))
    while len(open_) > 1:
        centre, front, open_ = open_[0], [open_[0]], open_[1:]
        while front and len(open_):
            near = np.bitwise_count(marks[open_] ^ marks[front.pop()]) <= RADIUS
            if near.any():
                got = open_[near].tolist()
                out += [(centre, i) for i in got]
                front += got
                open_ = open_[~near]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (mask, key); at most one bucket, of SMALL marks, is carried from batch to batch."""
    held = None

    def work(x: pd.DataFrame) -> pd.DataFrame:
        marks = x["mark"].to_numpy("int64").view(np.uint64)
        mask, key = x["mask"].to_numpy(), x["key"].to_numpy()
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.append(0, edge), np.append(edge, len(x))
        size = ends - starts
        two = starts[size == 2]
        two = two[np.bitwise_count(marks[two] ^ marks[two + 1]) <= RADIUS]
        a, b = [two], [two + 1]
        for lo, hi in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            got = np.array(_star(marks[lo:hi]), np.int64).reshape(-1, 2) + lo
            a.append(got[:, 0])
            b.append(got[:, 1])
        m = marks.view(np.int64)
        return pd.DataFrame({"a": m[np.concatenate(a)], "b": m[np.concatenate(b)]})

    for x in batches:
        if not len(x):
            continue
        x = x if held is None else pd.concat([held, x], ignore_index=True)
        last = ((x["mask"] == x["mask"].iloc[-1]) & (x["key"] == x["key"].iloc[-1])).to_numpy()
        at = int(last.argmax())
        held = x.iloc[at:]
        if at:
            yield work(x.iloc[:at].reset_index(drop=True))
    if held is not None:
        yield work(held.reset_index(drop=True))


def fingerprint_links(marks: DataFrame) -> DataFrame:
    """marks (mark): distinct fingerprints. (a, b): links that join exactly what distances of 3 or less join."""
    spark = marks.sparkSession
    ship_code(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = [signed(m) for m in covering_masks()]
    rows = marks.select("mark", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("key", F.col("mark").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = stage(rows.join(sizes, ["mask", "key"]).select("mark", "mask", "key", "n"), "buckets")
        calm = rows.where(F.col("n") <= SMALL).select("mark", "mask", "key")
        links = calm.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", "mark").mapInPandas(_links, "a long, b long")
        found = links if found is None else found.unionByName(links)
        hot = rows.where(F.col("n") > SMALL)
        wide = [r["mask"] for r in hot.select("mask").distinct().collect()]
        if not wide:
            return found
        again = {m: [signed(x) for x in split_masks(m & (2**64 - 1))] for m in wide}
        pairs = [F.lit(x) for m, own in again.items() for x in (m, F.array(*[F.lit(y).cast("long") for y in own]))]
        table = F.create_map(*[F.lit(x).cast("long") if i % 2 == 0 else x for i, x in enumerate(pairs)])
        rows = hot.select("mark", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))


def node_links(nodes: DataFrame) -> DataFrame:
    """nodes (mark, node): one node of each distinct fingerprint. (u, v): links of nodes that join exactly what distances of 3 or less join."""
    links = fingerprint_links(nodes.select("mark"))
    return links.join(nodes.select(F.col("mark").alias("a"), F.col("node").alias("u")), "a").join(nodes.select(F.col("mark").alias("b"), F.col("node").alias("v")), "b").select("u", "v")


def near_pairs(marks: DataFrame) -> DataFrame:
    """marks (row, mark), rows different. (a, b), a < b: pairs that join exactly the rows that equal fingerprints and distances of 3 or less join.

    Stars about the smallest row of each fingerprint, and links between these rows; no pair comes twice.
    """
    nodes = stage(marks.groupBy("mark").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")), "mark-nodes")
    alike = marks.join(nodes.where("n > 1").select("mark", "node"), "mark").where("row <> node").select(F.col("node").alias("a"), F.col("row").alias("b"))
    apart = node_links(nodes.select("mark", "node")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return stage(alike.unionByName(apart), "near-pairs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, and the long columns named in carry.

    component_id is the smallest id reachable over links of 3 or fewer differing
    bits; equal fingerprints link, those of texts without words (zero) too.
    kept: the one row of each component that stays, that with the smallest id,
    of repeated rows the first read. A null id is never a component's smallest
    unless the component has no other; then component_id is null. Extra columns
    are not read; no rows give no rows.
    """
    ship_code(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), *carry)
    more = "".join(f", {c} long" for c in carry)
    base = stage(base.mapInPandas(_fingerprints(width, carry), f"doc_id long, row long{more}, mark long"), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("best")
    classes = stage(base.groupBy("mark").agg(best), "fingerprint-classes")
    nodes = classes.select("mark", F.col("best.row").alias("node"))
    roots = components(node_links(nodes))
    owner = classes.join(roots.withColumnRenamed("v", "root"), F.col("best.row") == F.col("u"), "left")
    owner = stage(owner.select("mark", "best", F.coalesce("root", "best.row").alias("root")), "fingerprint-roots")
    top = owner.groupBy("root").agg(F.min("best").alias("top"))
    final = owner.select("mark", "root").join(top, "root").select("mark", "top")
    out = base.join(final, "mark")
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), F.col("top.doc_id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("kept"), *carry
    )
