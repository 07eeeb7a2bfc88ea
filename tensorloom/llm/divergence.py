"""Source divergence audit: how far each source of a language is from the others, and by which terms.

Sort-based streaming. Each task counts its own documents' terms by (lang,
source, term) in blocks of bounded size, so that what a frequent term or a hot
source sends on depends on the number of blocks, not of documents. A block's rows, a
term with its sources in order, are dealt by (lang, term) and sorted by (lang, term,
block); a run-length scan adds documents and occurrences up by source, holds no more
than one run's sources, and drops terms of too few documents as the run ends. A second scan of
the kept terms' runs emits partial sums for pairs of sources that both have the
term. Pairs where one source lacks a term follow from the histogram of the
other's counts, which is far smaller than the terms.

Probabilities are whole numbers of a billionth, divergences whole quotients; all
of it is integer arithmetic (decimals where products pass 63 bits).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.staging import ship_code, stage

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Distinct (lang, source, term) that a task holds before it sends a block on, and pair sums before they are added up.
BLOCK_ENTRIES, PAIR_ENTRIES = 1 << 19, 1 << 20

#: Bytes: letters A-Z to a-z, other ASCII bytes to a space, those of other characters stay.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (lang, term, block, sources, documents, occurrences) for each term of each block of this task's documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    part, number = TaskContext.get().partitionId(), 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang in sorted({x for x, _ in held}):
            own = [(source, *pair) for (x, source), pair in sorted(held.items()) if x == lang]
            names = pa.array(chain.from_iterable(count for _, count, _ in own), pa.binary()).dictionary_encode()
            code = names.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            size = np.array([len(count) for _, count, _ in own])
            sources = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(own)), size)[order], pa.array([x for x, *_ in own], pa.string())).cast(pa.string())
            n = np.fromiter(chain.from_iterable(count.values() for _, count, _ in own), np.int64, len(code))[order]
            docs = np.fromiter(chain.from_iterable(map(docs.__getitem__, count) for _, count, docs in own), np.int64, len(code))[order]
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(code, minlength=len(names.dictionary)))).astype(np.int32))
            rows = len(names.dictionary)
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (sources, pa.array(docs), pa.array(n))]
            whole = pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(rows, np.int64))), names.dictionary.cast(pa.string()), pa.array(np.full(rows, (part << 32) + number)), *lists], names=BLOCK_COLUMNS)
            for lo in range(0, rows, 1 << 14):
                yield whole.slice(lo, 1 << 14)
        held.clear()

    for b in batches:
        for lang, source, text in zip(*[b.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
            got = terms(text)
            if got:
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                count.update(got)
                docs.update(set(got))
        if sum(len(c) for c, _ in held.values()) > BLOCK_ENTRIES:
            yield from out()
            number += 1
    yield from out()


BLOCK_COLUMNS = ["lang", "term", "block", "sources", "docs", "n"]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed_runs(rows: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Rows sorted by (lang, term): (lang, term) of each run; and by run and source: the run, the source, documents, occurrences."""
    lang, term = (rows[c].combine_chunks() for c in ("lang", "term"))
    new = np.ones(len(term), bool)
    new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    lists = {c: rows[c].combine_chunks() for c in ("sources", "docs", "n")}
    run = np.repeat(np.cumsum(new) - 1, lists["sources"].value_lengths().to_numpy())
    names = lists["sources"].flatten().dictionary_encode()
    many = max(1, len(names.dictionary))
    key = run * many + names.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _edges(key)
    docs, n = (np.add.reduceat(lists[c].flatten().to_numpy()[order], at) for c in ("docs", "n"))
    return rows.select(["lang", "term"]).filter(pa.array(new)), key[at] // many, names.dictionary.take(pa.array(key[at] % many)), docs, n


def _runs(least: int):
    """Sorted block rows to (lang, term, source, n, lang_n, lead) of terms of `least` or more documents; lead marks a term's first row.

    What is carried from batch to batch is one run, added up to a row: as long as the term's sources.
    """

    def whole(runs: pa.Table, run: np.ndarray, source: pa.Array, docs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = _edges(run)
        size = np.diff(np.append(at, len(run)))
        keep = np.repeat(np.add.reduceat(docs, at), size) >= least
        if not keep.any():
            return
        lead = np.zeros(len(run), bool)
        lead[at] = True
        total = np.repeat(np.add.reduceat(n, at), size)
        names = runs.take(pa.array(run[keep]))
        made = [names["lang"].combine_chunks(), names["term"].combine_chunks(), source.filter(pa.array(keep)), pa.array(n[keep]), pa.array(total[keep]), pa.array(lead[keep])]
        yield pa.RecordBatch.from_arrays(made, names=["lang", "term", "source", "n", "lang_n", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]).select(["lang", "term", "sources", "docs", "n"])
            runs, run_, source, docs, n = _summed_runs(rows if held is None else pa.concat_tables([held, rows]))
            last = int(np.searchsorted(run_, run_[-1]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(run_) - last], pa.int32()), x) for x in (source[last:], pa.array(docs[last:]), pa.array(n[last:]))]
            end = runs.slice(runs.num_rows - 1)
            held = pa.table([end["lang"].combine_chunks(), end["term"].combine_chunks(), *lists], names=rows.column_names)
            if last:
                yield from whole(runs, run_[:last], source[:last], docs[:last], n[:last])
        if held is not None:
            yield from whole(*_summed_runs(held))

    return run


def f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); both up to 10^9 + 1."""
    return (p - q) ** 2 // (p + q)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (lang, term, source): for each pair of sources of a run, what the pair's sum gains beyond both single terms."""
    held = None
    many: list[pd.DataFrame] = []
    size = 0

    def work(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        at = _edges(x["lang"].to_numpy(object), x["term"].to_numpy(object))
        lang, source = x["lang"].to_numpy(object), x["source"].to_numpy(object)
        p, none = x["p"].to_numpy("int64"), x["p0"].to_numpy("int64")
        length = np.diff(np.append(at, len(x)))
        place = np.arange(len(x)) - np.repeat(at, length)
        after = np.repeat(length, length) - place - 1  # partners of a row: those after it in its run
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(after[lo:]), PAIR_ENTRIES, side="right")) + lo)
            a = np.repeat(np.arange(lo, hi), after[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            if len(a):
                value = f_of(p[a], p[b]) - f_of(p[a], none[b]) - f_of(none[a], p[b]) + f_of(none[a], none[b])
                yield pd.DataFrame({"lang": lang[a], "a": source[a], "b": source[b], "value": value})
            lo = hi

    def added() -> pd.DataFrame:
        return pd.concat(many).groupby(["lang", "a", "b"], sort=False, as_index=False)["value"].sum()

    def take(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nonlocal size, many
        for y in work(x):
            many.append(y)
            size += len(y)
            if size > PAIR_ENTRIES:
                z = added()
                many, size = [], 0
                yield z

    for x in batches:
        if not len(x):
            continue
        x = x if held is None else pd.concat([held, x], ignore_index=True)
        last = _edges(x["lang"].to_numpy(object), x["term"].to_numpy(object))[-1]
        held = x.iloc[last:]
        if last:
            yield from take(x.iloc[:last])
    if held is not None:
        yield from take(held)
    if many:
        yield added()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact; null where there is no term."""
    top, under = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", top, under) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows give each other source of the lang and the divergence, `term` rows the top over-used terms.

    A term is kept in a lang that has it in least_docs or more documents (rows:
    repeated rows count each). Null text, lang and source are ''. Sources without
    kept terms have their `pair` rows (0 where the lang keeps no term). Equal
    values are ranked by item in UTF-8 order. Very long texts are counted whole;
    extra columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    blocks = rows.mapInArrow(_blocks, "lang string, term string, block long, sources array<string>, docs array<long>, n array<long>")
    scan = blocks.repartition("lang", "term").sortWithinPartitions("lang", "term", "block")
    kept = stage(scan.mapInArrow(_runs(least_docs), "lang string, term string, source string, n long, lang_n long, lead boolean"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["v", "lang_total", "total"])
    groups = stage(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")
    occ = kept.join(groups, ["lang", "source"])
    occ = occ.select("lang", "term", "source", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    occ = stage(occ, "occurring")

    used = occ.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    used = used.withColumn("rank", best).where(F.col("rank") <= top)

    both = occ.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").select("lang", "term", "source", "p", "p0").mapInPandas(_pairs, "lang string, a string, b string, value long")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    single = occ.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("times")).join(other, "lang").where("source <> other")
    single = single.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("times") * (_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0")))).alias("value"))
    base = groups.join(other, "lang").where("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("v") * _f(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    sums = stage(base.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair-sums")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    return pairs.unionByName(used).select("lang", "source", "part", "item", "value", "rank")


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
x AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM x GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS m FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, k.lang_n FROM g JOIN k ON k.lang = g.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + {UNIT}::HUGEINT * (c.n + 2) // (t.total + 2 * l.v) AS p, 1 + {UNIT}::HUGEINT * (c.lang_n + 2) // (l.m + 2 * l.v) AS q FROM c JOIN t ON t.lang = c.lang AND t.source = c.source JOIN l ON l.lang = c.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
y AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM z UNION ALL SELECT * FROM y))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
