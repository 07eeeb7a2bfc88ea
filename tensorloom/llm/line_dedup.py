"""Line deduplication over levelled sorted runs of line hashes.

The documents are dealt into batches. Each batch is merge-joined with the runs
kept so far: keys that none of them has (the anti-join) become a run of their
own, known keys become repeats, in one written table. A run is a bucketed and
sorted table, so a join reads it without a shuffle. When a level holds FANOUT
runs they are merged bucket by bucket into one run of the next level. Runs never
share a key.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.sieve import sieved
from tensorloom.llm.staging import fresh_path, shared_dir, stage

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES, FANOUT = 4, 2
MIN_POINTS, MIN_DOCS = 40, 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ascii_lower(x: Column) -> Column:
    """A-Z only; for pure ASCII the much faster lower() is the same."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def key_hash(key: Column) -> tuple[Column, Column]:
    """128 bits as two longs, from two seeds."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _database(spark: SparkSession) -> str:
    """A database of this application's own, in the shared folder: no table goes where users keep theirs."""
    name = "tensorloom_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name


class LevelledRuns:
    """Runs (h1, h2, n, last): a key, the documents that held it when it was new, and the largest id among them.

    A batch is written once, in two parts: keys that no run has are the new run,
    the others wait as repeats. A name stands for the new part of its table.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = _database(spark)
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _save(self, run: DataFrame) -> str:
        """run has `known`."""
        name = f"{self.database}.line_run_{uuid.uuid4().hex}"
        writer = run.write.format("parquet").option("path", fresh_path(self.spark, "run")).option("compression", "zstd").partitionBy("known")
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.names.append(name)
        return name

    def _part(self, name: str, known: bool) -> DataFrame:
        return self.spark.table(name).where(F.col("known") == known).drop("known")

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._put(level + 1, self._compact(level))

    def _compact(self, level: int) -> str:
        """Merges a level's runs bucket by bucket, without a shuffle; as they share no key, every row has one side only."""
        runs, self.levels[level] = self.levels[level], []
        merged = self._part(runs[0], False)
        for x in runs[1:]:
            other = self._part(x, False).select("h1", "h2", F.col("n").alias("n2"), F.col("last").alias("last2"))
            merged = merged.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("n", "n2").alias("n"), F.coalesce("last", "last2").alias("last"))
        return self._save(merged.withColumn("known", F.lit(False)))

    def runs(self) -> list[DataFrame]:
        return [self._part(x, False) for level in self.levels for x in level]

    def ingest(self, lines: DataFrame) -> None:
        """lines: (doc_id, h1, h2), of documents that no earlier batch had."""
        each = lines.select("h1", "h2", "doc_id").distinct()
        batch = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("h1", "h2", F.lit(True).alias(f"in{i}")).hint("merge"), ["h1", "h2"], "left")
            known = known | F.coalesce(F.col(f"in{i}"), F.lit(False))
        self._put(0, self._save(batch.select("h1", "h2", "n", "last", known.alias("known"))))

    def totals(self) -> DataFrame:
        """(h1, h2, n, last) over all batches; the runs stay where they are, only repeats are shuffled."""
        more = None
        for x in self.names:
            part = self._part(x, True)
            more = part if more is None else more.unionByName(part)
        more = stage(more.groupBy("h1", "h2").agg(F.sum("n").alias("m"), F.max("last").alias("late")), "line-more")
        out = None
        for run in self.runs():
            run = run.join(more.hint("merge"), ["h1", "h2"], "left").select(
                "h1", "h2", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("last", "late").alias("last")
            )
            out = run if out is None else out.unionByName(run)
        return out

    def close(self) -> None:
        for x in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")


def _dropped(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(gone_from, gone_text, gone): for each document and text that loses lines, the rising places of those lines."""
    spark = docs.sparkSession
    keyed = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("of"), F.posexplode(lines_of(F.col(text_col))).alias("place", "line")
    )
    keyed = keyed.select("doc_id", "of", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= MIN_POINTS)
    h1, h2 = key_hash(F.col("key"))
    keyed = keyed.select("doc_id", "of", "place", h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    keyed = stage(keyed, "line-keys", ("batch",))
    index = LevelledRuns(spark)
    try:
        for b in range(batches):
            index.ingest(keyed.where(F.col("batch") == b).select("doc_id", "h1", "h2"))
        frequent = stage(index.totals().where(F.col("n") >= MIN_DOCS).select("h1", "h2", "last"), "frequent-lines")
    finally:
        index.close()
    gone = keyed.join(frequent, ["h1", "h2"]).where(F.col("doc_id") != F.col("last"))
    gone = gone.groupBy(F.col("doc_id").alias("gone_from"), F.col("of").alias("gone_text")).agg(F.sort_array(F.collect_set("place")).alias("gone"))
    return stage(gone, "gone-lines")


def _without(lines: Column, gone: Column) -> Column:
    """lines without those at the rising places `gone`: the stretches between them."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda i: F.slice(lines, F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(row STRUCT, n_lines, n_dropped, kept_text): every input row, its columns in `row`.

    Lines end at \\n only; null or empty text is one empty line; very long texts
    count whole. A line's key is the line without white space at its ends and with
    A-Z lower-cased. Keys of at least 40 code points that at least 5 documents hold
    lose all their lines but those in the document with the largest id. Rows with
    one id are one document, repeated rows lose the same lines. Rows without an id
    can't be told apart: they are not counted and lose nothing. Extra columns,
    whatever their names, travel inside `row`. No rows give no rows.

    Only rows that a bitmap of ids does not clear are shuffled to meet the places
    of their lost lines; the others stay where they are. That join has one form at
    every size: a large corpus can't broadcast the places, so a small one doesn't.
    """
    gone = _dropped(docs, id_col, text_col, batches)
    base = docs.select(F.struct("*").alias("row"))
    doc_id, text = F.col("row")[id_col].cast("long"), F.col("row")[text_col]
    lines = lines_of(text)

    def report(rows: DataFrame, dropped: Column, kept: Column) -> DataFrame:
        return rows.select("row", F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"))

    some, clean = sieved(base, F.when(doc_id.isNotNull(), F.xxhash64(doc_id, F.xxhash64(text))), gone.select(F.xxhash64("gone_from", "gone_text")))
    some = some.join(gone.hint("merge"), (doc_id == F.col("gone_from")) & (F.xxhash64(text) == F.col("gone_text")), "left")
    whole = F.coalesce(text, F.lit(""))
    kept = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(_without(lines, F.col("gone")), "\n"))
    return report(some, F.coalesce(F.size("gone"), F.lit(0)), kept).unionByName(report(clean, F.lit(0), whole))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.key IS NOT NULL AND f.last <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE f.key IS NULL OR f.last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id"""
