"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; an exact second
look verifies them and yields their winners, which are broadcast so that the
rows of large groups are decided where they lie. All other digests are grouped
by an ordinary shuffle, in which no group can then exceed N / (k + 1) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.llm.staging import ship_code, stage

SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with every run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def _reduce(counts: pd.Series, k: int) -> pd.Series:
    """The Misra-Gries summary of at most k counters for these counts."""
    if len(counts) > k:
        counts = counts - counts.nlargest(k + 1).iloc[-1]
        counts = counts[counts > 0]
    return counts


def _summaries(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = pd.Series(dtype="int64")
        for b in batches:
            own = b.groupby("digest")["n"].sum() if "n" in b else b["digest"].value_counts()
            total = _reduce(total.add(own, fill_value=0).astype("int64"), k)
        yield pd.DataFrame({"digest": total.index.astype(str), "n": total.to_numpy("int64")})

    return run


def frequent_candidates(digests: DataFrame, k: int) -> DataFrame:
    """At most k digests, among them every one with more than N / (k + 1) rows.

    Summaries of partitions are merged as a tree, 64 to 1 in each step, so that
    no task reads more than 64 * k counters.
    """
    ship_code(digests.sparkSession)
    parts = max(1, digests.rdd.getNumPartitions())
    out = digests.select("digest").mapInPandas(_summaries(k), "digest string, n long")
    while parts > 1:
        parts = -(-parts // 64)
        out = out.repartition(parts).mapInPandas(_summaries(k), "digest string, n long")
    return out.select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of each group stays. Null text counts as empty;
    null ids sort last, so such a row stays only where its group has no id; of
    repeated rows with one id exactly one is kept. No rows give no rows. Other
    columns are not read. k: counters of a summary, by default four a shuffle
    partition, 256 to 8192: what is broadcast never exceeds k rows.
    """
    spark = docs.sparkSession
    k = k or min(8192, max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")
    )
    base = stage(base, "digests")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    heavy = base.join(F.broadcast(stage(frequent_candidates(base, k), "candidates")), "digest", "left_semi")
    winners = stage(heavy.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(first).alias("win")).where("size > 1"), "winners")
    tagged = base.join(F.broadcast(winners), "digest", "left")
    own = Window.partitionBy("digest")
    rest = tagged.where(F.col("size").isNull()).select(
        "id", "digest", "row", F.count(F.lit(1)).over(own).alias("size"), F.min(first).over(own).alias("win")
    )
    large = tagged.where(F.col("size").isNotNull()).select("id", "digest", "row", "size", "win")
    return large.unionByName(rest).select(
        F.col("id").alias("doc_id"),
        F.col("win.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("win.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d"""
