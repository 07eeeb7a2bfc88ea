"""Mixing sources to target weights.

Sizes are summed per source; the shares follow from the sums and the sources'
weights; every document is then taken floor(rate) times and once more with
probability rate - floor(rate), decided by a seeded hash of the document, so
reruns agree and no row has to meet another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.llm.staging import stage

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MOST_TIMES = 1.5, 2.0
SEED = 20240607


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+; each word is first one letter, then the spaces go."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def draw(id_col: Column, text: Column) -> Column:
    """A number in [0, 1) from the document's id, without one from its text."""
    h = F.when(id_col.isNull(), F.xxhash64(F.lit(SEED), text)).otherwise(F.xxhash64(F.lit(SEED), id_col))
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources (source, size) with rank: its place (from 0) by code point, null last.

    Range partitions are ranked on their own and shifted by the rows of those
    before them, so no task sees all sources.
    """
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    placed = sources.withColumn("late", F.col("source").isNull()).repartitionByRange(parts, "late", "source")
    placed = stage(placed.withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("late", "source")) - 1
    return placed.withColumn("inside", inside).join(F.broadcast(shift), "part").select("source", "size", (F.col("inside") + F.col("shift")).alias("rank"))


def source_rates(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    The targets are min(most * size, level * weight). The level rises until they
    add up: each round gives the excess of the sources that stop to all others.
    Only the four sums of a round come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked_sources(sizes.groupBy("source").agg(F.sum("size").alias("size")))
    table = stage(table.select("source", F.col("size").alias("source_size"), weight.alias("weight")), "source-sizes")
    level, stopped = 0.0, -1
    while True:
        full = F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight")
        got = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.lit(most) * F.col("source_size"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got["n"] == stopped or not got["weight"]:
            break
        stopped, level = got["n"], (share * (got["all"] or 0) - (got["full"] or 0.0)) / got["weight"]
    target = F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight"))
    table = table.select("source", "source_size", target.alias("target"))
    return table.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def copies(rate: Column, draw_: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (draw_ < rate - whole).cast("long")).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col)).alias("draw")
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies.

    Null text has size 0 and is taken floor(rate) or one more times like any
    other, which adds nothing; null sources are one source, the last; a null id
    is drawn by its text; repeated rows are drawn alike. No rows give no rows.
    """
    base = stage(sized(docs), "mix-sizes")
    rates = stage(source_rates(base.select("source", "size")), "mix-rates").withColumnRenamed("source", "of")
    both = base.join(rates, F.col("source").eqNullSafe(F.col("of")))
    n = copies(F.col("rate"), F.col("draw"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), "source", n.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of docs, all its columns, as often as it is taken."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rates = stage(source_rates(sizes), "mix-rates").select(F.col("source").alias("of"), "rate")
    base = docs.select(F.struct("*").alias("row"))
    both = base.join(rates, F.col("row")[source_col].eqNullSafe(F.col("of")))
    n = copies(F.col("rate"), draw(F.col("row")[id_col], F.col("row")[text_col]))
    return both.select("row", n.cast("int").alias("n")).select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")
