"""Five stages from raw documents to packed sequences.

run(spark, sf_dir) applies STAGES to the documents table: a classifier rejects
low-quality and toxic documents, repeated lines go, one document of each group
of near copies stays, sources are mixed to their target weights, and what is
left is packed. Each stage's result is written as Parquet and read again as the
next one's input, which cuts lineage: a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import config_packing, line_dedup, mixing, near_copies, quality
from tensorloom.llm.sieve import without
from tensorloom.llm.staging import placed, stage


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; labels come from the labels table.

    Null texts count as empty, null sources and languages are sites of their own;
    repeated rows are judged alike; without labels of both kinds all rows stay.
    """
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars follows. Texts that lose nothing stay as they are, null ones too."""
    out = line_dedup.dedup_lines(docs)
    cut = F.col("n_dropped") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))
    chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": chars}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts of Jaccard similarity 0.8 or more (5-word shingles) stays, that with the smallest id.

    Covering SimHash finds copies first, checked exactly; the Jaccard join finds the links that its radius misses.
    Texts without words (null, empty) are one group; repeated rows are copies; a
    null id stays only where its group has no other; extra columns stay as they
    are; no rows give no rows.
    """
    base = placed(docs)
    return without(base, near_copies.dropped_rows(base.select("row.doc_id", "row.text", "file", "line")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, all columns.

    Null texts have size 0; null sources are one source; a null id is drawn by its
    text; repeated rows are drawn alike; no rows give no rows.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences; a document of several copies has its pieces as often.

    Null and empty texts are the end id alone; no rows give no rows.
    """
    return config_packing.pack(docs)


STAGES = [
    ("quality", classify_quality),
    ("lines", drop_lines),
    ("near_copies", drop_similar),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The classifier, the hash-seeded mix and the packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
