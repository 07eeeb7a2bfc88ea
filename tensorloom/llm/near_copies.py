"""Near copies by covering SimHash with an exact check, and an exact way for what its radius does not reach.

5-word shingle sets of Jaccard similarity 0.8 or more link. The fingerprints and
covering tables of op4 (3 words, 3 bits) give candidates, whose whole sets are
compared; links between different components of these, of fingerprints further
apart, come from the join of jaccard_join.py. Texts without words are one group;
all similar pairs count, one document of each component stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import jaccard_join

WIDTH, SIMILAR = 5, (4, 5)
#: Words of a shingle of the fingerprints, as in op4.
MARKED = 3


def dropped_rows(docs: DataFrame) -> DataFrame:
    """(file, line) of every document that is not the one that stays of its component.

    docs: (doc_id, text, file LONG, line LONG), the last two naming a row. Documents
    link whose sets of 5-word shingles (fewer words: the whole sequence) have a
    Jaccard similarity of 0.8 or more; texts without words (null, empty) link with
    each other. Very long texts are compared whole. That with the smallest id
    stays, of equal ids the first read; a null id only where there is no other.
    Extra columns are not read; no rows give no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "file", "line")
    return jaccard_join.classes(base, WIDTH, SIMILAR, True, MARKED).where(~F.col("kept")).select("file", "line")
