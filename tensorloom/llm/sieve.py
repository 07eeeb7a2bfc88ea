"""Splits rows by a bounded bitmap of hashes, so that most rows need no shuffle before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.staging import stage

#: Bits of the bitmap: 16 MB at most are broadcast, whatever the number of hashes. Beyond some 10**8 hashes it lets most rows through.
BITS = 1 << 27
CHUNK = 1 << 15


def sieved(df: DataFrame, key: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the hashes, rows whose key is not). key: LONG; hashes: one LONG column, with nulls left out.

    The first part holds every row whose key is among them, and few others (about
    their number / BITS of the rest): an exact join follows. A null key is in the
    second part. The table of bitmaps has at most BITS / CHUNK rows of 4 KB.
    """
    place = F.pmod(F.col(hashes.columns[0]), F.lit(BITS))
    chunks = hashes.where(F.col(hashes.columns[0]).isNotNull()).select(place.alias("place"))
    chunks = chunks.groupBy(F.floor(F.col("place") / CHUNK).alias("sieve_chunk")).agg(F.bitmap_construct_agg(F.pmod(F.col("place"), F.lit(CHUNK))).alias("sieve_bits"))
    chunks = F.broadcast(stage(chunks, "sieve"))
    own = F.coalesce(F.pmod(key, F.lit(BITS)), F.lit(-1))
    rows = df.select(F.struct("*").alias("sieve_row"), own.alias("sieve_place")).withColumn("sieve_key", F.floor(F.col("sieve_place") / CHUNK))
    both = rows.join(chunks, F.col("sieve_key") == F.col("sieve_chunk"), "left")
    at = F.pmod(F.col("sieve_place"), F.lit(CHUNK))
    byte = F.conv(F.hex(F.substring(F.col("sieve_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return both.where(hit).select("sieve_row.*"), both.where(~hit).select("sieve_row.*")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (row, file, line) less those of gone (file, line): `row`'s columns. Only rows that the bitmap does not clear are shuffled."""
    gone = stage(gone, "gone")
    some, clean = sieved(rows, F.xxhash64("file", "line"), gone.select(F.xxhash64("file", "line")))
    return some.join(gone, ["file", "line"], "left_anti").select("row.*").unionByName(clean.select("row.*"))
