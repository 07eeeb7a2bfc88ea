"""Target-distribution importance resampling in plain Spark SQL functions.

Features (runs of 1 to `longest` words) are exploded and hashed by crc32 into a
fixed number of buckets. Bucket counts of the corpus and of the target give a
gain table of at most `buckets` rows, which is broadcast; a document's weight is
the sum of its features' gains. A seeded Gumbel term turns weights into scores,
and the highest scores are drawn: one distributed sort, each partition's rows
ranked by their place in it plus the rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: monotonically_increasing_id: the partition above these bits, the place in it below.
PLACE_BITS = 33


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), lambda w: w != "")


def _runs(own: Column, longest: int) -> Column:
    """Runs of 1 to longest words; those of n words are those of n - 1, each with one more word, whole arrays at a time."""
    every = [own]
    for n in range(2, longest + 1):
        left = F.greatest(F.size(own) - (n - 1), F.lit(0))
        every.append(F.zip_with(F.slice(every[-1], 1, left), F.slice(own, n, left), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.flatten(F.array(*every))


def features(text: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to longest consecutive words, joined by one space, repeats included."""
    if longest == 1:
        return words(text)
    # an array of one element binds the words to a variable: they are split once
    return F.flatten(F.transform(F.array(words(text)), lambda own: _runs(own, longest)))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that has any; summed before the shuffle, so at most `buckets` rows a task move."""
    return texts.select(F.explode(features(F.col(text_col), longest)).alias("f")).groupBy(bucket(F.col("f"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln of the smoothed ratio of target to corpus frequency). Exactly `buckets` rows."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(bucket_counts(docs, text_col, longest, buckets).withColumnRenamed("n", "s"), "bucket", "left")
    counts = counts.join(bucket_counts(target, text_col, longest, buckets).withColumnRenamed("n", "t"), "bucket", "left")
    counts = stage(counts.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "bucket-counts")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel draw) of the seed and the id; a null id is drawn like an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1, 2, ... of the drawn ones; null for the others), all long.

    Drawn are floor(percent * N / 100) of the N documents of at least least_words
    words, those of the highest scores; ties go to the smaller id, a null id comes
    last, repeated rows are drawn one by one. Null and empty texts have no features
    and weight 0. Very long texts are read whole. Without target texts all target
    counts are 0; no documents give no rows. Extra columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    if longest > 1:  # before the features are exploded, or the words would be counted once a feature
        base = base.withColumn("n_words", F.size(words(F.col("text"))).cast("long"))
    rows = base.select(*[c for c in base.columns if c != "text"], F.explode_outer(features(F.col("text"), longest)).alias("f"))
    rows = rows.withColumn("bucket", bucket(F.col("f"), buckets))
    table = F.broadcast(stage(gains(base, target.select(F.col(text_col).alias("text")), "text", longest, buckets), "gains"))
    n_words = F.count("f") if longest == 1 else F.max("n_words")
    scored = rows.join(table, "bucket", "left").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count("f").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"), (n_words >= least_words).alias("fit"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    ordered = scored.orderBy(F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), "row").withColumn("at", F.monotonically_increasing_id())
    ordered = stage(ordered, "resample-sorted")
    part, place = F.shiftright("at", PLACE_BITS), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fit").cast("long")).alias("n_fit"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a partition
    offsets = sizes.select("part", (F.sum("n").over(so_far) - F.col("n")).alias("before"), F.expr(f"{percent} * sum(n_fit) over () div 100").alias("quota"))
    rank = F.col("before") + place + 1
    out = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= F.col("quota")), rank).cast("long").alias("rank"))


#: crc32 by its table, made from the reversed polynomial, over the bytes of each distinct feature.
SQL = rf"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
df AS (SELECT doc_id, unnest(w) AS f FROM d),
v AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM b)),
y AS (SELECT f, list_transform(range(0, len(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS bytes FROM v),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (f) GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM df) AS all_s, (SELECT count(*) FROM b) AS all_t),
g AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (all_s + {BUCKETS}) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (all_t + {BUCKETS})))) AS gain FROM s FULL JOIN t USING (bucket), a),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, len(w) AS n_features, list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('{SEED}:' || doc_id)[i]) - 1)), lambda p, q: p * 16 + q) AS h FROM d),
c AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)"""
