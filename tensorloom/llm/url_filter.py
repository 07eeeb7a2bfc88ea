"""URL rules by a Bloom filter cascade.

Level 1 encodes the listed keys. All keys of the corpus that pass level 1 but
are not listed are encoded by level 2, the listed keys that pass level 2 by
level 3, and so on until nothing passes wrongly. A key of the corpus is listed
exactly when the first level that it does not pass has an even number. The
cascade's size follows the listed keys, not the corpus, and is the only thing
that is broadcast: rows are judged where they lie, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.staging import ship_code, stage

#: The contract's rules: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    from tensorloom.llm.line_dedup import ascii_lower

    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


class Bloom:
    """Bits in numpy; a key is its two 64-bit hashes. Each level has its own salt, so levels err independently."""

    def __init__(self, n: int, rate: float, salt: int):
        self.salt = np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        self.bits = max(64, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(-math.log2(rate)))
        self.words = np.zeros(-(-self.bits // 8), np.uint8)

    def _places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        x = (a.astype(np.uint64) ^ self.salt) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        y = (b.astype(np.uint64) + self.salt) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        y ^= (y >> np.uint64(29)) << np.uint64(1)
        for i in range(self.hashes):
            h = x + np.uint64(i) * y
            yield (h ^ (h >> np.uint64(33))) % np.uint64(self.bits)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for p in self._places(a, b):
            np.bitwise_or.at(self.words, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8), dtype=np.uint8))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for p in self._places(a, b):
            found &= (self.words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For keys of the universe: whether they are listed."""
        out = np.zeros(len(a), bool)
        open_ = np.arange(len(a))
        for i, level in enumerate(self.levels):
            passed = level.has(a[open_], b[open_])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _passing(levels: list[Bloom]):
    """Rows (a, b) that pass every level; the levels are small (see build_cascade)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = np.ones(len(x), bool)
            for level in levels:
                found &= level.has(x["a"].to_numpy("int64"), x["b"].to_numpy("int64"))
            yield x[found]

    return run


def build_cascade(listed: np.ndarray, universe: DataFrame) -> Cascade:
    """listed: n x 2 hashes of the rule keys; universe: distinct (a, b), listed keys among them or not.

    Level 1 errs at listed / universe * sqrt(1/2), so about as many false keys
    come back as there are rules; all later levels err at 1/2 and halve what is
    left. What reaches the driver is of the order of the rule list.
    """
    known = {(int(x), int(y)) for x, y in listed}
    total = max(1, universe.count())
    listed = np.array(sorted(known), np.int64).reshape(-1, 2)
    levels = [Bloom(len(listed), min(0.5, len(listed) / total * math.sqrt(0.5) or 0.5), 1)]
    levels[0].add(listed[:, 0], listed[:, 1])
    rows = universe.mapInPandas(_passing(levels), "a long, b long").toPandas() if len(listed) else pd.DataFrame({"a": [], "b": []})
    wrong = np.array([x for x in rows.itertuples(index=False, name=None) if x not in known], np.int64).reshape(-1, 2)
    right = listed
    while len(wrong):
        level = Bloom(len(wrong), 0.5, len(levels) + 1)
        level.add(wrong[:, 0], wrong[:, 1])
        levels.append(level)
        left = level.has(right[:, 0], right[:, 1])
        wrong, right = right[left], wrong
    return Cascade(levels)


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    k = _key(host, path)
    return F.xxhash64(k), F.xxhash64(F.lit("url"), k)


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (host, path): the host's suffixes and the path's prefixes by which a rule can fit.

    labels, lengths: the numbers of host labels and of path code points that the
    rules have; no other suffix or prefix can be listed.
    """
    parts = F.split(host, r"\.", -1)
    counts = F.filter(F.array(*[F.lit(x) for x in labels]), lambda n: n <= F.size(parts))
    suffixes = F.transform(counts, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    sizes = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(sizes, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda q: F.struct(s.alias("host"), q.alias("path")))))


def filter_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains where the
    url's path starts with the rule's; the longest host + path wins, of equals
    the longest host. A url without a fitting rule, a null url and one without
    `://` get the default. Repeated rows are judged alike; extra columns are not
    read; no rows give no rows. The rule list must fit the driver; the corpus's
    keys never come there.
    """
    spark = pages.sparkSession
    ship_code(spark)
    lengths = sorted({len(p) for _, p, _ in rules})
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not rules:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    own = F.transform(candidate_keys(F.col("host"), F.col("path"), labels, lengths), lambda k: F.struct(k["host"].alias("host"), k["path"].alias("path"), _hashes(k["host"], k["path"])[0].alias("a"), _hashes(k["host"], k["path"])[1].alias("b")))
    base = stage(base.withColumn("own", own), "url-keys")
    universe = stage(base.select(F.explode("own").alias("k")).select("k.a", "k.b").distinct(), "url-universe")
    listed = spark.createDataFrame([(h, p) for h, p, _ in rules], "host string, path string").select(*_hashes(F.col("host"), F.col("path"))).collect()
    listed = np.array([tuple(x) for x in listed], np.int64).reshape(-1, 2)
    cascade = spark.sparkContext.broadcast(build_cascade(listed, universe))
    verdicts = {h + p: v for h, p, v in rules}

    @F.pandas_udf("rule string, verdict string")
    def judge(own: pd.Series) -> pd.DataFrame:
        n = own.map(len).to_numpy("int64")
        flat = [k for row in own for k in row]
        found = cascade.value.has(np.array([k["a"] for k in flat], np.int64), np.array([k["b"] for k in flat], np.int64))
        row = np.repeat(np.arange(len(own)), n)
        best: dict[int, tuple[int, int, str]] = {}
        for i in np.nonzero(found)[0]:
            k = flat[i]
            mine = (len(k["host"]) + len(k["path"]), len(k["host"]), k["host"] + k["path"])
            best[row[i]] = max(best.get(row[i], mine), mine)
        rule = [best[r][2] if r in best else None for r in range(len(own))]
        return pd.DataFrame({"rule": rule, "verdict": [default if r is None else verdicts[r] for r in rule]})

    return base.withColumn("j", judge("own")).select("page_id", "host", "path", "j.rule", "j.verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, v,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS n
  FROM p LEFT JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1"""
