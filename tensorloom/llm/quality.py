"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: two logistic models, one for low quality and one for
toxic text, over its shape and over the log odds of all its words and
five-letter stems, hashed into SLOTS places without a vocabulary (word pairs
found nothing more on held-out rows). They are fitted on a bounded sample of the
labelled rows; there a document's own label is
left out of its words' odds. Evidence of its site: the mean of what all other documents of the
host (source) and of the path (source and lang) look like; documents have no
url, so these columns stand for host and path. A host's mean is shrunk towards
the corpus's, a path's towards its host's, by strengths that the spread of the
means themselves gives (method of moments), so a sparse site counts for little.
A document's own score is left out of its site's means. Both kinds of evidence
add up as log odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.sieve import without
from tensorloom.llm.staging import placed, ship_code, stage

#: Labelled rows that the models are fitted on, at most; those of the smallest hash.
TRAIN_ROWS = 20_000
#: Hashed words of one of them that count, at most.
TRAIN_PLACES = 4096
#: Places of the hashed words and stems.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Documents that a place's odds start from, and the standard errors from the sample's share at which they count in full.
PRIOR, SURE = 4.0, 6.0
STEM = 5
#: Rejected beyond this probability.
CUT = 0.5
EDGES = ".,;:!?|\"'()[]{}<>*#%&$@+=-_~"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "!#$%&*+<=>@^~|\\/{}[]()_"]] = True
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LIMIT = 30.0
#: Words whose hashes a worker remembers, at most (about 15 MB).
REMEMBERED = 1 << 16
_HASHES: dict[str, tuple[int, int]] = {}


def _hashed(words: list[str]) -> np.ndarray:
    """n x 2 hashes, of words without punctuation at their ends and of their stems (0 for short words); a worker remembers those of common words."""
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    out = np.empty((len(words), 2), np.uint64)
    for i, raw in enumerate(words):
        h = _HASHES.get(raw)
        if h is None:
            w = raw.strip(EDGES)
            h = tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) if x else 0 for x in (w, f"^{w[:STEM]}" if len(w) > STEM else ""))
            if len(raw) < 64 and len(_HASHES) <= REMEMBERED:
                _HASHES[raw] = h
        out[i] = h
    return out


def shape(text: str) -> tuple[list[float], np.ndarray]:
    """Numbers that describe the text, and the places of its distinct words and stems, rising."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.lower().split()
    n = len(words)
    solid = max(1, int(raw[33:].sum()))
    letters = max(1, int(raw[LETTERS].sum()))
    twice = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    rich = math.log1p(len(set(words))) / math.log1p(n) if n else 1.0
    symbols = int(raw[SYMBOLS].sum())
    numbers = [
        symbols / solid,
        math.log1p(100.0 * symbols / solid),
        raw[65:91].sum() / letters,
        raw[ord("|")] / max(1, n),
        raw[48:58].sum() / solid,
        1.0 - rich,
        twice / max(1, n),
        math.log1p(n),
        min(20.0, solid / max(1, n)),
        raw[10] / max(1, n),
        float(n < 8),
        letters / solid,
    ]
    one, stems = _hashed(words).T
    return [float(x) for x in numbers], np.unique(np.concatenate([one, stems[stems > 0]]) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def odds(n: np.ndarray, k: np.ndarray, rate: float) -> np.ndarray:
    """What a word adds to the log odds of a class that `rate` of the sample has: k of its n documents have it. Nearer than SURE standard errors it counts for less."""
    z = np.abs(k - n * rate) / np.sqrt(n * rate * (1 - rate) + 1)
    return np.minimum(1, z / SURE) * (np.log((k + PRIOR * rate) / (n - k + PRIOR * (1 - rate))) - math.log(rate / (1 - rate)))


def evidence(own: np.ndarray) -> list[float]:
    """The three highest odds of a document's words, their sum over the root of their number, and how many exceed 1."""
    top = np.sort(own)[-3:] if len(own) < 3 else np.sort(np.partition(own, len(own) - 3)[-3:])
    return [*[0.0] * (3 - len(top)), *top.tolist(), float(own.sum()) / math.sqrt(max(1, len(own))), float((own > 1).sum())]


@dataclass(frozen=True)
class Model:
    """odds: 2 x SLOTS, of low quality and of toxic; mean, scale: of the features; weights: 2 rows, a constant first. None before fitting."""

    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """n x 2 log odds: low quality, toxic."""
        if not len(self.weights) or not texts:
            return np.full((len(texts), 2), -LIMIT)
        rows = []
        for t in texts:
            numbers, places = shape(t)
            rows.append([*numbers, *evidence(self.odds[0][places]), *evidence(self.odds[1][places])])
        x = (np.array(rows) - self.mean) / self.scale
        return np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights.T, -LIMIT, LIMIT)


NOTHING = Model(np.zeros((2, 0), np.float32), np.zeros(0), np.ones(0), np.zeros((0, 0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the constant first) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -LIMIT, LIMIT)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(numbers: np.ndarray, places: list[np.ndarray], labels: np.ndarray) -> Model:
    """numbers: n rows; places: of each row; labels: n x 2, of low quality and of toxic."""
    total = len(labels)

    def counted(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(SLOTS, np.int32)
        for lo in range(0, len(rows), 1000):
            out += np.bincount(np.concatenate([places[i] for i in rows[lo : lo + 1000]]), minlength=SLOTS).astype(np.int32)
        return out

    n = counted(np.arange(total))
    all_odds, features = [], [numbers]
    for y in labels.T.astype(np.int32):
        k = counted(np.flatnonzero(y))
        rate = (y.sum() + 0.5) / (total + 1)
        features.append(np.array([evidence(odds(n[p] - 1, k[p] - own, rate)) for p, own in zip(places, y, strict=True)]))
        all_odds.append(odds(n.astype(np.float32), k.astype(np.float32), rate).astype(np.float32))
    x = np.column_stack(features)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = (x - mean) / scale
    return Model(np.array(all_odds), mean, scale, np.array([logistic(x, y) for y in labels.T.astype(float)]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, train_places: int = TRAIN_PLACES) -> Model:
    """docs with labels (doc_id, quality, toxic). The driver gets the features of at most train_rows documents, train_places hashed words of each.

    A document labelled more than once counts as low quality or toxic if any of
    its labels says so; null labels say nothing, and without either kind a
    document is not used. Of repeated rows of a labelled id the one with the
    smallest hash of its text is used. Longer texts give the train_places lowest
    places; scoring reads whole texts.
    """
    ship_code(docs.sparkSession)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max((F.col("quality") == 0).cast("int")).alias("low"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).dropna()
    known = known.orderBy(F.xxhash64("of"), "of").limit(train_rows)
    sample = docs.select(F.col(id_col).cast("long").alias("of"), F.col(text_col).alias("text")).join(F.broadcast(known), "of").withColumn("h", F.xxhash64("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shape(t if isinstance(t, str) else "") for t in b["text"]]
            yield pd.DataFrame({"of": b["of"], "h": b["h"], "x": [x for x, _ in got], "places": [p[:train_places].tobytes() for _, p in got], "low": b["low"], "toxic": b["toxic"]})

    data = sample.mapInPandas(rows, "of long, h long, x array<double>, places binary, low int, toxic int")
    data = data.groupBy("of").agg(F.min_by(F.struct("x", "places", "low", "toxic"), "h").alias("row")).select("of", "row.*").toArrow()  # train_rows rows at most, read where they lie
    labels = np.column_stack([data["low"].to_numpy(), data["toxic"].to_numpy()]).astype("int64").reshape(-1, 2)
    if not labels.sum():
        return NOTHING
    every = [np.frombuffer(p.as_buffer(), np.int32) for p in data["places"]]
    order = np.lexsort(([len(p) for p in every], data["of"].to_numpy()))
    numbers = np.array(data["x"].to_pylist())
    return fitted(numbers[order], [every[i] for i in order], labels[order])


def _scorer(spark: SparkSession, model: Model):
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("low double, toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        got = held.value.scores([t if isinstance(t, str) else "" for t in texts])
        return pd.DataFrame({"low": got[:, 0], "toxic": got[:, 1]})

    return score


def _bad(score: Column) -> Column:
    """Probability that a document is of low quality or toxic."""

    def p(x: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))

    return F.lit(1.0) - (F.lit(1.0) - p(score["low"])) * (F.lit(1.0) - p(score["toxic"]))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(q / (F.lit(1.0) - q))


def _strength(groups: DataFrame, centre: str) -> float:
    """Prior rows of a group: variance inside over variance between, from (n, s, ss) of the groups and what they centre on."""
    got = groups.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("inside"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(centre), F.lit(2))).alias("outside"),
    ).first()
    n, k = got["n"] or 0, got["k"]
    if n <= k or k < 2:
        return 1e6
    inside = max(1e-12, got["inside"] / (n - k))
    between = (got["outside"] - (k - 1) * inside) / max(1e-12, n - got["nn"] / n)
    return min(1e6, inside / between) if between > 0 else 1e6


def site_sums(soft: DataFrame) -> tuple[DataFrame, float, float, float]:
    """soft (host, path, p): (of_host, of_path, n, s, host_n, host_s) of every path, the corpus's mean and the strengths of hosts and paths.

    Only sums come together; no group's rows do. The mean and the two strengths
    are all that reaches the driver.
    """
    paths = stage(soft.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")), "site-paths")
    hosts = stage(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]), "site-hosts")
    got = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = min(1 - 1e-6, max(1e-6, (got[0] or 0.0) / max(1, got[1] or 0)))
    host_k = _strength(hosts.withColumn("centre", F.lit(mean)), "centre")
    hosts = hosts.select(F.col("host").alias("of"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = stage(paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "site-both")
    path_k = _strength(both.withColumn("centre", (F.col("host_s") + F.lit(host_k * mean)) / (F.col("host_n") + F.lit(host_k))), "centre")
    return both.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n", "s", "host_n", "host_s"), mean, host_k, path_k


def _judged(scored: DataFrame) -> DataFrame:
    """scored (host, path, score, p, ...): adds prior, p_bad and keep.

    prior: what the other documents of the path say, shrunk towards the host's,
    that towards the corpus's mean. The log odds of the document and of its
    prior, less those of the mean, add up.
    """
    sums, mean, host_k, path_k = site_sums(scored)
    both = scored.join(sums, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    centre = (F.col("host_s") - F.col("p") + F.lit(host_k * mean)) / (F.col("host_n") - 1 + F.lit(host_k))
    prior = (F.col("s") - F.col("p") + F.lit(path_k) * centre) / (F.col("n") - 1 + F.lit(path_k))
    prior = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior))
    both = both.withColumn("prior", prior)
    x = _logit(F.col("p")) + _logit(F.col("prior")) - F.lit(math.log(mean / (1 - mean)))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return both.withColumn("p_bad", p).withColumn("keep", F.col("p_bad") <= F.lit(CUT))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, p_low, p_toxic, site_prior, p_bad, keep.

    Null and empty texts have no words; very long ones count whole; null hosts
    and paths are sites of their own; repeated rows are judged alike; labels
    without a document count for nothing, contradicting ones as fit() says;
    without labels of both kinds nothing is rejected; extra columns, whatever
    their names, are not read; no rows give no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), _scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))
    scored = stage(scored.withColumn("p", _bad(F.col("score"))), "scores")

    def p(name: str) -> Column:
        return (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")[name]))).alias(f"p_{name}")

    return _judged(scored).select("doc_id", p("low"), p("toxic"), F.col("prior").alias("site_prior"), "p_bad", "keep")


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, all their columns; classify() says how nulls, repeats and empty tables count.

    Texts are scored once: what is rejected is named by file and row, and only
    rows near it are shuffled.
    """
    model = fit(docs, labels, id_col, text_col)
    base = placed(docs)
    row = F.col("row")
    scored = base.select("file", "line", row[host_col].alias("host"), row[path_col].alias("path"), _scorer(docs.sparkSession, model)(row[text_col]).alias("score"))
    scored = stage(scored.withColumn("p", _bad(F.col("score"))), "scores")
    return without(base, _judged(scored).where("not keep").select("file", "line"))
