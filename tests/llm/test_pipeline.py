"""The pipeline's stages against plain Python, and on awkward rows."""

import math
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tests.llm.test_near_copies import brute_kept, shingles
from tests.llm.test_operators import SCHEMA, WORD, brute_lines, brute_posterior, key, messy_rows, pieces_of

from tensorloom.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def brute_quality(spark, docs):
    """Ids that stay: scores of the fitted model, then the whole posterior formula in plain Python."""
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.select("doc_id", "text", "source", "lang").collect()

    def p(x):
        return 1 / (1 + math.exp(-x))

    bad = [1 - (1 - p(a)) * (1 - p(b)) for a, b in model.scores([r.text or "" for r in rows]).tolist()]
    judged = brute_posterior([(r.source, r.lang, x) for r, x in zip(rows, bad, strict=True)])
    return {r.doc_id for r, (_, x) in zip(rows, judged, strict=True) if x <= 0.5}


def brute_copies(spark, rows):
    """rows (doc_id, text, source): how often each id is taken, from targets by water-filling and the seeded draw."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = 1e18
    for _ in range(200):
        full = {s for s in order if 2 * size[s] <= level * weight[s]} if level < 1e18 else set()
        open_ = sum(weight[s] for s in order if s not in full)
        if not open_:
            break
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / open_
    rate = {s: min(2 * size[s], level * weight[s]) / size[s] if size[s] else 0.0 for s in order}
    ids = spark.createDataFrame([(i,) for i, _, _ in rows], "i long").select("i", F.xxhash64(F.lit(mixing.SEED), "i").alias("h")).collect()
    draw = {r.i: ((r.h & (2**64 - 1)) >> 11) * 2.0**-53 for r in ids}
    return {i: int(rate[s]) + (draw[i] < rate[s] - int(rate[s])) for i, _, s in rows}


def test_stages_and_run_on_documents(spark, tmp_path):
    """Every stage against brute force on what the one before it kept; run() gives the pieces of the chain of brute-force stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    kept = written(spark, stages["quality"](spark, docs, SF), tmp_path / "a")
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == brute_quality(spark, docs)
    lines = written(spark, stages["lines"](spark, kept, SF), tmp_path / "b")
    want = Counter((i, t) for (i, _, _, t) in brute_lines([(r.doc_id, r.text) for r in kept.collect()]).elements())
    assert lines.columns == columns and Counter((r.doc_id, r.text) for r in lines.collect()) == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = written(spark, stages["near_copies"](spark, lines, SF), tmp_path / "c")
    assert {r.doc_id for r in near.collect()} == brute_kept([(r.doc_id, r.text) for r in lines.collect()]) and near.columns == columns
    mixed = written(spark, stages["mix"](spark, near, SF), tmp_path / "d")
    times = brute_copies(spark, [(r.doc_id, r.text, r.source) for r in near.collect()])
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})
    pieces = pieces_of((r.doc_id, r.text) for r in mixed.collect())
    packed = P.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    seqs = defaultdict(list)
    for r in packed:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 4096


def test_stages():
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_copies", "mix", "pack"]


@pytest.mark.parametrize("rows", [messy_rows(), []])
def test_awkward_rows(spark, tmp_path, rows):
    docs = written(spark, spark.createDataFrame(rows, SCHEMA), tmp_path / "in")
    for i, (name, step) in enumerate(P.STAGES):
        out = written(spark, step(spark, docs, SF), tmp_path / name)
        if i < 4:
            assert out.columns == docs.columns
        if name == "near_copies":
            sets = Counter(frozenset(shingles(r.text)) for r in out.collect())
            assert all(n == 1 for n in sets.values())
            assert {frozenset(shingles(r.text)) for r in docs.collect()} >= set(sets)
        docs = out
    assert docs.count() >= (1 if rows else 0)
    assert not rows or all(key(r.length) > 0 for r in docs.collect())
