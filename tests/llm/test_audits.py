"""Jaccard join, divergence audit and resampling against brute force, on awkward rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.test_near_copies import edited_rows
from tests.llm.test_operators import SCHEMA, SF, WORD, messy_rows

from tensorloom.llm import divergence, jaccard_join, resampling


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def tables(spark):
    rows = messy_rows()
    return {"documents": spark.read.parquet(f"{SF}/documents.parquet"), "messy": spark.createDataFrame(rows, SCHEMA), "empty": spark.createDataFrame([], SCHEMA)}


# --- 11 --------------------------------------------------------------------------------------


def shingles(text, width):
    words = WORD.findall(low(text))
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_classes(rows, width=3, similar=(9, 10)):
    """(id, set size, smallest id of its component) of (id, text), sorted."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and similar[1] * both >= similar[0] * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for (i, _), c in zip(rows, label, strict=True):
        least[c].append(math.inf if i is None else i)
    return sorted(((i is None, i or 0), len(s), None if min(least[c]) == math.inf else min(least[c])) for (i, _), s, c in zip(rows, sets, label, strict=True))


def found_classes(frame):
    out = frame.collect()
    assert len({(r.file, r.line) for r in out}) == len(out)
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in out), out


@pytest.mark.parametrize("table", ["documents", "messy"])
def test_classes(tables, table):
    rows = [(r.doc_id, r.text) for r in tables[table].collect()]
    got, out = found_classes(jaccard_join.similar_classes(tables[table]))
    assert [str(x) for x in got] == [str(x) for x in brute_classes(rows)]
    kept = Counter(r.component_id for r in out if r.kept and r.n_shingles)
    assert set(kept.values()) <= {1} and set(kept) == {c for _, n, c in got if n}


def test_no_rows(tables):
    assert jaccard_join.similar_classes(tables["empty"]).count() == 0


@pytest.mark.parametrize(("width", "similar", "block", "worth"), [(3, (9, 10), 1 << 14, 8), (5, (4, 5), 4, 8), (3, (9, 10), 3, 0), (2, (3, 4), 5, 10**6), (1, (1, 2), 9, 8)])
def test_edits(spark, monkeypatch, width, similar, block, worth):
    """Groups of edited copies, with columns split into row blocks and units asked once or until none links."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FEW", min(block, 8) - 1)
    monkeypatch.setattr(jaccard_join, "WORTH", worth)
    rows = edited_rows(12, 10) + [(10_000 + i, t) for i, t in enumerate(["a b", "A  b", "a b c", "a b c d e f g h i j k", "a b c d e f g h i j k l", " ", None])]
    got, _ = found_classes(jaccard_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), width=width, similar=similar))
    assert got == brute_classes(rows, width, similar)


def test_star_of_near_copies(spark):
    """Copies with one edit each are near the original, not near each other: one class, by way of the original."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(9999)}" for _ in range(58)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        text = list(base)
        text[rng.randrange(1, 57)] = f"edit{i}"
        rows.append((i, " ".join(text)))
    got, _ = found_classes(jaccard_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_classes(rows)


def test_overlaps():
    rng = np.random.default_rng(0)
    for n, share in ((5, 4), (9000, 8000), (20_000, 9000)):
        pool = np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[n - share : 2 * n - share])
        for need in (0, share - 1, share, share + 1):
            assert jaccard_join.reaches(a, b, need) == (len(np.intersect1d(a, b)) >= need)


def test_parity_bits_bound():
    rng = np.random.default_rng(1)
    for n, m, share in ((50, 50, 45), (3000, 4200, 2900), (9000, 9000, 8000)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.int64).astype(np.uint64)
        p, q = (np.frombuffer(jaccard_join.parity(x), np.uint64) for x in (pool[:n], pool[n - share : n - share + m]))
        w = min(len(p), len(q))
        apart = int(np.bitwise_count(jaccard_join.folded(p, w) ^ jaccard_join.folded(q, w)).sum())
        assert apart <= n + m - 2 * share


# --- 12 --------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least=10, top=10):
    docs, count, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        got = TERM.findall(low(text))
        docs.update({(lang, x) for x in got})
        count.update((lang, source, x) for x in got)
    out = []
    for lang, sources in groups.items():
        kept = [x for (a, x), n in docs.items() if a == lang and n >= least]
        v = len(kept)

        def shares(n):
            total = sum(n.values())
            return {x: 1 + 10**9 * (n[x] + 2) // (total + 2 * v) for x in kept}

        n = {s: {x: count[lang, s, x] for x in kept} for s in sources}
        p = {s: shares(n[s]) for s in sources}
        q = shares({x: sum(n[s][x] for s in sources) for x in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][x], p[o][x]) for x in kept), o.encode()) for o in sources - {s}]
            term = [(-f(p[s][x], q[x]), x.encode()) for x in kept if n[s][x] and p[s][x] > q[x]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, i.decode(), -value, k + 1) for k, (value, i) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize(("table", "least", "entries"), [("documents", 10, 1 << 18), ("messy", 2, 4), ("messy", 10, 1 << 18), ("empty", 1, 9)])
def test_audit(tables, monkeypatch, table, least, entries):
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(divergence, "PAIR_ENTRIES", max(entries, 50))
    rows = [(r.text, r.lang, r.source) for r in tables[table].collect()]
    got = divergence.audit(tables[table], least_docs=least)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_audit_runs_across_batches(spark, monkeypatch):
    """Runs longer than an Arrow batch, many blocks of a term, equal values ranked by item."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["alpha", "Beta", "ümlaut", "x9y", "ß"], k=rng.randrange(6))), rng.choice(["en", "de", None]), f"s{rng.randrange(30)}") for _ in range(400)]
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=3).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == brute_audit(rows, 3)


# --- 13 --------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(rows, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    """(id, n_features, weight, score, rank) of (id, text), without rank the ids that may be drawn in order."""

    def features(text):
        w = TOKEN.findall(low(text))
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    own = [features(t) for _, t in rows]
    place = lambda x: zlib.crc32(x.encode()) % buckets
    s = Counter(place(x) for f, _ in own for x in f)
    t = Counter(place(x) for text in target for x in features(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, _), (f, n) in zip(rows, own, strict=True):
        weight = sum(gain[place(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return sorted((str(x[:5]) for x in out))


@pytest.mark.parametrize(("table", "target", "options"), [("documents", None, {}), ("documents", [], {"longest": 3, "percent": 35}), ("messy", None, {"least": 1, "percent": 60}), ("messy", [None, ""], {"longest": 2, "buckets": 7, "seed": 1, "least": 0, "percent": 100}), ("empty", None, {})])
def test_resampling(spark, tables, table, target, options):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    if target is not None:
        bench = spark.createDataFrame([(x,) for x in target], "text string")
    rows = [(r.doc_id, r.text) for r in tables[table].collect()]
    names = {"least": "least_words"}
    got = resampling.resample(tables[table], bench, **{names.get(k, k): v for k, v in options.items()})
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(str(list(r)) for r in got.collect()) == brute_resample(rows, [r.text for r in bench.collect()], **options)


def test_equal_scores_go_by_id(spark):
    """Repeated rows have equal scores; ranks are dense all the same, over several partitions."""
    rows = [(i // 3, "same words here") for i in range(300)]
    out = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([("same",)], "text string"), least_words=1, percent=50).collect()
    drawn = sorted((r.rank, -r.score, r.doc_id) for r in out if r.rank is not None)
    assert [r for r, _, _ in drawn] == list(range(1, 151))
    assert [x[1:] for x in drawn] == sorted(x[1:] for x in drawn)
