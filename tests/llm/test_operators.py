"""Each operator against brute force, on whole small tables and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.oracle import assert_same, connect

from tensorloom.llm import catalogue, chat, components, config_packing, exact_dedup, line_dedup, media, mixing, quality, sieve, simhash, token_output, tokens, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, gone string, mark double, rate string, digest string, kept string, of string, file string, line long, _metadata string"
LONG = "This line is long enough to count and many documents share it, word for word."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def messy_rows():
    rng = random.Random(5)
    base = [f"some words {i} about nothing much\n{LONG}\nend {i}" for i in range(6)]
    texts = [None, "", " \t\n ", "A  b\tc", "a b c", *base, base[0], "word " * 60_000 + "tail", LONG.upper() + "\n\n x", "ünïcode ſtraße Σς 中文 \U0001f600", "\x1c\xa0 odd\x85space", "<|endoftext|> x"]
    out = []
    for i, t in enumerate(texts):
        out.append((None if i == 2 else i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None if i % 3 == 0 else len(t or "")) + tuple(rng.choice([None, 7, 1]) if c in (6, 8, 14) else "x" for c in range(5, 16)))
    out.append(out[8])
    out.append((None, None, None, None, None) + (None,) * 11)
    return [tuple(float(v) if c == 8 and v is not None else v for c, v in enumerate(r)) for r in out]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_equal_sql(spark, name):
    assert_same(catalogue.queries()[name](spark, SF).toPandas(), connect(SF).execute(catalogue.oracle_sql()[name]).fetchdf())


def key(v):
    return -1 if v is None or v != v else int(v)


# tokens ---------------------------------------------------------------------------------------


def test_tokenizer_equals_library(monkeypatch, docs):
    monkeypatch.setattr(tokens, "BLOCK", 3000)
    monkeypatch.setattr(tokens, "MEMO", 3000)
    t = tokens.WordTokenizer(tokens.vocabulary())
    rng = random.Random(1)
    texts = [r.text or "" for r in docs.select("text").collect()][:120] + [r[1] or "" for r in messy_rows()]
    texts += ["".join(rng.choice("abcdst're'lléßÄ0123456789 !?-_|#%&\n²ªİΣ中̈") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    ids, n = t.encode(texts)
    at = 0
    for text, k in zip(texts, n, strict=True):
        assert ids[at : at + k].tolist() == t.library.encode(text, add_special_tokens=False).ids
        at += k


def pieces_of(rows, seq_len=4096):
    t = tokens.WordTokenizer(tokens.vocabulary()).library
    out = Counter()
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), seq_len)):
            part = np.array(ids[s : s + seq_len], "<u4")
            out[key(doc), p, s, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (1, 7, 500):
        lengths = rng.integers(1, 101, n)
        bins = token_output.best_fit_decreasing(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(lengths[b].sum() <= 100 for b in bins)
        rooms, count = [], 0
        for x in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                count += 1
                rooms.append(100 - x)
        assert len(bins) == count


@pytest.mark.parametrize("table", ["docs", "messy", "empty"])
def test_token_matrices(request, table):
    df = request.getfixturevalue(table)
    rows = token_output.packed_matrices(df).collect()
    got = Counter()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(pos) == 4096 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 0).all()
        assert r.ids_crc32 == zlib.crc32(ids[: r.n_tokens].tobytes())
        for a, b, d, p, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, r.starts, strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            got[key(d), p, s, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert got == pieces_of((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("table", ["docs", "messy", "empty"])
def test_config_packing(request, table):
    df = request.getfixturevalue(table)
    rows = config_packing.pack(df).collect()
    assert Counter((key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    if rows:
        assert {r.least_sequences for r in rows} == {rows[0].least_sequences} and rows[0].least_sequences <= len(seqs)
        assert len(seqs) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 2


def brute_knapsack(lengths, counts, prices, capacity):
    return max(
        sum(p * k for p, k in zip(prices, own, strict=True))
        for own in itertools.product(*[range(min(n, capacity // x) + 1) for x, n in zip(lengths, counts, strict=True)])
        if sum(x * k for x, k in zip(lengths, own, strict=True)) <= capacity
    )


def test_knapsack():
    rng = np.random.default_rng(7)
    for _ in range(40):
        lengths = np.unique(rng.integers(2, 13, 5))
        counts, prices = rng.integers(1, 5, len(lengths)), rng.random(len(lengths))
        sack = config_packing.Knapsack(lengths, counts, prices, 20)
        assert sack.best == pytest.approx(brute_knapsack(lengths.tolist(), counts.tolist(), prices.tolist(), 20))
        free = [10.0] * len(lengths), [0.0] * len(lengths)
        for head in range(len(lengths)):
            config, value = sack.about(head, *free)
            assert value == pytest.approx(sack.value[head]) and max(config) == head
            assert sum(lengths[i] * k for i, k in config.items()) <= 20 and all(k <= counts[i] for i, k in config.items())
        assert max(sack.value) == pytest.approx(sack.best)


NINE = (1780, 1044, 1272, 1258, 1303, 1535, 1631, 1359, 1106)


@pytest.mark.parametrize("counts", [{x: 300 for x in NINE}, {x - 2: 300 for x in NINE}, {2056: 600, 1043: 600, 1033: 600, 1003: 1200}])
def test_program_beats_best_fit(counts):
    """Best fit needs 1,050 or 1,100 sequences; 900 are possible, and that is the bound."""
    p = config_packing.plan(counts, 4096)
    assert (p.sequences, p.by_program, p.bound) == (900, 900, 900)
    assert sum(n for n, _ in config_packing.best_fit_classes(counts, 4096)) >= 1050


@pytest.mark.parametrize("lengths", [5, 10, 20])
def test_program_converges(lengths):
    """Random histograms: nearly all sequences by the program, and within 1 % of its bound."""
    rng = np.random.default_rng(lengths)
    names = rng.choice(np.arange(300, 2500), lengths, replace=False)
    p = config_packing.plan({int(x): int(n) for x, n in zip(names, rng.integers(100, 3000, lengths), strict=True)}, 4096)
    assert p.by_program >= 0.9 * p.sequences and p.bound <= p.sequences <= 1.01 * p.bound


def test_played_game():
    """Two lengths that fit together one by one: half the copies of what each alone would need."""
    cover = np.array([[0.1, 0.0, 0.1], [0.0, 0.1, 0.1]])
    _, shares, copies, least, _ = config_packing.played(cover, np.zeros(2), np.zeros(3), 0.001, 40_000)
    assert 10 <= copies <= 10.02 and 9.98 <= least <= 10 + 1e-9 and shares[2] > 0.98


def test_configuration_program():
    rng = np.random.default_rng(3)
    counts = dict(Counter(np.minimum(4096, np.maximum(1, rng.lognormal(6.3, 1, 5_000).astype(int))).tolist()))
    shares, bound, _ = config_packing.fractional(counts, 4096)
    used = Counter()
    for config, x in shares.items():
        assert sum(a * k for a, k in config) <= 4096
        for a, k in config:
            used[a] += x * k
    assert all(used[a] <= counts[a] + 1e-6 for a in used)
    copies, rest = config_packing.rounded(shares, counts)
    placed = Counter(rest)
    for n, config in copies:
        for a, k in config:
            placed[a] += n * k
    assert placed == Counter(counts)
    p = config_packing.plan(counts, 4096)
    volume = sum(a * k for a, k in counts.items()) / 4096
    assert volume - 1e-6 <= p.bound <= p.sequences <= 1.002 * volume + 2
    assert p.by_program >= 0.95 * p.sequences
    for seed in range(6):
        rng = np.random.default_rng(seed)
        counts = {int(a): int(n) for a, n in zip(rng.integers(600, 2600, 12), rng.integers(1, 400, 12), strict=True)}
        p = config_packing.plan(counts, 4096)
        assert p.bound <= p.sequences <= sum(n for n, _ in config_packing.best_fit_classes(counts, 4096))
    assert config_packing.plan({}, 4096).sequences == 0


# chats ----------------------------------------------------------------------------------------


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "other"),
        (4, 5, "user", "hi"), (4, 6, "assistant", "yo"), (4, 9, "user", "more"),
        (5, 0, None, None), (6, 0, "user", None), (None, 0, "user", "hi"), (None, 1, "user", "alone <|im_end|>"), (7, None, "user", "x"), (7, None, "user", "x"), (8, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    got = {(r.conv_id, r.n_turns, r.n_logs) for r in chat.format_chats(df).collect()}
    assert got == {(2, 3, 2), (3, 3, 1), (5, 1, 1), (6, 1, 1), (None, 1, 1), (7, 2, 1)}
    text = {r.text for r in chat.format_chats(df).collect() if r.conv_id is None}
    assert text == {"<|im_start|>user\nalone < |im_end|><|im_end|>\n"}
    assert chat.format_chats(df.where("false")).count() == 0


# near copies ----------------------------------------------------------------------------------


def brute_mark(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, marks):
    m = np.array(marks, np.uint64)
    near = np.bitwise_count(m[:, None] ^ m[None, :]) <= 3
    label = np.array([10**12 if i < 0 else i for i in ids], np.int64)
    while True:
        new = np.where(near, label[None, :], 10**15).min(axis=1)
        if (new == label).all():
            return [-1 if x == 10**12 else int(x) for x in label]
        label = new


@pytest.mark.parametrize("table", ["docs", "messy", "empty"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    rows = [(key(r.doc_id), r.text) for r in df.select("doc_id", "text").collect()]
    marks = [brute_mark(t, 3) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], [f"{m:016x}" for m in marks], brute_components([i for i, _ in rows], marks) if rows else [], strict=True))
    out = simhash.near_duplicates(df).collect()
    assert Counter((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in out) == want
    kept = Counter(key(r.component_id) for r in out if r.kept)
    assert all(n == 1 for n in kept.values()) and len(kept) == len({c for _, _, c in want})


def test_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    rng = random.Random(0)
    for _ in range(20_000):
        x = sum(1 << i for i in rng.sample(range(64), 3))
        assert any(not x & m for m in masks)
    m = masks[4]
    parts = simhash.split_masks(m)
    for _ in range(5_000):
        free = [i for i in range(64) if not m >> i & 1]
        x = sum(1 << i for i in rng.sample(free, 3))
        assert any(not x & p for p in parts)


def test_hot_buckets_are_split(spark, monkeypatch):
    """Thousands of marks about one centre: buckets beyond SMALL are dealt again and no link is lost."""
    monkeypatch.setattr(simhash, "SMALL", 16)
    rng = random.Random(2)
    marks = {0}
    while len(marks) < 600:
        marks.add(rng.choice(sorted(marks)) ^ sum(1 << i for i in rng.sample(range(20), rng.choice((1, 2, 3, 5)))))
    marks |= {1 << 63 | 5, 1 << 63 | 4}
    marks = sorted(marks)
    df = spark.createDataFrame([(simhash.signed(m),) for m in marks], "mark long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.fingerprint_links(df).collect()]
    assert {m for x in links for m in x} <= set(marks)
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_components(list(range(len(marks))), marks)
    assert [marks.index(find(m)) for m in marks] == want


# exact copies and lines -----------------------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "messy", "empty"])
@pytest.mark.parametrize("k", [1, 64])
def test_exact(request, table, k):
    df = request.getfixturevalue(table)
    rows = [(key(r.doc_id), hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in df.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, d in rows:
        groups[d].append(i)
    first = {d: min([i for i in own if i >= 0], default=-1) for d, own in groups.items()}
    out = exact_dedup.exact_dedup(df, k=k).collect()
    assert Counter((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in out) == Counter((i, first[d], len(groups[d]), d) for i, d in rows)
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter(groups.keys())


def test_frequent_candidates(spark):
    rows = [("a",)] * 400 + [("b",)] * 150 + [(f"u{i}",) for i in range(450)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "digest string").repartition(7)
    got = {r.digest for r in exact_dedup.frequent_candidates(df, 9).collect()}
    assert {"a", "b"} <= got and len(got) <= 9


def brute_lines(rows):
    strip, keys = " \t\n\x0b\x0c\r", defaultdict(set)

    def k(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))

    for i, t in rows:
        for line in (t or "").split("\n"):
            if i >= 0 and len(k(line)) >= 40:
                keys[k(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i < 0 or len(keys.get(k(x), ())) < 5 or max(keys[k(x)]) == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("table", ["docs", "messy", "empty"])
@pytest.mark.parametrize("batches", [1, 5])
def test_lines(request, table, batches):
    df = request.getfixturevalue(table)
    out = line_dedup.dedup_lines(df, batches=batches).select("row.doc_id", "n_lines", "n_dropped", "kept_text", "row").collect()
    assert Counter((key(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in out) == brute_lines([(key(r.doc_id), r.text) for r in df.select("doc_id", "text").collect()])
    assert Counter(r.row for r in out) == Counter(df.collect())


def test_lines_shuffle_alike_at_every_size(docs):
    """Texts meet the places of their lost lines by one join, however small these are: shuffles grow in proportion."""
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "gone_from" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


# mixing ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "messy", "empty"])
def test_mixing(request, table):
    df = request.getfixturevalue(table)
    rows = [(key(r.doc_id), r.source, len(WORD.findall(r.text or ""))) for r in df.select("doc_id", "source", "text").collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), dict.fromkeys(order, 0.0), set(order)
    while open_:
        share = (total - sum(target[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 2 * size[s]}
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else share * weight[s]
        open_ -= over or open_
    out = mixing.mix_report(df).collect()
    assert Counter((key(r.doc_id), r.source, r["size"]) for r in out) == Counter(rows)
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        assert r.taken in (r["size"] * k for k in range(3))
        rate = target[r.source] / size[r.source] if size[r.source] else 0
        assert int(rate) <= r.copies <= int(rate) + (rate > int(rate))
    again = Counter((key(r.doc_id), r.taken) for r in mixing.mix_report(df.repartition(3)).collect())
    assert again == Counter((key(r.doc_id), r.taken) for r in out)
    emitted = Counter(mixing.mix(df).collect())
    assert sum(emitted.values()) == sum(r.copies for r in out)
    for s in order:
        # a source's taken words are its target plus what one Bernoulli draw a document leaves: four standard errors
        rate = target[s] / size[s] if size[s] else 0
        error = (sum(n * n for _, own, n in rows if own == s) * (rate % 1) * (1 - rate % 1)) ** 0.5
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= 4 * error + 1e-6


# quality --------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    """Fitted on one half of the labelled rows, right on the other."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    out = quality.classify(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    bad = (out.quality == 0) | (out.toxic == 1)
    assert (out.keep & ~bad).sum() >= 0.98 * (~bad).sum()
    assert (~out.keep & bad).sum() >= 0.95 * bad.sum()


def test_quality_awkward(spark, messy, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 1), (None, 0, 0), (5, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(messy, labels)
    assert out.count() == messy.count() and out.where("p_bad IS NULL OR keep IS NULL").count() == 0
    none = labels.where("false")
    assert quality.classify(messy, none).where("keep").count() == messy.count()
    assert Counter(quality.kept_rows(messy, none).collect()) == Counter(messy.collect())
    assert quality.classify(empty, labels).count() == 0 and quality.kept_rows(empty, labels).columns == empty.columns


def brute_strength(groups, centres):
    """groups: values of each; centres: of each. Variance inside over variance between."""
    n, k = sum(map(len, groups)), len(groups)
    if n <= k or k < 2:
        return 1e6
    means = [sum(g) / len(g) for g in groups]
    inside = max(1e-12, sum(sum((x - m) ** 2 for x in g) for g, m in zip(groups, means, strict=True)) / (n - k))
    outside = sum(len(g) * (m - c) ** 2 for g, m, c in zip(groups, means, centres, strict=True))
    between = (outside - (k - 1) * inside) / max(1e-12, n - sum(len(g) ** 2 for g in groups) / n)
    return min(1e6, inside / between) if between > 0 else 1e6


def brute_posterior(rows):
    """rows (host, path, p): (prior, p_bad) of each, by the whole formula; a row's own p is not in its prior."""
    def logit(p):
        q = min(max(p, 1e-9), 1 - 1e-9)
        return math.log(q / (1 - q))

    every = [p for _, _, p in rows]
    mean = min(1 - 1e-6, max(1e-6, sum(every) / len(every)))
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, q, p in rows:
        hosts[h].append(p)
        paths[h, q].append(p)
    k = brute_strength(list(hosts.values()), [mean] * len(hosts))
    j = brute_strength(list(paths.values()), [(sum(hosts[h]) + k * mean) / (len(hosts[h]) + k) for h, _ in paths])
    out = []
    for h, q, p in rows:
        centre = (sum(hosts[h]) - p + k * mean) / (len(hosts[h]) - 1 + k)
        prior = min(1.0, max(0.0, (sum(paths[h, q]) - p + j * centre) / (len(paths[h, q]) - 1 + j)))
        out.append((prior, 1 / (1 + math.exp(-(logit(p) + logit(prior) - logit(mean))))))
    return out


def test_posterior(spark):
    rng = random.Random(4)
    rows = [("big", "a", 0.9)] * 300 + [("big", "b", 0.1)] * 300 + [("mid", None, 0.5)] * 100 + [(None, "a", 0.3)] * 5 + [("tiny", "a", 0.99)]
    rows = [(h, q, min(0.99, max(0.01, p + rng.uniform(-0.1, 0.1)))) for h, q, p in rows]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, host string, path string, p double")
    got = quality._judged(frame).orderBy("i").collect()
    for r, (prior, p_bad) in zip(got, brute_posterior(rows), strict=True):
        assert r.prior == pytest.approx(prior, abs=1e-9) and r.p_bad == pytest.approx(p_bad, abs=1e-9) and r.keep == (r.p_bad <= 0.5)
    assert got[0].prior > 0.8 and got[300].prior < 0.2 and got[-1].prior < 0.9


def test_scores_follow_the_formula(spark):
    """Odds, evidence and scores against plain Python on a small sample; a document's own label is not in its training evidence."""
    texts = [f"plain words here {i} and more" for i in range(40)] + [f"Awful, insult number {i}!" for i in range(20)]
    labels = np.array([(int(i % 7 == 0), int(i >= 40)) for i in range(60)])
    got = [quality.shape(t) for t in texts]
    model = quality.fitted(np.array([x for x, _ in got]), [p for _, p in got], labels)
    places = [set(p.tolist()) for _, p in got]
    rate = (20 + 0.5) / 61
    for x in sorted(set().union(*places))[::7]:
        n, k = sum(x in p for p in places), sum(x in p for p, y in zip(places, labels, strict=True) if y[1])
        z = abs(k - n * rate) / math.sqrt(n * rate * (1 - rate) + 1)
        want = min(1, z / 6) * (math.log((k + 4 * rate) / (n - k + 4 * (1 - rate))) - math.log(rate / (1 - rate)))
        assert model.odds[1][x] == pytest.approx(want, rel=1e-4, abs=1e-5)
    assert ((model.scores(texts)[:, 1] > 0) == labels[:, 1].astype(bool)).all()
    assert quality.evidence(np.array([2.0, -1.0])) == [0.0, -1.0, 2.0, pytest.approx(2**-0.5), 1.0]


def test_contradicting_labels(spark, docs):
    """The worse of a document's labels counts, in whatever order they come."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    bad = labels.where("quality = 0").withColumn("quality", F.lit(1))
    one = quality.fit(docs, labels.unionByName(bad))
    two = quality.fit(docs, bad.unionByName(labels.orderBy(F.desc("doc_id"))))
    three = quality.fit(docs, labels)
    assert (one.weights == two.weights).all() and (one.weights == three.weights).all()


def test_training_features_are_bounded(spark, monkeypatch):
    """Repeated rows of a labelled id count once, long texts with so many places at most."""
    seen = {}

    def fitted(numbers, places, labels):
        seen["rows"], seen["places"] = len(labels), max(map(len, places))
        return quality.NOTHING

    monkeypatch.setattr(quality, "fitted", fitted)
    long = " ".join(f"word{i}" for i in range(3000))
    docs = spark.createDataFrame([(i % 3, long if i % 2 else f"text {i}") for i in range(60)] + [(None, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels, train_places=100)
    assert seen["rows"] == 3 and seen["places"] <= 100


def test_sieve(spark):
    rows = spark.range(3000).select(F.col("id").alias("sieve_row"), F.when(F.col("id") % 10 > 0, F.xxhash64("id")).alias("key"))
    wanted = spark.range(0, 3000, 7).select(F.when(F.col("id") % 5 > 0, F.xxhash64("id")).alias("h"))
    some, clean = sieve.sieved(rows, F.col("key"), wanted)
    found, rest = {r.sieve_row for r in some.collect()}, {r.sieve_row for r in clean.collect()}
    must = {i for i in range(0, 3000, 7) if i % 5 and i % 10}
    assert must <= found and len(found) <= len(must) + 2 and not found & rest and len(found) + len(rest) == 3000
    none, every = sieve.sieved(rows, F.col("key"), wanted.where("false"))
    assert none.count() == 0 and every.columns == rows.columns and every.count() == 3000


def test_long_chains_settle(spark):
    edges = spark.range(0, 400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.u, r.v) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 401)}


# urls -----------------------------------------------------------------------------------------


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://A.Example.COM/en/7x?q#f", "x://com/en/", "x://com/en", "x://xcom/en/", "ftp://a.b.example.net/de/81", "x://example.net/de/9", "x://org?/es/", "x://a..org/es/", "://org/es/é", "x://a:80/b://c.com/en/", "x://" + "a." * 3000 + "com/en/" + "y" * 5000, "x://ümlaut.org/es/?"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[3], None), (3, urls[3], None)], "page_id long, url string, host string")
    got = Counter((key(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect())
    assert got == Counter((key(r.page_id), *brute_url(r.url)) for r in df.collect())
    assert url_filter.filter_urls(df.where("false")).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, rules=()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"))
    every = np.array([tuple(r) for r in keys.collect()], np.int64)
    listed = every[::37]
    cascade = url_filter.build_cascade(listed, keys)
    want = np.zeros(len(every), bool)
    want[::37] = True
    assert (cascade.has(every[:, 0], every[:, 1]) == want).all() and len(cascade.levels) > 1


# media ----------------------------------------------------------------------------------------


def brute_feature(payload, given):
    """The feature string from the samples alone; what is carved is checked elsewhere and only copied."""
    n = len(payload)
    mean, power = sum(payload) / n, sum((x - 128) ** 2 for x in payload) / n
    crossings = sum((a >= 128) != (b >= 128) for a, b in itertools.pairwise(payload))
    carved = given[given.index("carved=") :]
    return f"audio/wav;rate={media.RATE};samples={n};mean={mean:.4f};rms={power**0.5:.4f};crossings={crossings};peak={max(payload)};{carved}"


def test_declared_types_are_corrected(spark):
    wav = media.wav_pack(media.pad(b"some samples"))
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"," + bytes([0, 0, 0, 0, 1, 0, 1, 0, 0, 2, 2, 0x4C, 1, 0]) + b";"
    rows = [(1, wav, "image/png", "x"), (2, gif, None, "x"), (3, b"text " + gif + b" tail", "text/plain", "x"), (4, b"GIF89a broken", "image/gif", "x"), (5, None, "audio/wav", "x"), (6, b"", None, "x"), (None, wav, "audio/wav", "x"), (1, wav, "image/png", "x")]
    df = spark.createDataFrame(rows, "id long, media binary, declared string, kind string")
    got = media.sniff_media(df, "id", "media", "declared").collect()
    assert Counter((r.id, r.corrected_type, len(r.carved)) for r in got) == Counter(
        {(1, "audio/wav", 0): 2, (2, "image/gif", 0): 1, (3, "text/plain", 1): 1, (4, "image/gif", 0): 1, (5, "audio/wav", 0): 1, (6, None, 0): 1, (None, "audio/wav", 0): 1}
    )
    (carved,) = next(r.carved for r in got if r.id == 3)
    assert (carved.kind, carved.start, carved.end, bytes(carved.bytes)) == ("image/gif", 5, 5 + len(gif), gif)
    assert {r.proven for r in got if r.id in (3, 4, 5, 6)} == {False} and media.sniff_media(df.where("false"), "id", "media", "declared").count() == 0


@pytest.mark.parametrize("table", ["docs", "messy", "empty"])
def test_media_round_trip(request, table):
    df = request.getfixturevalue(table)
    rows = Counter((key(r.doc_id), r.text) for r in df.select("doc_id", "text").collect())
    out = media.media_columns(df, keep_media=True).collect()
    seen = Counter()
    features = {}
    for r in out:
        payload = media.wav_samples(r.media)
        assert len(payload) == r.payload_bytes and r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 and 0 <= r.payload_bytes - r.n_bytes <= 64
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        assert zlib.crc32(payload[-64:]) == r.tail_crc32 and len(r.media) == r.media_bytes and r.feature.startswith("audio/wav;")
        seen[key(r.doc_id), payload[: r.n_bytes]] += 1
        assert features.setdefault(payload, r.feature) == r.feature
        assert r.feature == brute_feature(payload, r.feature)
    want = Counter()
    for (i, t), n in rows.items():
        want[i, (t or "").encode()] += n
    assert seen == want


def test_sniffing():
    wav = media.wav_pack(media.pad(b"RIFF BM GIF89a \xff\xd8\xff not media"))
    assert media.corrected_type(wav, "image/png") == ("audio/wav", [])
    pix = bytes(12)
    bmp = b"BM" + (54 + 12).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"\x01\0\x18\0" + bytes(24) + pix
    ihdr = b"IHDR" + (1).to_bytes(4, "big") * 2 + b"\x08\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(c[4:]).to_bytes(4, "big") + c + zlib.crc32(c).to_bytes(4, "big") for c in (ihdr, b"IDAT" + zlib.compress(b"\0\0"), b"IEND"))
    gif = b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    jpg = b"\xff\xd8\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0abc\xff\xd9"
    blob = b"junk" + bmp + b"--" + png + b"--" + gif + b"--" + jpg + b"tail"
    got = [(f.kind, blob[f.start : f.end]) for f in media.sniff(blob)]
    assert got == [("image/bmp", bmp), ("image/png", png), ("image/gif", gif), ("image/jpeg", jpg)]
    for whole in (bmp, png, gif, jpg, wav):
        assert not media.sniff(whole[:-1])
    assert media.corrected_type(b"plain", "text/plain") == ("text/plain", [])
