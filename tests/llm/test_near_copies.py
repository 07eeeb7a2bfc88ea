"""The pipeline's near-copy stage against brute-force Jaccard similarities."""

import random
import re

import corpus_pipeline as P
import pytest
from tests.llm.test_operators import WORD, brute_mark, messy_rows

from tensorloom.llm import jaccard_join

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Ids that stay of (id, text), ids different."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for (i, _), c in zip(rows, label, strict=True):
        best[c] = min(best.get(c, i), i)
    return set(best.values())


def edited_rows(groups=25, copies=8):
    """Groups of texts with growing numbers of edits about a common start that all groups share, and chains of edits."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    start = rng.choices(words, k=30)
    out = []
    for _ in range(groups):
        base = start + rng.choices(words, k=rng.choice((5, 60, 200)))
        for k in range(copies):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = "edit" + str(rng.random())
            out.append(" ".join(text))
            if k % 3 == 2:
                base = text
    rng.shuffle(out)
    return list(enumerate(out))


def stays(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    step = dict(P.STAGES)["near_copies"]
    return [r.doc_id for r in step(spark, spark.read.parquet(str(tmp_path / "in")), SF).collect()]


@pytest.mark.parametrize(("few", "block", "worth"), [(8, 1 << 14, 8), (1, 5, 0), (2, 4, 10**6)])
def test_edited_texts(spark, tmp_path, monkeypatch, few, block, worth):
    """Whatever is counted or compared in blocks, and whether nearest nodes are asked for once or until none links."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "WORTH", worth)
    rows = edited_rows() + [(10_000 + i, t) for i, t in enumerate(["", None, " \n", "a b", "A  b", "a b c"])]
    got = stays(spark, tmp_path, rows)
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows)


def test_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in P.drop_lines(spark, docs, SF).collect()]
    got = stays(spark, tmp_path, rows)
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(r[0], r[1]) for r in messy_rows()]
    got = stays(spark, tmp_path, rows)
    want = {frozenset(shingles(t)) for _, t in rows}
    assert len(got) <= len(want) and sum(i is None for i in got) == 0


def marked_rows():
    """Long texts and their copies with a changed word; texts of equal repeats, so alike in fingerprints, with different ends."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(4000)]
    out = []
    for _ in range(12):
        base = rng.choices(words, k=400)
        out += [" ".join(base), " ".join([*base[:200], "changed", *base[201:]])]
    start = rng.sample(words, 9) * 111
    return list(enumerate([*out, *(" ".join(start + rng.choices(words, k=30)) for _ in range(4))]))


def test_fingerprints_link_first(spark, tmp_path, monkeypatch):
    """Without any column of the product, covering SimHash alone finds the similar pairs within 3 bits, and the check on whole sets keeps the others."""
    rows = marked_rows()
    marks, sets = [brute_mark(t, 3) for _, t in rows], [shingles(t) for _, t in rows]
    within = [(i, j) for j in range(len(rows)) for i in range(j) if (marks[i] ^ marks[j]).bit_count() <= 3]
    alike = [(i, j) for i, j in within if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(alike) > 3 and len(within) > len(alike) and len({j for _, j in alike}) == len(alike)
    real = jaccard_join._entries
    monkeypatch.setattr(jaccard_join, "_entries", lambda heads: real(heads).where("false"))
    assert sorted(stays(spark, tmp_path, rows)) == sorted({i for i, _ in rows} - {j for _, j in alike})


def test_product_is_asked_for_the_rest(spark, tmp_path, monkeypatch):
    """No pair that fingerprints have linked is compared again, and all similar pairs are linked."""
    rows = marked_rows()
    marks, sets = [brute_mark(t, 3) for _, t in rows], [shingles(t) for _, t in rows]
    compared, real = [], jaccard_join._links

    def links(docs, nodes, pairs, *more):
        at = nodes.join(docs, ["file", "line"]).select("row", "text")
        texts = {r.row: r.text for r in at.collect()}
        compared.append([{texts[r.a], texts[r.b]} for r in pairs.collect()])
        return real(docs, nodes, pairs, *more)

    monkeypatch.setattr(jaccard_join, "_links", links)
    assert set(stays(spark, tmp_path, rows)) == brute_kept(rows)
    assert len(compared) >= 2
    near = [{rows[i][1], rows[j][1]} for j in range(len(rows)) for i in range(j) if (marks[i] ^ marks[j]).bit_count() <= 3 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert near and all(x in compared[0] for x in near)
    assert not any(x in near for later in compared[1:] for x in later) and any(later for later in compared[1:])
