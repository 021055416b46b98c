"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline as C
from pagemill.llm import near_copies
from pagemill.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_roots(texts):
    sets, root = [near_copies.shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        union = sets[a] | sets[b]
        if not union or len(sets[a] & sets[b]) / len(union) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(texts))]


def kept(spark, rows):
    docs = stored(spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).repartition(3), "test")
    return sorted(((r.doc_id, r.text) for r in C.keep_one_of_near_copies(spark, docs, "").collect()), key=str)


def edited(rng, words, share):
    return " ".join(rng.choice("xyz") + str(rng.random()) if rng.random() < share else w for w in words)


def test_every_pair_of_similarity_is_found(spark):
    rng = random.Random(5)
    texts = []
    for size in (1, 4, 5, 9, 30, 100, 600):
        for _ in range(4):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            texts += [" ".join(base)] + [edited(rng, base, share) for share in (0, 0.01, 0.02, 0.03, 0.05)]
    texts += ["", None, " \n"] + ["one very common passage of some words " * 4 + str(rng.random()) for _ in range(20)]
    roots = brute_roots(texts)
    assert len(set(roots)) < len(texts) - 40
    assert kept(spark, list(enumerate(texts))) == sorted(((i, texts[i]) for i in set(roots)), key=str)


@pytest.mark.parametrize("common,same", [(8, True), (7, False)])
def test_similarity_at_the_bound(spark, common, same):
    tail = 10 - common  # 10 shingles in all
    a = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(a)), (2, " ".join(a[: 14 - tail]))]
    assert len(kept(spark, rows)) == (1 if same else 2)


def test_one_row_stays_of_each_group_whatever_its_ids(spark):
    a, b, c = ("a text of several words that others copy", "an unlike passage which nobody else has written", "third thing entirely about rivers and their fish")
    d = "rows without any id at all which repeat"
    rows = [(None, a), (1, a), (4, a), (None, b), (2, c), (2, a), (None, d), (None, d), (None, d), (7, "x y"), (7, "x y")]
    assert kept(spark, rows) == sorted([(1, a), (None, b), (2, c), (None, d), (7, "x y")], key=str)


def test_sketches_rule_out_no_similar_pair():
    rng = random.Random(6)
    for size in (5, 40, 300, 1100, 3000, 9000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for share in (0, 0.004, 0.01, 0.015, 0.02):
            a, b = " ".join(base), edited(rng, base, share)
            x, y = near_copies.hashes(a), near_copies.hashes(b)
            s, t = (np.frombuffer(near_copies.sketch_of(h), np.int8) for h in (x, y))
            if near_copies.alike(near_copies.shingles(a), near_copies.shingles(b)):
                assert near_copies._close(len(x), s, np.array([len(y)]), t[None])[0]
                assert near_copies._close(len(y), t, np.array([len(x)]), s[None])[0]
    assert near_copies.sketch_of(np.full(300, 1 << 63, np.uint64)) == b""
    assert near_copies._close(10, s[:0], np.array([10]), t[None])[0]


def test_a_group_larger_than_tiles_meets_whole(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE", 3)
    monkeypatch.setattr(near_copies, "OFTEN", 10**6)
    monkeypatch.setattr(near_copies, "CLOSEST", (1, 2, 1 << 62))
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(30)]
    bases = [[f"v{i}_{k}" for k in range(8)] + passage for i in range(25)]
    texts = [edited(rng, b, share) for b in bases for share in (0, 0.03, 0.03)]
    roots = brute_roots(texts)
    assert kept(spark, list(enumerate(texts))) == sorted(((i, texts[i]) for i in set(roots)), key=str)
