"""Substring dedup against brute force."""

import random
from collections import defaultdict

import pytest

from pagemill.llm import blocks, substring_dedup


def brute(docs, window=13):
    first = defaultdict(list)
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - window + 1):
                first[tuple(w[s : s + window])].append(i)
    low = {k: min(v) for k, v in first.items()}
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if low[tuple(w[s : s + window])] < i:
                    gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(map(str, out))


def corpus(rng, n, vocabulary):
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "ß", "the"]
    passages = [rng.choices(words, k=rng.randrange(8, 90)) for _ in range(12)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages) if rng.random() < 0.5 else rng.choices(words, k=rng.randrange(40))
            if rng.random() < 0.2 and w:
                w[rng.randrange(len(w))] = "changed"
        docs.append((i * 3, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rng.shuffle(docs)
    return [*docs, docs[0], docs[1], (None, docs[2][1]), (None, None), (7, None), (8, ""), (10, " \n"), (11, "the " * 3000), (13, "the " * 40), (2, "a b " * 30), (4, "a b " * 14)]


@pytest.mark.parametrize("vocabulary,window,size,hot", [(2000, 13, 4 << 20, 4096), (3, 13, 1500, 4096), (2000, 13, 700, 4), (40, 5, 900, 6), (2000, 20, 2000, 4096), (5, 3, 1000, 2)])
def test_against_brute_force(spark, monkeypatch, vocabulary, window, size, hot):
    monkeypatch.setattr(blocks.blocks, "__defaults__", (size,))
    monkeypatch.setattr(substring_dedup, "HOT_DOCS", hot)
    docs = corpus(random.Random(vocabulary + window), 60, vocabulary)
    df = spark.createDataFrame([(t, i, "x", 5) for i, t in docs], "text string, doc_id long, bucket string, n_words int")
    got = substring_dedup.dedup_substrings(df, window=window).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.text)) for r in got) == brute(docs, window)
    assert got[0].bucket == "x"


def test_untouched_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb  c"), (2, None), (3, "w " * 20), (4, "w " * 20)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.dedup_substrings(docs, whole_if_untouched=True).collect()}
    assert got == {1: ("a\nb  c", 0), 2: (None, 0), 3: ("w " * 20, 0), 4: ("", 20)}
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_shared_anchors_meet_again_and_hot_ones_are_dealt():
    rng = random.Random(9)
    passage = [b"p%d" % k for k in range(40)]
    own = [[b"%d" % rng.randrange(10**9) for _ in range(60)] for _ in range(30)]
    found = [substring_dedup.Anchors([w[:30] + passage + w[30:]], [i], 13, 8) for i, w in enumerate(own)]
    for hot, kind in ((4096, substring_dedup.SHARED), (10, substring_dedup.HOT)):
        sent = [(i, b, substring_dedup.unpack(x)) for i, f in enumerate(found) for b, x in f.seeds()]
        states = {}
        for bucket in range(8):
            part = [x for x in sent if x[1] == bucket]
            for (i, b, _), s in zip(part, substring_dedup._states([x[2] for x in part], hot)):
                states.setdefault(i, []).append((b, substring_dedup.pack(s)))
                assert set(s) <= {0, kind}
        contexts = [f.extend(states[i]) for i, f in enumerate(found)]
        assert all(0 < len(c) <= 40 for c in contexts)  # of some 130 words
        inner = {c[1] for f in contexts for c in f if c[1] in b" ".join(passage)}
        assert len(inner) >= 5 and len({c[0] for f in contexts for c in f}) > (1 if kind == substring_dedup.SHARED else 3)
