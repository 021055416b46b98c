"""Language ID: exact marginals, held-out accuracy, edge cases."""

import itertools
import zlib

import numpy as np
import pytest

from pagemill.llm import language_id as L
from pagemill.llm import queries

EN = "the cat sat on the mat and the dog was there with them while they were playing in the garden that morning "
FR = "le chat est dans la maison et le chien reste avec eux pendant que les enfants jouent au jardin ce matin "
DE = "die katze sitzt auf der matte und der hund war dort mit ihnen als sie heute morgen im garten spielten "


@pytest.mark.parametrize("part", [1, 3, 128])
def test_marginals_are_exact(monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    rng = np.random.default_rng(1)
    counts, transition = np.array([1, 7, 3, 6]), rng.normal(size=(3, 3))
    score = rng.normal(size=(17, 3)) * 2
    got = L.marginals(score, counts, transition)
    at = 0
    for n in counts:
        total, each = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(score[at + t, k] for t, k in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, k in enumerate(path):
                each[t, k] += p
        assert np.allclose(got[at : at + n], each / total)
        at += n


def test_labels_switch_within_a_text():
    model = L.fit([("en", EN * 5), ("fr", FR * 5), ("de", DE * 5)], sequences=300)
    words = L.words_of("the dog was playing with them " + "le chien reste dans la maison " + "der hund war im garten")
    tags = [model["labels"][k] for k in L.marginals(L.scores(words, model), np.array([len(words)]), model["transition"]).argmax(axis=1)]
    assert tags[:6] == ["en"] * 6 and tags[6:12] == ["fr"] * 6 and tags[12:] == ["de"] * 5


def test_edges(spark):
    model = L.fit([("en", EN * 5), ("fr", FR * 5)], sequences=200)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, EN), (5, FR.upper()), (6, EN * 4000), (4, EN), (None, FR), (7, "東京"), (8, "a" * 50_000), (9, "½ ② ² Ⅷ 三"[:-2])]
    df = spark.createDataFrame([(t, i, "no") for i, t in rows], "text string, doc_id long, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(df, model).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert by[1] == by[2] == by[3] == by[9] == ("und", 0.0)
    assert by[4][0] == by[6][0] == "en" and by[5][0] == by[None][0] == "fr" and len(got) == len(rows)
    assert by[7][0] in ("en", "fr") and all(0 <= s <= 1 for _, _, s in got)
    assert L.identify(df.limit(0), model).count() == 0
    none = L.fit([])
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify(df, L.fit([("en", EN)])).collect()} == {"und", "en"}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_DOCS", 5)
    rows = [(i, EN, "en" if i % 3 else "fr") for i in range(60)] + [(90, None, "en"), (91, EN, None), (None, EN, "de")]
    got = L.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert all(sum(a == k for a, _ in got) <= 5 for k in ("en", "fr", "de")) and {a for a, _ in got} >= {"en", "fr"}


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_every_label_is_learned_and_pieces_come_from_whole_texts(spark):
    names = [f"l{k:02}" for k in range(70)]
    rows = [(100 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("la", "to", "mi") * 9), names[k]) for k in range(70) for i in range(3)]
    sample = L.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert sorted({k for k, _ in sample}) == names
    model = L.fit(sample, rounds=2)
    assert model["labels"] == names
    long = " ".join(["aa"] * 5000 + ["zz"] * 5000)
    rows = [(i, long + str(i), "x") for i in range(20)] + [(1, "same", "y")] * 5000
    got = L.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "text", "lang", "doc_id")
    texts = " ".join(t for k, t in got if k == "x")
    assert texts.count("zz") > 500 < texts.count("aa") and [t for k, t in got if k == "y"] == ["same"]
    assert max(len(t) for _, t in got) <= L.PIECES * (L.PIECE_CHARS + 1)


def test_gradient_of_transitions_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    n, k = 5, 3
    score, transition = rng.normal(size=(n, k)), rng.normal(size=(k, k))

    def expected(t):
        total, out = 0.0, np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            p = np.exp(sum(score[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += p
            for a, b in zip(path, path[1:]):
                out[a, b] += p
        return out / total

    emit, move = np.exp(score)[None], np.exp(transition)
    alpha, beta = np.ones((1, n, k)), np.ones((1, n, k))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, n):
        alpha[:, t] = (alpha[:, t - 1] @ move) * emit[:, t]
        alpha[:, t] /= alpha[:, t].sum()
    for t in range(n - 2, -1, -1):
        beta[:, t] = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
        beta[:, t] /= beta[:, t].sum()
    assert np.allclose(L.transitions(alpha, emit * beta, move), expected(transition))
