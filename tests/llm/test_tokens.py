"""BPE and packing against the tokenizer libraries, and packing's limits."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pagemill.llm import bpe, common, packing, tokenizer

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello world, it's 2024!", "  \n\n\t x  ", "naïve café — 東京 🙂🙂", "<|endoftext|> a", "a" * 5000, "word " * 9000, " ", "don't  stop\r\n", "\x00\x01", "Ünïcödé " * 40]


def ranks_of():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks_of(), special_tokens={})


def test_both_vocabulary_files_agree():
    assert tokenizer.read_ranks(RANKS) == tokenizer.read_ranks(JSON) == ranks_of()


def test_varints():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert common.unvarints(common.varints(v)).tolist() == v.tolist()
    assert common.unvarints(common.varints(v[:0])).tolist() == []


def test_symbols():
    v = np.array([0, 1, 191, 192, 193, 8383, 8384, 192 + (62 << 13) - 1, 192 + (62 << 13), 5_000_000, 0])
    assert bpe._unsymbols(bpe._symbols(v)).tolist() == v.tolist() and len(bpe._unsymbols(bpe._symbols(v[:0]))) == 0


@pytest.mark.parametrize("chain", [1, 20_000, 1 << 20])
def test_bpe_round_trip(spark, enc, monkeypatch, chain):
    monkeypatch.setattr(bpe, "BLOCK", 3000)
    monkeypatch.setattr(bpe, "CHAIN", chain)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab cé\n'1.") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(t, i, "q", 3) for i, t in enumerate(texts)] + [(None, None, None, None)], "text string, doc_id long, ids string, bucket int").repartition(3)
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS)
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in out.collect()}
    assert got.pop(None) == ([], b"")
    assert got == {i: (enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.decoded_digests(out.drop("decoded"), RANKS).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert digest[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, RANKS, P.PATTERN), RANKS).count() == 0
    assert bpe.encode(spark.createDataFrame([("a b",)], "text string"), RANKS, P.PATTERN).collect()[0].ids == [64, 275]


def packed(spark, rows, schema="doc_id long, text string", **limits):
    df = spark.createDataFrame(rows, schema).repartition(2)
    return packing.pack(df, JSON, P.PATTERN, **limits).collect()


def test_packing_holds_every_token(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "zyx", "a"]) for _ in range(rng.randrange(3000))) for _ in range(150)]
    lib = Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    got = packed(spark, [(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == np.array(ids[at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and len(rs) <= 256
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


@pytest.mark.parametrize("segments,loss", [(3, 2048), (4, 300), (1, 100), (64, 1)])
def test_packing_keeps_all_limits(spark, segments, loss):
    rng = random.Random(3)
    rows = [(i, "tok " * rng.randrange(1, 900), rng.choice([None, 0, 5, 100, 5000])) for i in range(60)]
    got = packed(spark, rows, "doc_id long, text string, prompt int", loss_from_col="prompt", max_segments=segments, max_loss=loss)
    total, per = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        s = per.setdefault(r.sequence_id, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r.length, s[1] + 1, s[2] + r.loss_tokens
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, min(r.prompt or 0, r.doc_tokens)))
    assert all(a <= 2048 and b <= segments and c <= loss for a, b, c in per.values())
    assert {r.doc_id: r.doc_tokens for r in got} == total and len(total) == 60


def test_packing_edges(spark):
    assert packed(spark, []) == []
    one = packed(spark, [(None, None)])
    assert [(r.doc_id, r.start, r.length, r.offset, zlib.crc32(bytes(r.ids))) for r in one] == [(None, 0, 1, 0, zlib.crc32(np.array([1], "<u4").tobytes()))]
    assert packed(spark, [(1, "")], end_id=None) == []
    with pytest.raises(ValueError):
        packed(spark, [(1, "a")], max_segments=0)


def test_shared_folder(spark):
    from types import SimpleNamespace

    def session(value):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: value), sparkContext=SimpleNamespace(applicationId="app-1"))

    assert common.shared_dir(session("file:///shared/x")) == "file:///shared/x"
    own = common.shared_dir(session(None))
    assert own == common.shared_dir(session(None)) and "pagemill-" in own
    t = common.stored(spark.range(3), "test")
    assert t.count() == 3
    common.dropped(t)
    with pytest.raises(Exception):
        t.count()


def test_packing_takes_added_tokens_as_the_unmodified_library(spark):
    end = "<|endoftext|>"
    texts = [f"a{end}b", f"a {end} b", end * 2, f"{end}\n\n{end}  x", end[:-1], f"<{end}>", f"don't {end}'s 12{end}34 é{end}"]
    lib = Tokenizer.from_file(JSON)
    got: dict = {}
    for r in sorted(packed(spark, list(enumerate(texts))), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(texts)}
