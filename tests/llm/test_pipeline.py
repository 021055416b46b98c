"""The pipeline's stages against brute force, each on what the one before kept."""

import numpy as np
import public_tokenizers as P
from test_dedup import line_brute
from test_near_copies import brute_roots
from test_substring import brute
from tokenizers import Tokenizer

import corpus_pipeline as C
from pagemill.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(100_001, None, None, None, None), (100_002, "123 - 456", None, "x", 9), (None, "A line of text without an id, in the middle of it.", "en", None, 1), (100_003, "", "en", "x", 0)], docs.schema)
    docs = stored(docs.union(extra), "test")
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "substring_dedup", "packing"]
    kept = [docs]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == docs.columns
        kept.append(stored(out, "test"))
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept]
    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert {100_001, 100_002, 100_003} <= gone and len(gone) <= 4 and set(rows[1]) <= set(rows[0])
    assert sorted(str((i, t)) for i, t in rows[2]) == sorted(str(eval(x)[:2]) for x in line_brute(rows[1]))
    some = rows[2]
    order = sorted(range(len(some)), key=lambda k: (some[k][0] is None, some[k][0] or 0))
    roots = brute_roots([some[k][1] for k in order])
    want = [some[order[k]] for k in range(len(order)) if roots[k] == k]
    assert sorted(map(str, rows[3])) == sorted(map(str, want))
    lost = {eval(x)[0]: eval(x) for x in brute(rows[3])}
    assert sorted(map(str, rows[4])) == sorted(str((i, lost[i][3] if lost[i][2] else t)) for i, t in rows[3])
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    pieces: dict = {}
    for r in C.STAGES[-1][1](spark, kept[-1], SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert len(pieces) == len(rows[4])
    for i, t in rows[4]:
        assert b"".join(b for _, b in sorted(pieces[i])) == np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_run_and_empty_table(spark, tmp_path):
    assert C.run(spark, SF).count() > 100
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
