"""Exact, line and SimHash dedup against brute force, and their edge cases."""

import functools
import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import components as graph
from pagemill.llm import exact_dedup, line_dedup, simhash
from pagemill.llm.common import setting
from pagemill.llm.components import components

SCHEMA = "doc_id long, text string, keep_id string, fp int, `a b` string"
LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = ["", None, "Hello World", "hello world", "HELLO WORLD", "hello  world", LONG, LONG, LONG.upper(), LONG[:-1], "Éa", "éa", "one", " \n\n ", "\n", "x\x00y"]


def rows():
    out = [(i, t, "k", 1, "z") for i, t in enumerate(TEXTS)]
    return [*out, out[2], (None, "hello world", None, None, None), (None, None, None, None, None)]


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, bits):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = exact_dedup.exact_groups(docs, hash_bits=bits).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[lower(t)].append(i)
    want = []
    for i, t, *_ in rows():
        ids = [x for x in groups[lower(t)] if x is not None]
        top = max(ids, default=None)
        want.append((i, top, len(groups[lower(t)]), i == top, hashlib.sha256(lower(t)).hexdigest()))
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got])) == sorted(map(str, want))
    assert "a b" in got[0].asDict() and got[0]["fp"] in (1, None)


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_only_chunks_of_clashing_hashes_move_again(spark, monkeypatch, most):
    """Two contents of one 20-bit hash among long texts: with a list of clashes, theirs are all that is placed."""
    monkeypatch.setattr(exact_dedup, "CLASHES", most)
    seen, pair = {}, None
    for i in range(10**6):
        t = f"text number {i}"
        h = xxhash.xxh64_intdigest(t) & (1 << 20) - 1
        if h in seen:
            pair = (seen[h], t)
            break
        seen[h] = t
    rng = random.Random(4)
    long = " ".join(str(rng.random()) for _ in range(9000))
    texts = [*pair, pair[0].upper(), long, long + "x", long]
    placed = []
    ranked = exact_dedup._ranked

    def counted(*args):
        placed.append(args[3].count())
        return ranked(*args)

    monkeypatch.setattr(exact_dedup, "_ranked", counted)
    got = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hash_bits=20).collect()
    assert {r.doc_id: r.keep_id for r in got} == {0: 2, 1: 1, 2: 2, 3: 5, 4: 4, 5: 5}
    assert placed == [2] if most else placed[0] > 10


def test_cuts_are_content_defined():
    gear = exact_dedup._gear()
    data = random.Random(1).randbytes(200_000)
    ends = exact_dedup.cuts(data, gear)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert all(b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))
    moved = {e - 777 for e in exact_dedup.cuts(random.Random(2).randbytes(777) + data, gear)}
    assert len(moved & set(ends)) > len(ends) * 0.7


def line_brute(docs, min_docs=3, min_chars=20):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blank))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = []
        for x in lines:
            ids = {d for d in holders[key(x)] if d is not None}
            if len(key(x)) < min_chars or len(ids) < min_docs or i == max(ids):
                stay.append(x)
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(map(str, out))


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    rng = random.Random(3)
    pool = [f"this is the shared line number {i} of many" for i in range(12)] + ["short", "", " \t", "ÄÖÜ äöü with non ascii letters", "x" * 5000]
    docs = [(i, "\n".join(rng.choice([str.upper, str.lower, lambda x: f"  {x}\r", str])(rng.choice(pool)) for _ in range(rng.randrange(9)))) for i in range(60)]
    docs += [(None, "\n".join(pool)), (61, None), (62, ""), (63, "\n"), docs[5], (64, "\n".join(pool * 50))]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in docs], "doc_id long, text string, n_lines int, `pos` int")
    got = line_dedup.dedup_lines(df, batches=batches).collect()
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got) == line_brute(docs)
    assert got[0].pos == 8


def test_runs_carry_states_and_shadow_old_rows(spark):
    runs = line_dedup.Runs(4, 2)
    make = lambda x: spark.createDataFrame(x, "h1 long, h2 long, id long")
    rows = lambda df: {(r.h1, r.docs, r.top) for r in df.collect()}
    runs.add(make([(1, 1, 10), (2, 2, 10)]))
    first = runs.levels[0][0]
    second = line_dedup.bucketed(make([(1, 1, 11), (3, 3, 11)]).groupBy("h1", "h2").agg(F.count("id").alias("docs"), F.max("id").alias("top")), "run", ["h1", "h2"], 4)
    with setting(spark, line_dedup.ORDERED, "true"):
        run = line_dedup.carried(second, [first])
        assert rows(run) == {(1, 2, 11), (3, 1, 11)}
        for df in (run, line_dedup.current([second, first])):  # old runs are neither moved nor sorted
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.add(make([(1, 1, 11), (3, 3, 11), (1, 1, 11)]))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(make([(3, 3, 12), (4, 4, 12)]))
    assert [rows(x) for x in runs.newest_first()] == [{(3, 2, 12), (4, 1, 12)}, {(1, 2, 11), (2, 1, 10), (3, 1, 11)}]
    assert rows(runs.states()) == {(1, 2, 11), (2, 1, 10), (3, 2, 12), (4, 1, 12)} and runs.states().count() == 4
    assert spark.conf.get(line_dedup.ORDERED, "false") == "false"


def test_line_dedup_rests_on_its_anti_joins(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "current", lambda runs: functools.reduce(lambda x, y: x.unionByName(y), runs))
    docs = [(i, "the very same line in all of these documents") for i in range(12)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got) != line_brute(docs)


def brute_print(text, k=3):
    words = lower(text).split()
    if not words:
        return 0
    k = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(prints, radius):
    root = {}
    for i in range(len(prints)):
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            x = todo.pop()
            for j in range(len(prints)):
                if j not in root and (prints[x] ^ prints[j]).bit_count() <= radius:
                    root[j] = i
                    todo.append(j)
    return root


def test_covering_has_no_gap():
    masks = simhash.covering(list(range(64)), 3)
    assert len(masks) == 15
    rng = random.Random(4)
    for _ in range(20_000):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not diff & m for m in masks)
    for m in masks:
        free = [p for p in range(64) if not m >> p & 1]
        assert all((~(m | s) & (1 << 64) - 1).bit_count() <= 16 for s in simhash.covering(free, 3))


@pytest.mark.parametrize("bucket", [256, 2])
def test_near_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=150)) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(8):
            w = b.split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append("  ".join(w))
    texts += TEXTS + ["a", "a b", "A B", "a b c", "a b c a b c"]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, root int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(df).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_roots(prints, 3)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in range(len(texts))}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, rng.randrange(200, 900)) for _ in range(300)] + [(7, 7), (5, 3), (3, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got.get(n, n) == min(seen)


@pytest.mark.parametrize("op", [exact_dedup.exact_groups, line_dedup.dedup_lines, simhash.near_groups])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    one = op(spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")).collect()
    assert len(one) == 1 and one[0].doc_id is None
