"""Embedding near-dedup against brute force, and its error bound."""

import numpy as np
import pytest

from pagemill.llm import embedding_dedup


def brute(rows, threshold):
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    near[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(map(str, out))


@pytest.mark.parametrize("tile,threshold", [(1024, 0.93), (7, 0.93), (7, 0.5)])
def test_against_brute_force(spark, monkeypatch, tile, threshold):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(90):
        v = centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1e-20, 1, 1e15])], int(rng.integers(3))))
    rows += [rows[3], (200, rows[3][1], rows[3][2]), (201, rows[4][1], None), (202, None, 1), (203, [0.0] * 16, 1), (204, [None, *rows[4][1][1:]], 1), (205, [float("nan"), *rows[4][1][1:]], 1), (206, [float("inf"), *rows[4][1][1:]], 1), (207, [], 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (None, rows[5][1], rows[5][2])]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame([(*r, "x", 4) for r in rows], "vec_id long, embedding array<float>, label int, cls string, n_links int")
    got = embedding_dedup.near_groups(df, threshold=threshold).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(rows, threshold)
    assert got[0].cls == "x"


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 32)), rng.standard_cauchy(size=(200, 32))
    xu, xq, xs, xa, xd = embedding_dedup.quantised(x)
    yu, yq, ys, ya, yd = embedding_dedup.quantised(y)
    assert xq.dtype == yq.dtype == np.int8
    off = np.abs(xu @ yu.T - (xq.astype(float) @ yq.astype(float).T) * np.outer(xs, ys))
    assert (off <= np.outer(xa, yd) + np.outer(xd, ya) + np.outer(xd, yd) + embedding_dedup.SLACK).all()


def test_empty_table(spark):
    assert embedding_dedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_hot_label_over_many_tiles(spark, monkeypatch):
    """1,200 vectors of one label in three close groups, 40 tiles: as many links as brute force finds, sure or computed again."""
    monkeypatch.setattr(embedding_dedup, "TILE", 30)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(3, 24))[rng.integers(3, size=1200)] + rng.normal(size=(1200, 24)) * 0.25).astype(np.float32)
    unit = embedding_dedup.unit_rows(x.astype(float))
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_groups(df).collect()}
    assert [got[i] for i in range(1200)] == links.tolist() and links.sum() > 10_000
