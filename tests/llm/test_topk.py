import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import topk


def plain(rows, k, is_query):
    clean = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.append((key, [math.floor(64 * x) for x in v]))
    out, seen = [], []
    for key, v in clean:
        if is_query(key) and (key, v) not in seen:
            seen.append((key, v))
            scores = [(max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(v, w)))), other) for other, w in clean if other != key]
            out += [(key, i, other, s) for i, (s, other) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def run(spark, rows, k, n):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, VEC_ID int")
    got = topk.exact_top_k(df, F.col("vec_id") % n == 0, k).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def test_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [0.1]),
            (8, [0.5, 0.25, 3.0]), (9, [-1.0, 0.0]), (10, [2.0**20, -(2.0**18)]), (10, [2.0**20, -(2.0**18)]), (11, [0.5, 0.25]), (None, [1.0]), (1, [0.5, 0.25])]
    assert run(spark, rows, 4, 2) == plain(rows, 4, lambda i: i % 2 == 0)


def test_huge_components(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e30 * (i - 3), 1e20, -i)]) for i in range(9)]
    assert run(spark, rows, 3, 2) == plain(rows, 3, lambda i: i % 2 == 0)


@pytest.mark.parametrize("kind", ["normal", "clustered", "ties"])
def test_against_brute_force_over_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CANDIDATES", 200)
    monkeypatch.setattr(topk, "QUERIES", 40)
    draw = np.random.default_rng(1)
    x = draw.normal(0, 0.2, (600, 24)).astype(np.float32)
    if kind == "clustered":
        x += draw.normal(0, 1, (6, 24)).astype(np.float32)[draw.integers(0, 6, 600)]
    if kind == "ties":
        x = np.round(x * 2) / 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, 7, 5) == plain(rows, 7, lambda i: i % 5 == 0)


def test_bounds_hold():
    draw = np.random.default_rng(2)
    q, x = draw.normal(0, 9, (50, 37)), draw.normal(1, 5, (60, 37))
    for s in (1, 4, 16, 64):
        assert (topk.segment_features(q, s) @ topk.segment_features(x, s).T >= q @ x.T - 1e-9).all()


def test_empty_table(spark):
    assert run(spark, [], 3, 1) == []


def test_cell_bounds_hold():
    draw = np.random.default_rng(3)
    q, x = draw.normal(0, 9, (50, 37)), draw.normal(1, 5, (60, 37))
    for s in (1, 4, 16, 64):
        mean, dev = topk._segments(x, s)
        bound = topk.cell_bounds(*topk._segments(q, s), mean.min(axis=0)[None], mean.max(axis=0)[None], dev.max(axis=0)[None])
        assert (bound[:, 0] >= (q @ x.T).max(axis=1) - 1e-9).all()


def clustered(n, width, clusters, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 40, (clusters, width))
    return np.floor(centres[draw.integers(0, clusters, n)] + draw.normal(0, 2, (n, width)))


def test_few_pairs_are_scored_where_vectors_are_clustered():
    x = clustered(4000, 32, 40, 4)
    space = topk.make_space(x[::5], 32, float(np.abs(x).max()), 16)
    found, scored = topk.block_top_k(np.arange(200), list(x[:200]), np.arange(4000), list(x), 5, space)
    want = q_best(x, 200, 5)
    assert [(i, j) for i, j, _ in found] == want and scored < 0.15 * 200 * 4000


def q_best(x, n, k):
    score = x[:n] @ x.T
    np.fill_diagonal(score, -np.inf)
    return [(i, j) for i in range(n) for j in sorted(range(len(x)), key=lambda j: (-score[i, j], j))[:k]]


def test_thresholds_keep_what_reaches_them():
    x = clustered(600, 8, 3, 5)
    space = topk.make_space(x, 8, float(np.abs(x).max()), 4)
    plain_score = x[:50] @ x.T
    np.fill_diagonal(plain_score, -np.inf)
    least = [int(np.sort(row)[-3]) for row in plain_score]
    found, _ = topk.block_top_k(np.arange(50), list(x[:50]), np.arange(600), list(x), 3, space, least)
    assert [(i, j) for i, j, _ in found] == q_best(x, 50, 3)


def test_cells_are_passed_over(spark, monkeypatch):
    x = clustered(3000, 16, 12, 6) / 64
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    assert run(spark, rows, 4, 25) == plain(rows, 4, lambda i: i % 25 == 0)


def test_a_third_of_the_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    x = np.random.default_rng(7).normal(0, 0.3, (900, 8)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, 6, 50) == plain(rows, 6, lambda i: i % 50 == 0)
