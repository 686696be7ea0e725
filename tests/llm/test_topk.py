from __future__ import annotations

import math

import numpy as np
from stratafold.llm import topk


def brute(rows, k=10):
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) for x in v])
    out = []
    for i in sorted(q):
        if i % 100 == 0:
            me = min(q[i])
            scored = sorted((-sum(a * b for a, b in zip(me, v, strict=True)), j) for j, vs in q.items() if j != i for v in vs if len(v) == len(me))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(450)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)]  # ties
    rows += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (None, rows[0][1]), (900, [0.5, 0.5]), (901, [0.1, 0.2]), (1100, []), (1101, []), (100, rows[5][1]), (7, rows[7][1])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in topk.op4_topk(spark, str(tmp_path)).collect())
    assert got == sorted(brute(rows))
    vectors = topk.quantised(spark.read.parquet(str(tmp_path / "embeddings.parquet")))
    assert sorted(tuple(r) for r in topk.search(vectors, vectors.filter("vec_id % 100 = 0"), query_cells=20).collect()) == got


def test_the_bound_stops_the_search_early():
    rng = np.random.default_rng(0)
    x = rng.integers(-10, 11, (5000, 4))
    x[7] = 1000
    block = topk.Block(np.arange(5000), x)
    ids, scores, scored = block.top(-1, np.array([1, 1, 1, 1]), 1)
    assert ids.tolist() == [7] and scores.tolist() == [4000] and scored < 100


def test_cells_out_of_reach_are_not_read():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1000, (40, 16))
    x = np.rint(centres[rng.integers(0, 40, 20000)] + rng.normal(0, 60, (20000, 16))).astype(np.int64)
    ids = rng.permutation(20000)
    block = topk.Block(ids, x)
    share = []
    for i in range(0, 20000, 500):
        at = int(np.flatnonzero(ids == i)[0])
        got, scores, scored = block.top(i, x[at], 10)
        all_scores = x @ x[at]
        want = sorted((-int(s), int(j)) for j, s in zip(ids, all_scores, strict=True) if j != i)[:10]
        assert [(-int(s), int(j)) for j, s in zip(got, scores, strict=True)] == want
        share.append(scored / 20000)
        again = block.top(i, x[at], 10, floor=float(scores[4]))
        assert again[0].tolist() == got[scores >= scores[4]].tolist()
    assert np.mean(share) < 0.3
    whole = topk.Block(ids, x, cells=1)
    assert np.mean(share) < 0.7 * np.mean([whole.top(i, x[int(np.flatnonzero(ids == i)[0])], 10)[2] / 20000 for i in range(0, 20000, 500)])


def test_scores_beyond_what_doubles_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**29), 2**29, (3000, 8))
    q = rng.integers(-(2**29), 2**29, 8)
    for cells in (1, 6):
        ids, scores, _ = topk.Block(np.arange(3000), x, cells=cells).top(-1, q, 5)
        want = sorted((-sum(int(a) * int(b) for a, b in zip(row, q, strict=True)), i) for i, row in enumerate(x))[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want


def test_empty_table(spark):
    none = topk.quantised(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert topk.search(none, none).collect() == []
