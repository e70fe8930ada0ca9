"""Vantage-point trees against brute force, exact at factor 1, with ties and edges."""

import numpy as np

from fraudlens.llm import neighbours as V


def plain(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[q] = [(int(ids[i]), d[i]) for i in order if ids[i] != q][:k]
    return out


def test_exact_and_relaxed(spark):
    r = np.random.default_rng(1)
    x = np.concatenate((r.normal(size=(400, 6)), np.repeat(r.normal(size=(1, 6)), 200, axis=0)))
    ids = np.arange(600)
    rows = spark.createDataFrame([(int(i), v.tolist(), "clash") for i, v in zip(ids, x)], "vec_id bigint, vector array<float>, score string")
    x = x.astype(np.float32).astype(float)
    want = plain(ids, x, range(0, 600, 100), 10)
    got = V.nearest(rows, rows.filter("vec_id % 100 = 0"), shard_rows=150, block_queries=2).collect()
    for q, pairs in want.items():
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [m[1] for m in mine] == [p[0] for p in pairs] and [m[0] for m in mine] == list(range(1, 11))
        assert np.allclose([m[2] for m in mine], [p[1] for p in pairs])
    near = V.nearest(rows, rows.filter("vec_id % 100 = 0"), factor=1.3, shard_rows=150).collect()
    hits = sum((g.vec_id, round(g.score, 9)) in {(p, round(d, 9)) for p, d in want[g.query_id]} for g in near)
    assert hits >= 0.9 * len(got)


def test_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
                                  (5, [2.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 0.5]), (200, [])],
                                 "vec_id bigint, vector array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in V.nearest(rows, rows.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.5), (0, 2, 5, 1.0), (0, 3, 5, 1.0), (100, 1, 0, 0.5), (100, 2, 0, 0.5), (100, 3, 5, 1.25 ** 0.5), (100, 4, 5, 1.25 ** 0.5)]
    assert V.nearest(rows.limit(0), rows.limit(0)).count() == 0
