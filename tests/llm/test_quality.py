"""The quadratic discriminant: against a plain computation, held-out accuracy, edges."""

import zlib

import numpy as np
from corpora import corpus, frame

from fraudlens.llm import quality as Q


def test_held_out_accuracy(spark, sf):
    import __spark_entry__ as E
    got = E.queries()["op1_quality_discriminant"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (m.predicted == m.quality).mean() > 0.95
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))


def test_fit_is_the_shrunk_gaussian_pair(spark):
    r = np.random.default_rng(0)
    d = len(Q.STATISTICS)
    x = np.concatenate((r.normal(0, 1, (60, d)), r.normal(2, 0.5, (90, d))))
    y = [0] * 60 + [1] * 90
    m = Q.fit(spark.createDataFrame([(k, v.tolist()) for k, v in zip(y, x)], "label int, x array<double>"), pooled=0.2, ridge=0.1)
    covs = [np.cov(x[np.array(y) == k].T, bias=True) for k in (0, 1)]
    pool = (60 * covs[0] + 90 * covs[1]) / 150
    probe = r.normal(1, 1, (5, d))
    logs = []
    for k, n in ((0, 60), (1, 90)):
        s = 0.9 * (0.8 * covs[k] + 0.2 * pool) + 0.1 * np.trace(pool) / d * np.eye(d)
        c = probe - x[np.array(y) == k].mean(axis=0)
        logs.append(np.log(n / 150) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", c, np.linalg.inv(s), c))
    assert np.allclose(m.log_odds(probe), logs[1] - logs[0])


def test_edges(spark):
    docs = frame(spark, corpus(), extra=["x", "score", "label"])
    labels = spark.createDataFrame([(i, i % 2, "junk") for i in range(24)] + [(30, None, "a"), (31, 7, "b")], "doc_id bigint, quality int, lang string")
    got = Q.quality_scores(docs, labels).toPandas()
    assert len(got) == len(corpus()) and got.score.between(0, 1).all()
    assert set(got.columns) >= {"doc_id", "held_out", "score", "predicted"}
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert set(Q.quality_scores(docs, labels.limit(0)).toPandas().score) == {0.5}
    assert set(Q.quality_scores(docs, labels.filter("quality = 1")).toPandas().score) == {0.99}


def test_statistics_ignore_block_borders():
    texts = [b"", b" ", b"a", "é ü".encode(), b"A! b* c", b"x " * 500, b"word\nword word"]
    assert np.allclose(Q.statistics(texts), np.concatenate([Q.statistics([t]) for t in texts]))
