"""PPM: code lengths against a direct computation, accuracy, edges."""

import math
from collections import defaultdict

import numpy as np
from corpora import corpus, frame
from pyspark.sql import functions as F

from fraudlens.llm import language as L


def plain_nats(train, text, order):
    seen = defaultdict(lambda: defaultdict(int))
    for t in train:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[k, t[i - k:i]][t[i]] += 1
    total, t = 0.0, b"\n" * order + text
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            here = seen.get((k, t[i - k:i]))
            if not here:
                continue
            n, d = sum(here.values()), len(here)
            if t[i] in here:
                total -= math.log(here[t[i]] / (n + d))
                break
            total -= math.log(d / (n + d))
        else:
            total += math.log(256)
    return total


def test_code_lengths_equal_the_definition():
    train = {"a": ["le chat est là".encode(), b"la la la"], "b": [b"the cat is there", b"x"]}
    order = 2
    code, lang, count = [], [], []
    for i, v in enumerate(train):
        c, n = np.unique(L._codes(train[v], order)[0], return_counts=True)
        code.append(c), lang.append(np.full(len(c), i)), count.append(n)
    trees = L.build(list(train), np.concatenate(code), np.concatenate(lang), np.concatenate(count), order)
    texts = [b"the chat", b"", b"zzz", "là là\nx".encode(), b"la" * 300]
    got = L.code_lengths(trees, texts)
    want = [[plain_nats(train[v], t, order) for v in train] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_held_out_accuracy(spark, sf):
    import __spark_entry__ as E
    got = E.queries()["op6_language_ppm"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(docs, on="doc_id")
    assert len(m) == len(docs) and (m[m.held_out].lang_pred == m[m.held_out].lang).mean() > 0.9


def test_edges(spark):
    docs = frame(spark, corpus(), extra=["score", "lang_pred", "held_out"])
    got = L.language_predictions(docs).toPandas()
    assert len(got) == len(corpus()) and got.score.between(0, 1).all()
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id").lang_pred
    assert all(by[i] == "und" for i in (70, 71, 72, 76)) and by[75] in {"en", "de", "fr"}
    assert L.language_predictions(docs.limit(0)).count() == 0
    assert set(L.language_predictions(docs.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}
