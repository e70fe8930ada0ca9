import hashlib
from collections import defaultdict

import numpy as np
import pytest
from corpora import corpus, frame
from pyspark.sql import functions as F

from fraudlens.llm import exact_duplicates as X


def plain(rows, largest=True, normalise=lambda t: t):
    """(doc_id, sha256, keep_id, group_size, kept) of every row, by the definition."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normalise(t or "")].append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[normalise(t or "")]
        ids = [x for x in own if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((i, hashlib.sha256(normalise(t or "").encode()).hexdigest(), keep, len(own), i == keep))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


ROWS = corpus() + [(1000 + i, "hot copy", "en", "s0") for i in range(300)] + [(3, "x" * 300_000, None, None), (4, "x" * 300_000, None, None)] \
    + [(i, f"t{i % 70}", None, None) for i in range(2000, 2400)] + [(None, "only null", None, None)] * 2 + [(-5, "neg", None, None), (-9, "neg", None, None)]


@pytest.mark.parametrize("largest", [True, False])
def test_equal_to_the_definition(spark, largest):
    docs = frame(spark, ROWS, extra=("name", "id", "n", "node"))
    got = X.exact_duplicates(docs, largest=largest)
    assert told(got) == plain(ROWS, largest)
    assert set(docs.columns) < set(got.columns)


def test_many_rounds_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 8)  # 100 nodes and more, so three rounds
    monkeypatch.setattr(X, "RUN", 50)
    docs = frame(spark, ROWS).repartition(9)
    assert len(X.radices(-(-len(ROWS) // 8))) == 3
    assert told(X.exact_duplicates(docs)) == plain(ROWS)


@pytest.mark.parametrize("nodes", [2, 20, 100])
def test_copies_are_found_after_any_number_of_rounds(spark, monkeypatch, nodes):
    monkeypatch.setattr(X, "tasks", lambda spark: nodes)
    rows = [(i, f"text {i % 5}", None, None) for i in range(20)]
    assert told(X.exact_duplicates(frame(spark, rows).repartition(4))) == plain(rows)


def test_one_row_of_each_text_stays(spark):
    docs = frame(spark, ROWS)
    got = X.without_exact_duplicates(docs).collect()
    texts = [r.text or "" for r in got]
    assert len(texts) == len(set(texts)) and set(texts) == {t or "" for _, t, *_ in ROWS}
    keep = {t or "": max((i for i, u, *_ in ROWS if (u or "") == (t or "") and i is not None), default=None) for _, t, *_ in ROWS}
    assert all(r.doc_id == keep[r.text or ""] for r in got)


def test_normalised_texts(spark):
    rows = [(1, "A  b", "", ""), (2, "a b", "", ""), (3, "a c", "", ""), (4, None, "", ""), (5, "", "", "")]
    got = X.exact_duplicates(frame(spark, rows), normalise=lambda c: F.regexp_replace(F.lower(c), " +", " "))
    assert told(got) == plain(rows, True, lambda t: " ".join(t.lower().split()))


def test_equal_sha256_is_verified():
    name = np.zeros(4, dtype=X._NAME)
    name["a"] = 7
    name["check"] = [1, 2, 1, 1]
    name["length"] = [3, 3, 3, 4]
    own, ids, counts = X.merged(name, np.array([5, 6, 9, 8]), np.ones(4, dtype=np.int64))
    assert sorted(zip(own["length"].tolist(), own["check"].tolist(), ids.tolist(), counts.tolist())) == [(3, 1, 9, 2), (3, 2, 6, 1), (4, 1, 8, 1)]


@pytest.mark.parametrize("nodes", [1, 2, 8, 9, 63, 64, 65, 211, 1000, 5000])
def test_rounds_bring_every_digest_to_one_node(nodes):
    sizes = X.radices(nodes)
    total = int(np.prod(sizes))
    assert nodes <= total <= 2 * nodes + 8 and all(f <= X.FAN for f in sizes)
    if not sizes:
        return
    name = np.zeros(500, dtype=X._NAME)
    name["a"] = np.random.default_rng(nodes).integers(0, 1 << 64, 500, dtype=np.uint64)
    at = defaultdict(set)
    for node in {0, total - 1, total // 2}:
        runs = {node: X.merged(name, np.arange(500), np.ones(500, dtype=np.int64))}
        for r in range(len(sizes)):
            parts = [row for k, e in runs.items() for row in X._cut(e, k, sizes, r)]
            runs = {k: X._entries(X.pa.Table.from_batches([X._rows([p for p in parts if p[0] == k])])) for k in {p[0] for p in parts}}
        for k, (own, *_) in runs.items():
            for a in own["a"].tolist():
                at[a].add(k)
    assert len(at) == 500 and all(len(k) == 1 for k in at.values())


def test_no_rows_and_clashes(spark):
    assert X.exact_duplicates(frame(spark, [])).count() == 0
    assert X.without_exact_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        X.exact_duplicates(frame(spark, [], extra=("kept",)))
