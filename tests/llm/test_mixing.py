"""Mixing: targets against the repeated resharing, words taken, permutations, edges."""

from collections import Counter, defaultdict

from corpora import WORD, corpus, frame
from pyspark.sql import functions as F

from fraudlens.llm import mixing as M


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        w = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / w for s in names if s not in full}
        over = [s for s in share if share[s] > 2 * sizes[s]]
        if not over:
            return share | full
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_targets_and_taken(spark):
    rows = corpus()
    docs = frame(spark, rows, extra=["key", "size", "name", "target"])
    got = M.mixed_documents(docs, block=16, shard_words=500).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    assert sorted(Counter((r.doc_id, r.size) for r in got).items(), key=str) == sorted(
        Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows).items(), key=str)
    taken, target = defaultdict(int), {}
    source_of = {(i, len(WORD.findall(t or ""))): s for i, t, _, s in rows}
    for r in got:
        s = source_of[r.doc_id, r.size]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s]
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in want)
    again = M.mixed_documents(docs, block=16, shard_words=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert M.mixed_documents(docs.limit(0)).count() == 0
    assert {r.taken for r in M.mixed_documents(docs.filter("text IS NULL")).collect()} == {0}


def test_corpus_holds_the_taken_words(spark):
    docs = frame(spark, corpus()).filter("doc_id IS NOT NULL")
    want = {}
    for r in M.mixed_documents(docs, block=16).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    got = Counter()
    texts = defaultdict(set)
    for i, t, *_ in corpus():
        texts[i].add(t)
    for r in M.mixed_corpus(docs, block=16).collect():
        n = len(WORD.findall(r.text))
        got[r.doc_id] += n
        assert r.n_chars == len(r.text)
        assert r.text in texts[r.doc_id] or any(n < len(WORD.findall(t or "")) for t in texts[r.doc_id])
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_permutations(spark):
    for n in (1, 2, 3, 5, 16, 17, 100, 1000, 4097):
        got = spark.range(n).select(M._permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(7).cast("bigint")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_slots_are_a_draw_over_shards(spark):
    targets = spark.createDataFrame([("a", 100_000, 150_000.0), ("b", 1000, 700.0)], "source string, source_size bigint, target double")
    slots = M.place_slots(targets, block=100, shard_words=15_000, seed=1).toPandas()
    assert slots.groupby("name").words.sum().to_dict() == {"=a": 150_000, "=b": 700}
    per = slots[slots.name == "=a"].groupby("shard").size()
    assert len(per) == 11 and per.min() > 80 and per.std() > 0
    assert slots.groupby(["name", "pass"]).block_no.apply(lambda x: x.is_unique).all()
