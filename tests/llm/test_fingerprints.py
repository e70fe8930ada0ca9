"""Order MinHash against a direct computation of its properties."""

import hashlib
import random

from corpora import corpus, frame, words

from fraudlens.llm import fingerprints as P
from pyspark.sql import functions as F


def test_edited_texts_and_likeness(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] not in (80, 81)]
    got = {r.doc_id: r for r in P.document_fingerprints(frame(spark, rows, extra=["print", "range", "edited_text"])).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, *_) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        want = t[:len(t) - len(t) // 2] + follow[:len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_text) == (len(t), want)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == want:
            assert r.near_edited == 1.0
    assert got[50].fingerprint == got[51].fingerprint != got[73].fingerprint
    assert got[70].fingerprint == got[71].fingerprint == got[72].fingerprint == []
    family = [got[i].near_next for i in range(31, 42)]
    assert min(family) > 0.3 and max(got[i].near_next for i in range(1, 24)) < 0.1


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, corpus())
    got = P.document_fingerprints(docs).collect()
    assert len(got) == len(corpus())
    assert P.document_fingerprints(docs.limit(0)).count() == 0
    one = P.document_fingerprints(docs.filter("doc_id = 75")).collect()
    assert one[0].edited_text == "two wtwo " and one[0].near_next == 1.0
    assert P.document_fingerprints(docs.filter("doc_id IS NULL")).count() == 2


def test_pairs_are_numbered_and_ordered(spark):
    """A plain computation of the coordinates from Spark's hash of each k-mer."""
    texts = [" ".join(words(50, 1, 12)), "a a a a a a", " ".join(words(300, 2)), "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hashes = df.select(F.expr("""transform(sequence(0, greatest(size(split(text, ' ')) - 3, 0)), i ->
        xxhash64(get(split(text, ' '), i), get(split(text, ' '), i + 1), get(split(text, ' '), i + 2)))""").alias("h"),
        P.order_minhash(F.col("text"), keep=1).alias("got")).collect()
    low, full = (1 << 24) - 1, (1 << 64) - 1
    for h, got in hashes:
        seen, pairs = {}, []
        for place, x in enumerate(h):
            x = x & full & ~low
            seen[x] = seen.get(x, 0) + 1
            if seen[x] == 1:
                pairs.append(x | place)
        firsts = {}
        for p in sorted(pairs):
            firsts.setdefault(p >> 58, p)
        mine = {g & 63: g for g in got}
        assert set(firsts) <= set(mine)
        if len(set(h)) == len(h):
            assert set(firsts) == set(mine)


def test_order_and_occurrences_matter(spark):
    w = words(80, 4, 10_000)
    texts = [" ".join(w), " ".join(w[40:] + w[:40]), " ".join(w + w)]
    a, b, c = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(P.order_minhash(F.col("text"))).collect()]
    share = [len(set(a) & set(x)) / 64 for x in (a, b, c)]
    assert share[1] < 0.9 and share[2] < 0.9
    assert hashlib.sha256(str(a).encode()) != hashlib.sha256(str(b).encode())


def test_an_inserted_character_in_an_unspaced_text(spark):
    r = random.Random(2)
    for letters in (range(0x61, 0x7B), range(0x4E00, 0x4F00), range(0x1F300, 0x1F400)):
        t, other = ("".join(chr(r.choice(letters)) for _ in range(3000)) for _ in range(2))
        spaced = "".join(f"{w} " for w in words(300, 8, 10_000))
        texts = [t, t[:20] + "x" + t[20:], other, t[:1500] + spaced[:1500]]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").select("i", P.order_minhash(F.col("text")).alias("p")).cache()
        like = dict(df.alias("a").join(df.filter("i = 0").alias("b")).select("a.i", P.likeness(F.col("a.p"), F.col("b.p"))).collect())
        assert like[0] == 1.0 and like[1] > 0.8 and like[2] < 0.1
        assert like[3] > 0.05  # half of the text is the same: 0.46 of all k-mers, squared for two a coordinate
