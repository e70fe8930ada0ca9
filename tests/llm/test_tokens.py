"""Token counts and segment-tree BPE against the public library."""

import hashlib
import random

import public_tokenizers
import pytest
from corpora import corpus, frame
from tokenizers import Tokenizer

from fraudlens.llm import bpe as B
from fraudlens.llm import token_counts as T
from fraudlens.llm._pretokens import Splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=1500):
    r = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "1", "٣", "!", "'s", "'LL", "'ll", "<|endoftext|>", "<|endof", "漢", "🙂",
             "　", "\x85", "\xa0", "\x1c", "é", "the", "\x00", "²", "Ⅷ"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(50))) for _ in range(n)] + ["a" * 3000, "ab" * 500, " " * 700, "é" * 400, ""]


def test_encoder_equals_library(library):
    texts = odd_texts()
    e = B.Encoder(B.Vocabulary(B.read_file(PATH)))
    ids, count = e.encode(texts)
    at = 0
    for t, n, want in zip(texts, count, library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at:at + n].tolist() == want.ids, t
        at += n
    assert e.decode(ids, count) == library.decode_batch([x.ids for x in library.encode_batch(texts, add_special_tokens=False)], skip_special_tokens=False)
    with pytest.raises(ValueError):
        e.decode(B.np.array([60_000]), B.np.array([1]))


def test_every_code_point_is_cut_as_in_the_library(library):
    e = B.Encoder(B.Vocabulary(B.read_file(PATH)))
    texts = [f"a{c}b {c}{c} 1{c}2\n{c} .{c}," for c in map(chr, (*range(1, 0x3100), *range(0x1F600, 0x1F680)))]
    ids, count = e.encode(texts)
    assert ids.tolist() == [i for x in library.encode_batch(texts, add_special_tokens=False) for i in x.ids]
    assert len(count) == len(texts)


def test_cache_can_overflow(monkeypatch, library):
    monkeypatch.setattr(B, "CACHE", 10)
    monkeypatch.setattr(T, "CACHE", 10)
    e, c = B.Encoder(B.Vocabulary(B.read_file(PATH))), T.Counts(B.read_file(PATH), {"the": 1})
    for lo in range(0, 200, 20):
        texts = odd_texts()[lo:lo + 20]
        want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts)[1].tolist() == want == c.texts(texts).tolist()


def test_queries_on_edges(spark, library):
    rows = corpus()
    docs = frame(spark, rows, extra=["ids", "n_tokens", "decoded", "part"])
    want = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows}
    got = B.encode(docs.drop("decoded"), PATH, decoded="decoded").collect()
    assert len(got) == len(rows) and all(list(r.ids) == want[r.text] and r.decoded == (r.text or "") for r in got)
    back = B.decode(B.encode(docs, PATH).select("text", "ids"), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    counts = T.token_counts(docs, PATH, limit=50).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted(
        (len((t or "").encode()), len(want[t]), len(want[t]) > 50) for _, t, *_ in rows)
    assert B.encode(docs.limit(0), PATH).count() == T.token_counts(docs.limit(0), PATH).count() == 0


def test_registered_query_digests(spark, sf, library):
    import __spark_entry__ as E
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in E.queries()["op10_bpe_segment_tree"](spark, sf).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_splitter_without_added_tokens():
    assert Splitter({})("a <|endoftext|> b's") == ["a", " <|", "endoftext", "|>", " b", "'s"]
