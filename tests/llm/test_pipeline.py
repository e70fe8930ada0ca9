"""The pipeline against its stages' brute-force versions, stage by stage, and as a whole."""

from collections import Counter

import pytest
from corpora import WORD, corpus, frame
from test_near_duplicates import plain_components
from test_repeats import plain

import corpus_pipeline
from fraudlens.llm import stages


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    frame(spark, corpus()).write.parquet(f"{top}/documents.parquet")
    return top


def test_stages_have_the_columns_and_the_work(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    told = stages.language_id(spark, docs, tables)
    assert told.columns == docs.columns
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in told.collect()]
    gone = Counter((i, t) for i, t, *_ in corpus()) - Counter((i, t) for i, t, *_ in rows)
    assert set(gone) == {(70, None), (71, ""), (72, " \t\n "), (76, "1234 !!"), (None, None)}

    deduped = stages.near_dedup(spark, frame(spark, rows), tables)
    assert deduped.columns == docs.columns
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in deduped.collect()]
    # one row a class; 81 names two unlike texts
    assert sorted(str(r[0]) for r in kept) == sorted([*{str(c) for _, _, c in plain_components(rows)}, "81"])

    cut = stages.substring_dedup(spark, frame(spark, kept), tables)
    assert cut.columns == docs.columns
    want = Counter()
    for (i, t, *_), (_, n, removed, left) in zip(kept, plain(kept)):
        if removed < n or not n:
            want[i, left if removed else t] += 1
    left = cut.collect()
    assert Counter((r.doc_id, r.text) for r in left) == want and all(r.n_chars == len(r.text) for r in left)

    mixed = stages.source_mix(spark, cut, tables)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in left)
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed.collect()) - 1.5 * words) <= 4


def test_language_id_keeps_short_clean_texts(spark, tables):
    """A word that six languages share alike has a posterior of a sixth in each."""
    rows = [(i, "hotel taxi radio", f"l{i % 6}", "s") for i in range(60)] + [(100, "hotel", None, "s"), (101, "123", None, "s")]
    got = stages.language_id(spark, frame(spark, rows), tables).collect()
    assert {r.doc_id for r in got} == {*range(60), 100} and all(r.lang for r in got)


def test_language_id_without_any_lang(spark, tables):
    rows = [(1, "a clean text", None, "s"), (2, "naïve 漢字", None, "s"), (3, "12 !", None, "s"), (4, None, None, "s"), (5, "", None, "s")]
    got = stages.language_id(spark, frame(spark, rows), tables)
    assert got.columns == stages.COLUMNS and {(r.doc_id, r.lang) for r in got.collect()} == {(1, None), (2, None)}


def test_near_dedup_works_on_five_words(spark, tables):
    """Texts of 100 words that differ in 5 scattered ones (2-word sets: 0.817, five-word
    sets: 0.587) are no copies; those that differ in the last word are."""
    base = [f"u{i}" for i in range(100)]
    far = ["x" if i % 20 == 10 else w for i, w in enumerate(base)]
    rows = [(i, " ".join(w), "en", "s") for i, w in enumerate((base, far, base[:-1] + ["y"], far[:-1] + ["z"]))]
    five = [{tuple(t.split()[i:i + 5]) for i in range(96)} for _, t, *_ in rows]
    like = [[len(a & b) / len(a | b) for b in five] for a in five]
    want = [i for i in range(4) if not any(like[i][j] >= 0.8 for j in range(i))]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = stage(spark, frame(spark, rows), tables)
    assert sorted(r.doc_id for r in got.collect()) == want == [0, 1]


def test_run_ends_in_token_ids(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, tables).collect()
    assert got and all(r.n_tokens == len(r.ids) > 0 for r in got)
    texts = {i: t for i, t, *_ in corpus()}
    whole = [r for r in got if library.decode(r.ids, skip_special_tokens=False) == texts.get(r.doc_id)]
    assert len(whole) > len(got) / 3


def test_empty_documents(spark, tmp_path):
    frame(spark, corpus()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
