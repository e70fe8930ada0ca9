"""The stages of the corpus pipeline, each built on one operator.

Each takes (spark, docs, sf_dir) and works on every row of ``docs``; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm._tables import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in their text stay, with the predicted language as lang,
    however close the languages are to each other on a short text; if no language can
    be learnt, with the lang they have.  Those without text or without a letter go."""
    from fraudlens.llm.language import UNKNOWN, identify, learn
    ship(spark)
    trees = learn(docs.select("doc_id", "text", "lang"))
    if trees is None:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    told = identify(docs.select(*COLUMNS), trees)
    return told.filter(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, shingle: int = 2) -> DataFrame:
    """One document of each class of near duplicates, by sets of ``shingle`` words, stays,
    that of the least id."""
    from fraudlens.llm.near_duplicates import without_near_duplicates
    ship(spark)
    return without_near_duplicates(docs.select(*COLUMNS), shingle=shingle)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages of 13 words or more that a document of a smaller id has;
    a text without any stays as it is, a document that loses every word goes."""
    from fraudlens.llm.repeats import without_repeats
    ship(spark)
    told = without_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return (told.filter("n_words = 0 OR n_removed < n_words").withColumn("text", text)
            .withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their targets: a row for each pass that takes words of
    a document."""
    from fraudlens.llm.mixing import mixed_corpus
    ship(spark)
    return mixed_corpus(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of every row."""
    import public_tokenizers

    from fraudlens.llm.bpe import encode
    ship(spark)
    told = encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return told.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
