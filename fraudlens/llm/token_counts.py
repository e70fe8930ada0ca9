"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of the token counts of frequent pre-tokens, made
from a bounded sample and broadcast (at most ``frequent`` entries of at most
``LONGEST`` characters).  Tier two is a cache in each worker of what tier one lacks,
filled by encoding the missing pre-tokens with the public library, and emptied at
``CACHE`` entries.  No pre-token is ever shuffled, and the counts do not depend on
the sample, which only decides what is found at once.

Defined cases: a null or empty text has 0 bytes and 0 tokens; strings of added tokens
inside a text count one each, as the library's default has it; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm._pretokens import Splitter, added_tokens, parse
from fraudlens.llm._words import as_bytes, blocks

CACHE = 300_000
LONGEST = 32


class Counts:
    """Token counts of pre-tokens: the frequent ones, then the cache, then the library."""

    def __init__(self, file_text: str, frequent: dict[str, int]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file_text)
        added = added_tokens(parse(file_text))
        self.split = Splitter(added)
        self.frequent = frequent
        self.cache: dict[str, int] = {}

    def of(self, parts: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        found = list(map(self.frequent.get, parts))
        if None in found:
            missing = [i for i, n in enumerate(found) if n is None]
            new = [s for s in dict.fromkeys(parts[i] for i in missing) if s not in self.cache]
            if len(self.cache) + len(new) > CACHE:
                self.cache = {}
                new = list(dict.fromkeys(parts[i] for i in missing))
            for s, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
                self.cache[s] = len(e)
            cache = self.cache
            for i in missing:
                found[i] = cache[parts[i]]
        return np.array(found, dtype=np.int64)

    def texts(self, texts: list[str]) -> np.ndarray:
        parts = [self.split(t) for t in texts]
        total = np.concatenate(([0], np.cumsum(self.of(list(chain.from_iterable(parts))))))
        bound = np.cumsum([0] + [len(p) for p in parts])
        return total[bound[1:]] - total[bound[:-1]]


_counts: dict[str, Counts] = {}


def frequent_lengths(docs: DataFrame, file_text: str, frequent: int, sample_docs: int) -> dict[str, int]:
    """Token counts of the ``frequent`` commonest pre-tokens of about ``sample_docs``
    documents, chosen by a hash of the text."""
    rows = docs.count()
    if not rows:
        return {}
    place = F.pmod(F.xxhash64(F.col("text"), F.lit("frequent")), F.lit(1 << 30)) / float(1 << 30)
    split = Splitter(added_tokens(parse(file_text)))

    def tally(batches):
        n = Counter()
        for b in batches:
            for t in as_bytes(b.column("text")):
                n.update(s for s in split(t.decode("utf-8", "replace")) if len(s) <= LONGEST)
        top = n.most_common(2 * frequent)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())],
                                         names=["part", "n"])
    top = (docs.filter(place < min(1.0, sample_docs / rows)).select("text").mapInArrow(tally, "part string, n bigint")
           .groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(frequent).collect())
    parts = [r.part for r in top]
    return dict(zip(parts, map(int, Counts(file_text, {}).of(parts)))) if parts else {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, frequent: int = 20_000, sample_docs: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row."""
    with open(path, encoding="utf-8") as f:
        file_text = f.read()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = uuid.uuid4().hex  # of this table, in the workers
    table = docs.sparkSession.sparkContext.broadcast((file_text, frequent_lengths(docs, file_text, frequent, sample_docs)))

    def run(batches):
        if key not in _counts:
            _counts.clear()
            _counts[key] = Counts(*table.value)
        own = _counts[key]
        for b in batches:
            texts = as_bytes(b.column("text"))
            n = np.zeros(len(texts), dtype=np.int64)
            for lo, hi in blocks(texts):
                n[lo:hi] = own.texts([t.decode("utf-8", "replace") for t in texts[lo:hi]])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
