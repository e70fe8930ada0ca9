"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ``order``: in a context that
was seen with ``d`` different next bytes, ``t`` times in all, a byte seen ``c``
times costs ``-log(c / (t + d))``; an unseen byte costs the escape
``-log(d / (t + d))`` and is coded in the context shorter by one byte, at last
uniformly over 256 values.  A context never seen escapes for free.  Statistics are
frozen after learning; a text's code length is the exact sum over all its bytes
(line feeds stand before its first byte).  The shortest code wins, ties go to the
smaller language value; the score is the winner's posterior with equal priors.

Learning reads a bounded sample: about ``train_docs`` documents of each language
(whole texts, chosen by a hash of the id), which bounds the trees that are sent to
the tasks.  Every text is scored whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing can be learnt; documents with a null text or lang teach
nothing; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm._lookup import Table
from fraudlens.llm._tables import held_out
from fraudlens.llm._words import as_bytes, blocks

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts the code of it and the ``order`` bytes before it,
    and for each text the place of its first code."""
    pad = b"\n" * order
    raw = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.zeros(max(len(raw) - order, 0), dtype=np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | raw[k:len(raw) - order + k]
    keep = np.ones(len(code), dtype=bool)
    ends = np.cumsum(sizes + order) - order
    for k in range(order):  # codes that end in the padding of the next text
        at = ends + k
        keep[at[at < len(code)]] = False
    return code[keep], np.cumsum(sizes) - sizes


@dataclass
class Trees:
    """The context trees of all languages, by order: log-probabilities of the seen
    (context, byte) codes and log-escapes of the contexts, a column a language."""

    languages: list[str]
    seen: list[tuple[Table, np.ndarray]]
    escape: list[tuple[Table, np.ndarray]]

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code of the highest order."""
        top = len(self.seen) - 1
        row = self.seen[top][0].find(codes)
        out = self.seen[top][1][row]
        todo = np.flatnonzero(row < 0)
        out[todo] = 0
        for k in range(top, -1, -1):
            if not len(todo):
                return out
            own = codes[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            if k < top:
                row = self.seen[k][0].find(own)
                hit = row >= 0
                out[todo[hit]] += self.seen[k][1][row[hit]]
                todo, own = todo[~hit], own[~hit]
            row = self.escape[k][0].find(own >> np.uint64(8))
            hit = row >= 0
            out[todo[hit]] += self.escape[k][1][row[hit]]
        out[todo] += np.float32(-np.log(256))
        return out


def build(languages: list[str], code: np.ndarray, lang: np.ndarray, count: np.ndarray, order: int) -> Trees:
    """Trees from the counts of the codes of the highest order (``lang``: index)."""
    m = len(languages)
    seen, escape, lower = [], [], None
    for k in range(order + 1):
        own, at = np.unique(code & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
        c = np.zeros((len(own), m))
        np.add.at(c, (at, lang), count)
        context, of = np.unique(own >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(context), m)), np.zeros((len(context), m))
        np.add.at(total, of, c)
        np.add.at(kinds, of, c > 0)
        free = total == 0
        esc = np.where(free, 0.0, np.log(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)))
        if k:
            below = lower[1][np.searchsorted(lower[0], own & np.uint64((1 << (8 * k)) - 1))]
        else:
            below = np.full((len(own), m), -np.log(256))
        p = np.where(c > 0, np.log(np.maximum(c, 1) / np.maximum((total + kinds)[of], 1)), esc[of] + below)
        lower = (own, p)
        seen.append((Table(own), p.astype(np.float32)))
        escape.append((Table(context), esc.astype(np.float32)))
    return Trees(languages, seen, escape)


def learn(docs: DataFrame, order: int = 3, train_docs: int = 500) -> Trees | None:
    """Learn from (doc_id, text, lang) of documents not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~held_out())
    share = {r.lang: min(1.0, train_docs / r.n)
             for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not share:
        return None
    languages = sorted(share, key=lambda v: v.encode())
    limit = F.lit(0.0)
    for v in languages:
        limit = F.when(F.col("lang") == v, share[v]).otherwise(limit)
    # A document's place in [0, 1) is a hash of its id: the same sample each time.
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    number = {v: i for i, v in enumerate(languages)}

    def grams(batches):
        for b in batches:
            texts, langs = as_bytes(b.column("text")), np.array([number[v] for v in b.column("lang").to_pylist()], dtype=np.int64)
            for k in np.unique(langs):
                code, _ = _codes([texts[i] for i in np.flatnonzero(langs == k)], order)
                value, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, dtype=np.int32)),
                                                  pa.array(value.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    # Bounded by the sample's bytes, not by the table.
    got = (known.filter(place < limit).select("text", "lang").mapInArrow(grams, "lang int, code bigint, n bigint")
           .groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas())
    if not len(got):
        return None
    return build(languages, got.code.to_numpy().astype(np.uint64), got.lang.to_numpy(), got.n.to_numpy(), order)


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Nats of each text under each language."""
    order, m = len(trees.seen) - 1, len(trees.languages)
    out = np.zeros((len(texts), m))
    for lo, hi in blocks(texts):
        own = texts[lo:hi]
        code, first = _codes(own, order)
        step = max(1 << 14, (1 << 20) // m)  # bounds the rows of log-probabilities held at once
        doc = np.repeat(np.arange(lo, hi), [len(t) for t in own])
        for s in range(0, len(code), step):
            p = trees.log_probability(code[s:s + step])
            d = doc[s:s + step]
            at = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            out[d[at]] -= np.add.reduceat(p, at, axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``docs`` (with its columns) plus lang_pred and score."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for b in batches:
            text = b.column("text")
            texts = as_bytes(text)
            letters = np.array([bool(t) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], dtype=bool)
            pred, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if trees is not None and letters.any():
                at = np.flatnonzero(letters)
                nats = code_lengths(trees, [texts[i] for i in at])
                best = nats.argmin(axis=1)
                pred[at] = np.array(trees.languages, dtype=object)[best]
                score[at] = 1 / np.exp(nats[np.arange(len(at)), best][:, None] - nats).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    return docs.mapInArrow(run, StructType([*schema.fields, StructField("lang_pred", StringType()),
                                            StructField("score", DoubleType())]))


def language_predictions(docs: DataFrame, order: int = 3, train_docs: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    trees = learn(docs.select("doc_id", "text", "lang"), order, train_docs)
    return (identify(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), trees)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))
