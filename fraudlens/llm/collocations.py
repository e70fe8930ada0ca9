"""Phrase collocations by vertical partitioning of the corpus' suffixes.

The suffixes of the word sequences (a piece of text between separators, cut after
``longest`` words) are dealt to groups by word prefixes of variable length: prefixes of
one word where few suffixes have it, of two, three or more where the counts over the
whole corpus say that one word more is needed to keep a group within the memory budget
``GROUP``.  Prefixes are counted by hash, in ``buckets`` counters a length (a number that
follows the corpus' size), so the plan of the groups is as large as the list of tasks.
Each group builds its subtree by itself: its suffixes are sorted as tuples of words, a
node of depth d is a run of suffixes that agree in d words, and its count is the total
of its leaves.  Nodes above a group's prefix length are met in several groups; their
partial counts are summed.

A word that occurs less often than ``least`` is in no phrase that does, so suffixes end
before it: the frequent words are kept in a bitmap of fixed size (2^23 bits by hash; a
false hit costs a suffix, not a wrong count).  Equal suffixes of a map task travel as one
entry, in packed blocks with a dictionary of the words as bytes: words are told apart by
themselves, never by a hash.

Cuts, scores and the dropping of contained phrases are joins on the counted phrases.

Defined cases: a null text has no words; a null lang is ``und``; a language, text or piece
with fewer words gives what it has; ties go to the phrase that comes first in UTF-8;
repeated rows count each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm._tables import materialize, tasks
from fraudlens.llm._words import as_bytes, mix

#: Suffixes of a group; bytes of text that a map task settles at once.
GROUP = 2_000_000
SETTLE = 8 << 20
BITS = 23
_FEWEST, _MOST = 1 << 12, 1 << 20
_SALTS = 64

# What ends a piece, what lies between words, and the letters that are lowered.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_NEXT = {k: re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % k) for k in range(16)}
_U = np.uint64


def _cuts(text: bytes, longest: int):
    """(words and separators, how many of them begin suffixes here) for each stretch of a
    text: of about SETTLE bytes, followed by the words its last suffixes reach into."""
    lo, text = 0, text.translate(_TABLE)
    while lo < len(text):
        hi = len(text)
        if hi - lo > SETTLE:
            ends = [x for x in (text.find(b" ", lo + SETTLE), text.find(b"\n", lo + SETTLE)) if x >= 0]
            hi = min(ends, default=hi)
        own = text[lo:hi].replace(b"\n", b" \n ").split(b" ")
        ahead = _NEXT[longest - 1].match(text, hi).group().replace(b"\n", b" \n ").split(b" ") if hi < len(text) else []
        yield own + ahead, len(own)
        lo = hi


class Block:
    """The words of some texts of one language: ``words`` (distinct, as bytes, in the order
    of their first places), ``at`` (the word of each place, -1: end of a piece) and
    ``begins`` (whether a suffix begins at a place; the others are looked into only)."""

    def __init__(self, parts: list[tuple[list[bytes], int]]):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        number[b""], number[b"\n"]  # noqa: B018 - the first two numbers
        at, begins = [], []
        for tokens, n in parts:
            own = np.fromiter(map(number.__getitem__, tokens), dtype=np.int32, count=len(tokens))
            keep = own > 0
            at += [own[keep], np.ones(1, dtype=np.int32)]
            begins += [np.arange(len(own))[keep] < n, np.zeros(1, dtype=bool)]
        self.words = list(number)[2:]
        self.at = np.concatenate(at) - 2 if at else np.zeros(0, dtype=np.int32)
        self.begins = np.concatenate(begins) & (self.at >= 0) if at else np.zeros(0, dtype=bool)

    def hashes(self, lang: str) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 17)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), dtype=np.uint64, count=len(self.words))

    def lengths(self, frequent: np.ndarray, longest: int) -> np.ndarray:
        """How many words the cut suffix of each place has: up to an end or a rare word."""
        good = np.append(self.at >= 0, False)
        good[:-1] &= frequent[self.at]
        n = len(self.at)
        stop = np.flatnonzero(~good)
        length = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
        return np.where(self.begins, np.minimum(length, longest), 0)

    def suffixes(self, length: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cut suffixes of ``least`` words or more (rows of word numbers, -1
        after the end), sorted by them, and how often each occurs."""
        start = np.flatnonzero(length >= least)
        long = np.concatenate((self.at, np.full(longest, -1, dtype=np.int32)))
        rows = np.stack([np.where(length[start] > k, long[start + k], -1) for k in range(longest)], axis=1) if len(start) \
            else np.zeros((0, longest), dtype=np.int32)
        return combined(rows, np.ones(len(rows), dtype=np.int64), len(self.words))


def combined(rows: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, counts
    bits = max(1, int(words).bit_length())
    keys: list[np.ndarray] = []
    for lo in range(0, rows.shape[1], 63 // bits):  # several words a sort key
        key = np.zeros(len(rows), dtype=np.uint64)
        for k in range(lo, min(lo + 63 // bits, rows.shape[1])):
            key = key << _U(bits) | (rows[:, k] + 1).astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    start = np.flatnonzero(new)
    return rows[order[start]], np.add.reduceat(counts[order], start)


def prefix_hashes(rows: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of the first 1, 2, .. words of each row, a column a length; past a row's end
    it stays as it is."""
    out = np.zeros(rows.shape, dtype=np.uint64)
    own = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        own = np.where(rows[:, k] >= 0, mix(own * _U(0x9E3779B97F4A7C15) + word[rows[:, k]]), own)
        out[:, k] = own
    return out


def _flushed(batches, longest: int):
    """(lang, Block) of about SETTLE bytes of text each, all texts of the batches."""
    have: dict[str, list] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), as_bytes(b.column("text"))):
            for part in _cuts(text, longest):
                have[lang].append(part)
                size[lang] += 8 * len(part[0])  # words of a block, whatever the bytes
            if size[lang] > SETTLE:
                yield lang, Block(have.pop(lang))
                size.pop(lang)
        if sum(size.values()) > SETTLE:  # many languages: all that waits
            for lang in list(have):
                yield lang, Block(have.pop(lang))
            size.clear()
    for lang in list(have):
        yield lang, Block(have.pop(lang))


def words_and_prefixes(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """lang, word, h (its hash) and n of every word of a task; and with a null word,
    ``places`` of prefixes: length, bucket and n."""
    def run(batches):
        counts = np.zeros((longest, buckets), dtype=np.int64)
        for lang, b in _flushed(batches, longest):
            h = b.hashes(lang)
            n = np.bincount(b.at[b.begins], minlength=len(b.words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array([b.words[i] for i in some], pa.binary()),
                 pa.array(h[some].view(np.int64)), pa.array(n[some]), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.int32())],
                names=["lang", "word", "h", "n", "length", "bucket"])
            rows, m = b.suffixes(b.lengths(np.ones(max(1, len(b.words)), dtype=bool), longest), 2, longest)
            if len(rows):
                for k, own in enumerate(prefix_hashes(rows, h).T):
                    counts[k] += np.bincount((own % _U(buckets)).astype(np.int64), minlength=buckets)
        length, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(length), pa.string()), pa.nulls(len(length), pa.binary()), pa.nulls(len(length), pa.int64()),
             pa.array(counts[length, bucket]), pa.array(length.astype(np.int32)), pa.array(bucket.astype(np.int32))],
            names=["lang", "word", "h", "n", "length", "bucket"])
    return docs.mapInArrow(run, "lang string, word binary, h bigint, n bigint, length int, bucket int")


class Prefixes:
    """The group of each suffix: by the shortest prefix whose counter is within the budget,
    by all its words where none is."""

    def __init__(self, counts: np.ndarray, least: int):
        self.longest, self.buckets = counts.shape
        total = max(1, int(counts[0].sum()))
        self.n = max(1, -(-total // GROUP), min(least, total))
        self.budget = max(1, min(GROUP, 2 * total // self.n))
        self.heavy = counts > self.budget
        load = [(0, g) for g in range(self.n)]
        self.group = np.full(counts.shape, -1, dtype=np.int32)
        used = ~self.heavy & (counts > 0)
        # a longer prefix is in use only below heavy ones; its counter is an upper bound then
        used[1:] &= np.logical_and.accumulate(self.heavy.any(axis=1))[:-1, None]
        for n, k, b in sorted(zip(counts[used].tolist(), *np.nonzero(used)), reverse=True):
            have, g = heapq.heappop(load)
            heapq.heappush(load, (have + (n if k == 0 else n * self._share(counts, k)), g))
            self.group[k, b] = g

    def _share(self, counts: np.ndarray, k: int) -> float:
        """The part of all suffixes that a heavy prefix of ``k`` words has."""
        return float(counts[k - 1][self.heavy[k - 1]].sum()) / max(1, int(counts[k - 1].sum()))

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, length of the prefix that decided it) of rows of prefix hashes."""
        group = (mix(hashes[:, -1]) % _U(self.n)).astype(np.int32)
        depth = np.full(len(hashes), self.longest, dtype=np.int8)
        left = np.ones(len(hashes), dtype=bool)
        for k in range(self.longest):
            bucket = (hashes[:, k] % _U(self.buckets)).astype(np.int64)
            own = left & (self.group[k, bucket] >= 0)
            group[own], depth[own] = self.group[k, bucket[own]], k + 1
            left &= ~own
        return group, depth


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return pa.compress(np.ascontiguousarray(raw.T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


_BLOCK = "grp int, lang string, depth int, n int, words binary, words_size int, n_words int, places binary, counts binary"


def packed(rows: np.ndarray, counts: np.ndarray, words: list[bytes], lang: str, group: int, depth: int) -> tuple:
    """A block of sorted suffixes: words once, joined by a space; places into them."""
    own, at = np.unique(rows, return_inverse=True)
    at = at.reshape(rows.shape).astype(np.int32) + int(own[0] >= 0)  # number 0 is the end
    own = own[own >= 0]
    text = b" ".join(words[i] for i in own)
    return (group, lang, depth, len(rows), pa.compress(text, codec="zstd", asbytes=True), len(text), len(own),
            _pack(np.ascontiguousarray(at.T).ravel().astype("<i4")), _pack(counts.astype("<i8")))


def unpacked(r: dict, longest: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    words = pa.decompress(r["words"], decompressed_size=r["words_size"], codec="zstd", asbytes=True).split(b" ") if r["n_words"] else []
    rows = _unpack(r["places"], r["n"] * longest, "<i4").reshape(longest, r["n"]).T - 1
    return rows, _unpack(r["counts"], r["n"], "<i8"), words


def suffix_blocks(docs: DataFrame, longest: int, bitmap: np.ndarray, groups: Prefixes) -> DataFrame:
    """The cut suffixes of all texts, packed, a row a block and group."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for lang, b in _flushed(batches, longest):
            if not b.words:
                continue
            h = b.hashes(lang)
            place = h >> _U(64 - BITS)
            frequent = (bitmap[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1).astype(bool)
            rows, counts = b.suffixes(b.lengths(frequent, longest), 2, longest)
            if not len(rows):
                continue
            group, depth = groups.of(prefix_hashes(rows, h))
            order = np.lexsort((depth, group))
            group, depth = group[order], depth[order]
            cut = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (depth[1:] != depth[:-1]))))
            out = [packed(rows[order[lo:hi]], counts[order[lo:hi]], b.words, lang, int(group[lo]), int(depth[lo]))
                   for lo, hi in zip(cut, np.append(cut[1:], len(order)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    return docs.mapInArrow(run, _BLOCK)


def subtree(parts: list[tuple[np.ndarray, np.ndarray, list[bytes]]], depth: int, least: int):
    """(phrase, words, count) of the nodes of a group's subtree from depth 2 on: those of
    ``depth`` and below with ``least`` leaves or more, those above it with any."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    rows, counts = [], []
    for own, n, words in parts:
        to = np.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)), np.int32(-1))
        rows.append(to[own])  # -1, the end, stays -1
        counts.append(n)
    words = list(number)
    rows, counts = combined(np.concatenate(rows), np.concatenate(counts), len(words))
    longest = rows.shape[1]
    same = np.ones(len(rows), dtype=bool)  # whether a leaf agrees with the one before in d words
    same[0] = False
    for d in range(1, longest + 1):
        same[1:] &= rows[1:, d - 1] == rows[:-1, d - 1]
        if d == 1:
            continue
        start = np.flatnonzero(~same)
        total = np.add.reduceat(counts, start)
        # a leaf that ends before depth d is a run of its own, as equal suffixes are one leaf
        node = (total >= (least if d >= depth else 1)) & (rows[start, d - 1] >= 0)
        for own, n in zip(rows[start[node], :d].tolist(), total[node].tolist()):
            yield b" ".join(words[w] for w in own), d, n


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of the phrases of 1 to ``longest`` words that occur ``least``
    times or more, and (lang, n) with the words of each language."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _FEWEST
    while buckets < _MOST and buckets * GROUP < 8 * size:
        buckets *= 2
    told = materialize(words_and_prefixes(docs, longest, buckets), "phrase-words")
    words = told.filter("length IS NULL").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    words = materialize(words, "phrase-vocabulary")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)

    counts = np.zeros((longest, buckets), dtype=np.int64)  # so many rows reach the driver
    for r in told.filter("length IS NOT NULL").groupBy("length", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["length"], r["bucket"]] = r["n"]
    bitmap = np.zeros(1 << BITS - 3, dtype=np.uint8)
    place = F.shiftrightunsigned("h", 64 - BITS)
    chunk = F.shiftright(place, 15)
    for r in frequent.groupBy(chunk.alias("chunk")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias("bits")).collect():  # 2^(BITS-15) rows
        bitmap[r["chunk"] << 12:(r["chunk"] + 1) << 12] = np.frombuffer(r["bits"], dtype=np.uint8)
    groups = Prefixes(counts, tasks(spark))
    blocks = suffix_blocks(docs, longest, bitmap, groups)

    def build(t: pa.Table) -> pa.Table:
        of: dict[tuple[str, int], list] = defaultdict(list)
        for r in t.to_pylist():
            of[r["lang"], r["depth"]].append(unpacked(r, longest))
        out = [(lang, *node) for (lang, depth), parts in of.items() for node in subtree(parts, depth, least)]
        lang, phrase, m, f = zip(*out) if out else [()] * 4
        return pa.table({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.binary()), "m": pa.array(m, pa.int32()), "f": pa.array(f, pa.int64())})
    nodes = blocks.groupBy("grp").applyInArrow(build, "lang string, phrase binary, m int, f bigint")
    found = nodes.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    one = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), F.col("n").alias("f"))
    phrases = materialize(found.unionByName(one).withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")
    return phrases, totals


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100) -> DataFrame:
    """lang, phrase, m (words), a, l, r, n, k (the lowest-scoring cut) and score of every
    candidate that no longer one with ``percent`` of its count contains.

    A phrase inside a longer one is inside one of one word more, which counts as often
    or more, so only those are looked at."""
    phrases, totals = phrase_counts(docs, longest, least)
    many = phrases.filter("m > 1")
    word = F.split("phrase", " ", -1)
    longer = many.filter("m > 2").select("lang", "f", F.explode(F.array(F.lit(1), F.lit(2))).alias("from"), word.alias("w"), "m")
    inside = (longer.select("lang", F.array_join(F.slice("w", F.col("from"), F.col("m") - 1), " ").alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("over")))
    own = (many.join(inside, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (100 * F.col("over") < percent * F.col("f")))
           .select("lang", "phrase", "m", F.col("f").alias("a")))
    cut = own.withColumn("w", word).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.select("lang", "phrase", "m", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    whole = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * __a * CAST(__n AS DECIMAL(15,0)) div (CAST(__l AS DECIMAL(19,0)) * __r)")
    cut = cut.withColumns(dict(zip(("__a", "__n", "__l", "__r"), whole))).withColumn("score", score)
    best = cut.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "m", "a", "cut.l", "cut.r", "n", "cut.k", "cut.score")


def top_collocations(docs: DataFrame, top: int = 2000, longest: int = 5, least: int = 100, percent: int = 100) -> DataFrame:
    """Each language's first ``top`` collocations by score, with rank from 1.  A language's
    phrases are ranked in parts first, so no task holds them all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = collocations(docs, longest, least, percent).withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    part = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).filter(F.col("rank") <= top)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return whole.drop("__salt")
