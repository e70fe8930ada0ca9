"""Removal of passages that repeat across documents, by hashes of word windows.

Every run of ``window`` words is a window, named by two hashes of its words, of 64 and of
32 bits.  It stands for a node of that depth of the corpus' suffix tree, which is not
built: no suffixes are sorted, and words are not compared, so windows of equal names are
taken as equal; two of a group's 2 million fall together by a chance of 3e-17.  Windows are split by their first word where few have it, by
all ``window`` words where many do, as counts over the whole corpus tell, and packed to
groups of about ``GROUP`` windows, which fit a task's memory; a group is sorted by
hash.  Of the windows of one hash, those in documents with a larger id than the least
one are marked; runs of marked windows, with the words they cover, leave.  Below, a
suffix is such a window, a node is a hash.

Suffixes travel in compressed blocks: a map task sorts those of some megabytes of
text, settles what repeats there (only suffixes of the least document of a node go
on), and sends each group one block.  A passage that a third of all documents share
is thus a few entries a map task.

Defined cases: a null text has no words; texts under ``window`` words stay whole; a
null doc_id counts as larger than any other; rows of one doc_id do not remove one
another's words (they are told apart by their text); other columns are kept as they
are; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from fraudlens.llm._tables import materialize, tasks
from fraudlens.llm._words import Words, as_bytes, blocks, mix

#: Suffixes of a group, bytes of text that a map task settles at once, and bytes of
#: text in a bucket of documents.
GROUP = 2_000_000
SETTLE = 8 << 20
BUCKET = 8 << 20
_PREFIXES = 4096
_LAST = (1 << 63) - 1


def _pack(values: np.ndarray) -> bytes:
    """Unsigned values, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return pa.compress(np.ascontiguousarray(raw.T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def _steps(positions: np.ndarray) -> bytes:
    return np.diff(positions, prepend=0).astype("<i4").tobytes()


def _positions(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<i4"))


def _suffixes(texts: list[bytes], window: int):
    """(text number, word position, prefix bucket, node name, its second name) of every
    deep suffix."""
    for lo, hi in blocks(texts):
        w = Words(texts[lo:hi])
        at, name = w.windows(window)
        doc = np.searchsorted(w.first, at, side="right") - 1
        bucket = (mix(w.hash[at]) >> np.uint64(52)).astype(np.int64)
        second = (w.windows(window, 1)[1] >> np.uint64(32)).astype(np.uint32)
        yield doc + lo, at - w.first[doc], bucket, name, second


def _by_name(name: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both names (rows of equal ones as they are) and where a node begins."""
    order = np.argsort(name, kind="stable")
    a, b = name[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, name))
        a, b = name[order], second[order]
    start = np.ones(len(a), dtype=bool)
    start[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, start


class Groups:
    """Which group a suffix belongs to, from the number of suffixes of each bucket."""

    def __init__(self, counts: np.ndarray, least: int):
        total = int(counts.sum())
        n = max(1, -(-total // GROUP), min(least, total))
        fair = max(1, total // n)
        load = [(0, i) for i in range(n)]
        self.first, self.parts = np.zeros(_PREFIXES, dtype=np.int64), np.ones(_PREFIXES, dtype=np.uint64)
        pieces = [(-(-int(c) // k), b, k) for b, c in enumerate(counts) for k in [max(1, -(-2 * int(c) // fair) if 2 * c > fair else 1)]]
        table: list[int] = []
        for size, b, k in sorted(pieces, reverse=True):  # largest first, each piece to the least loaded group
            self.first[b], self.parts[b] = len(table), k
            for _ in range(k):
                have, g = heapq.heappop(load)
                heapq.heappush(load, (have + size, g))
                table.append(g)
        self.table = np.array(table, dtype=np.int32)
        self.n = n

    def of(self, bucket: np.ndarray, name: np.ndarray) -> np.ndarray:
        """One word tells the group, or, if its bucket is split, all words of the window."""
        return self.table[self.first[bucket] + (mix(name) % self.parts[bucket]).astype(np.int64)]


def _prefix_counts(docs: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """The suffixes of each prefix bucket, and the bytes of text."""
    def run(batches):
        n = np.zeros(_PREFIXES + 1, dtype=np.int64)
        for b in batches:
            texts = as_bytes(b.column("text"))
            n[-1] += sum(map(len, texts))
            for _, _, bucket, _, _ in _suffixes(texts, window):
                n[:-1] += np.bincount(bucket, minlength=_PREFIXES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PREFIXES + 1, dtype=np.int32)), pa.array(n)], names=["bucket", "n"])
    out = np.zeros(_PREFIXES + 1, dtype=np.int64)  # that many rows reach the driver
    for r in docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


_BLOCK = "grp int, docs binary, n_docs int, names binary, seconds binary, places binary, n int, id bigint, tag int, marks binary"
_BLOCK_TYPES = [pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _settle(texts: list[bytes], ids: np.ndarray, tags: np.ndarray, groups: Groups, window: int) -> list[tuple]:
    """The blocks of some texts, a row a group, and the marks already known, a row a text."""
    order = np.argsort(ids, kind="stable")
    texts, ids, tags = [texts[i] for i in order], ids[order], tags[order]
    parts = list(_suffixes(texts, window))
    if not parts:
        return []
    doc, pos, bucket, name, second = (np.concatenate(x) for x in zip(*parts))
    del parts
    if not len(doc):
        return []
    doc, pos, group = doc.astype(np.uint32), pos.astype(np.uint32), groups.of(bucket, name)
    order, start = _by_name(name, second)  # of a node, texts in order of their ids
    name, second, doc, pos, group = name[order], second[order], doc[order], pos[order], group[order]
    least = ids[doc[start]][np.cumsum(start) - 1]
    known = ids[doc] > least
    rows = []
    if known.any():
        d, p = doc[known], pos[known]
        o = np.lexsort((p, d))
        d, p = d[o], p[o]
        cut = np.flatnonzero(np.diff(d, prepend=-1 if len(d) == 0 else int(d[0]) - 1))
        for lo, hi in zip(cut, np.append(cut[1:], len(d))):
            k = int(d[lo])
            rows.append((k % groups.n, None, None, None, None, None, None, int(ids[k]), int(tags[k]), _steps(p[lo:hi].astype(np.int64))))
    name, second, doc, pos, group = (x[~known] for x in (name, second, doc, pos, group))
    order = np.argsort(group, kind="stable")
    name, second, doc, pos, group = name[order], second[order], doc[order], pos[order], group[order]
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(group))):
        own, number = np.unique(doc[lo:hi], return_inverse=True)
        head = np.concatenate((np.diff(ids[own], prepend=0).view(np.uint64), tags[own].astype(np.int64).view(np.uint64)))
        place = np.concatenate((number.astype(np.uint32), pos[lo:hi]))
        rows.append((int(group[lo]), _pack(head), len(own), _pack(np.diff(name[lo:hi], prepend=np.uint64(0))),
                     _pack(second[lo:hi]), _pack(place), int(hi - lo), None, None, None))
    return rows


def _marks(t: pa.Table, buckets: int) -> pa.Table:
    """Of a group the marks, a row for each bucket of documents: (id, tag, position) of
    the suffixes that repeat in a document of a smaller id."""
    ids, tags, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.uint32)]
    names, seconds, doc_id, doc_tag, pos = [], [], [], [], []
    for r in t.to_pylist():
        if r["marks"] is not None:
            p = _positions(r["marks"])
            ids.append(np.full(len(p), r["id"], dtype=np.int64))
            tags.append(np.full(len(p), r["tag"], dtype=np.int32))
            at.append(p.astype(np.uint32))
            continue
        n, k = r["n"], r["n_docs"]
        head = _unpack(r["docs"], 2 * k, np.uint64).view(np.int64)
        place = _unpack(r["places"], 2 * n, np.uint32)
        names.append(np.cumsum(_unpack(r["names"], n, np.uint64), dtype=np.uint64))
        seconds.append(_unpack(r["seconds"], n, np.uint32))
        doc_id.append(np.cumsum(head[:k])[place[:n]])
        doc_tag.append(head[k:][place[:n]].astype(np.int32))
        pos.append(place[n:])
    if names:
        own, tag, places = (np.concatenate(x) for x in (doc_id, doc_tag, pos))
        order, begins = _by_name(np.concatenate(names), np.concatenate(seconds))
        start = np.flatnonzero(begins)
        least = np.repeat(np.minimum.reduceat(own[order], start), np.diff(np.append(start, len(own))))
        hit = order[own[order] > least]
        ids.append(own[hit])
        tags.append(tag[hit])
        at.append(places[hit])
    ids, tags, at = np.concatenate(ids), np.concatenate(tags), np.concatenate(at)
    to = tags % buckets
    order = np.lexsort((at, ids, tags, to))
    ids, tags, at, to = ids[order], tags[order], at[order], to[order]
    cut = np.flatnonzero(np.diff(to, prepend=-1))
    rows = list(zip(cut, np.append(cut[1:], len(to))))
    return pa.table({"bucket": pa.array(to[cut], pa.int32()), "n": pa.array([int(hi - lo) for lo, hi in rows], pa.int32()),
                     "ids": pa.array([_pack(np.diff(ids[lo:hi], prepend=0)) for lo, hi in rows], pa.binary()),
                     "tags": pa.array([_pack(tags[lo:hi]) for lo, hi in rows], pa.binary()),
                     "places": pa.array([_pack(np.diff(at[lo:hi].astype(np.int32), prepend=np.int32(0))) for lo, hi in rows], pa.binary())})


def repeat_marks(docs: DataFrame, window: int) -> tuple[DataFrame, int]:
    """The marks of rows (id, tag, text), packed by bucket of documents (the tag modulo
    their number), and the number of buckets."""
    counts, size_ = _prefix_counts(docs, window)
    groups = Groups(counts, tasks(docs.sparkSession))
    buckets = max(tasks(docs.sparkSession), -(-size_ // BUCKET))

    def run(batches):
        texts, ids, tags, size = [], [], [], 0

        def flush():
            rows = _settle(texts, np.array(ids, dtype=np.int64), np.array(tags, dtype=np.int64), groups, window)
            if rows:
                names = [c.split()[0] for c in _BLOCK.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _BLOCK_TYPES)], names=names)
        for b in batches:
            for t, i, g in zip(as_bytes(b.column("text")), b.column("id").to_pylist(), b.column("tag").to_pylist()):
                if size and size + len(t) > SETTLE:
                    yield from flush()
                    texts, ids, tags, size = [], [], [], 0
                texts.append(t)
                ids.append(i)
                tags.append(g)
                size += len(t)
        if texts:
            yield from flush()
    marks = docs.select("id", "tag", "text").mapInArrow(run, _BLOCK).groupBy("grp").applyInArrow(
        lambda t: _marks(t, buckets), "bucket int, n int, ids binary, tags binary, places binary")
    return materialize(marks, "repeat-marks"), buckets


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with n_words, n_removed, kept (the words that stay, joined by a space)
    and repeats (the removed runs as [from, to) word positions)."""
    names = docs.columns
    new = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()),
           StructField("repeats", ArrayType(StructType([StructField("from", IntegerType()), StructField("to", IntegerType())])))]
    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("_id"),
                        F.hash("doc_id", "text").alias("_tag"), F.col("text").cast("string").alias("_text"))
    marks, buckets = repeat_marks(keyed.select(F.col("_id").alias("id"), F.col("_tag").alias("tag"), F.col("_text").alias("text")), window)
    keyed = keyed.withColumn("_bucket", F.pmod("_tag", F.lit(buckets)))
    schema = StructType([*docs.schema.fields, *new])

    def run(own: pa.Table, marked: pa.Table) -> pa.Table:
        ids, tags, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for r in marked.to_pylist():
            ids.append(np.cumsum(_unpack(r["ids"], r["n"], np.int64)))
            tags.append(_unpack(r["tags"], r["n"], np.int32))
            at.append(np.cumsum(_unpack(r["places"], r["n"], np.int32)).astype(np.int64))
        ids, tags, at = np.concatenate(ids), np.concatenate(tags), np.concatenate(at)
        order = np.lexsort((at, ids, tags))
        ids, tags, at = ids[order], tags[order], at[order]
        cut = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), dtype=bool), (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))))
        of = {(int(ids[lo]), int(tags[lo])): at[lo:hi] for lo, hi in zip(cut, np.append(cut[1:], len(at)))}
        n_words, n_removed, kept, repeats = [], [], [], []
        columns = (own.column(c).to_pylist() for c in ("_id", "_tag"))
        for t, *key in zip(as_bytes(own.column("_text")), *columns):
            words = t.split()
            n_words.append(len(words))
            marks = of.get(tuple(key))
            if marks is None:
                n_removed.append(0)
                kept.append(b" ".join(words))
                repeats.append([])
                continue
            edge = np.bincount(marks, minlength=len(words) + 1) - np.bincount(marks + window, minlength=len(words) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join(compress(words, ~gone)))
            repeats.append([{"from": int(x), "to": int(y)} for x, y in zip(turn[::2], turn[1::2])])
        return pa.Table.from_arrays(
            [*(own.column(i) for i in range(len(names))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
             pa.array(repeats, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
            names=[f.name for f in schema])
    return keyed.groupBy("_bucket").cogroup(marks.groupBy("bucket")).applyInArrow(run, schema)
