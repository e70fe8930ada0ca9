"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token is a list of byte tokens.  Leaf ``i`` of its tree holds the rank of the
pair that token ``i`` forms with the next one (with ``i`` as the lower digits); an
inner node holds the least of its children, so the root names the leftmost pair of
the lowest rank.  That pair is merged, and the three leaves it touches climb to the
root in as many steps as the tree has levels, until no pair can be merged.  Trees of
like size are worked on together, a row of an array each, so a step costs a few
array operations for thousands of pre-tokens.

Workers keep the ids of the pre-tokens they have met (at most ``CACHE`` of them, then
they start afresh), so a frequent pre-token is merged once a worker.

Defined cases: a null text is an empty one and has no ids; strings of added tokens
inside a text become their ids, as the public library does by default; ids that no
token has are refused; bytes that are no UTF-8 decode to U+FFFD; extra columns are
kept by ``encode`` and ``decode``.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fraudlens.llm._lookup import Table
from fraudlens.llm._pretokens import Splitter, added_tokens, byte_alphabet, parse
from fraudlens.llm._words import as_bytes, blocks

CACHE = 300_000
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file."""

    def __init__(self, file_text: str):
        own = parse(file_text)
        byte_of = byte_alphabet()
        vocab = own["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in own["model"]["merges"]]
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in byte_of.items():
            self.first[b] = vocab[c]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.added = added_tokens(own)
        token = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        token |= {i: s.encode() for s, i in self.added.items()}
        size = max(token) + 1
        self.known = np.zeros(size, dtype=bool)
        self.known[list(token)] = True
        self.length = np.array([len(token.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.text = np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), dtype=np.uint8)


class Encoder:
    """Encodes lists of pre-tokens and decodes ids with a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = Splitter(vocabulary.added)
        code = (vocabulary.left.astype(np.uint64) << np.uint64(32)) | vocabulary.right.astype(np.uint64)
        # The later of two equal merges counts, as in a map filled in file order.
        own, at = np.unique(code[::-1], return_index=True)
        self.rank_of = len(code) - 1 - at
        self.pairs = Table(own)
        self._forget()

    def _forget(self) -> None:
        self.index = {s: i for i, s in enumerate(self.v.added)}
        self.ids = [np.array(list(self.v.added.values()), dtype=np.int32)]
        self.sizes = [np.ones(len(self.v.added), dtype=np.int64)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        row = self.pairs.find((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
        return np.where(row >= 0, self.rank_of[row], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of the words, and the number of ids of each word."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(size) - size
        count = np.zeros(len(words), dtype=np.int64)
        found = []
        level = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for bits in np.unique(level):
            of = np.flatnonzero((level == bits) & (size > 0))
            step = max(1, (1 << 19) >> bits)
            for lo in range(0, len(of), step):
                at = of[lo:lo + step]
                ids, n = self._forest(raw, start[at], size[at], int(bits))
                count[at] = n
                found.append((at, ids))
        out = np.zeros(count.sum(), dtype=np.int32)
        place = np.cumsum(count) - count
        for at, ids in found:
            n = count[at]
            out[np.repeat(place[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def _forest(self, raw, start, size, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of at most 2^bits bytes, a tree each."""
        width, n = 1 << bits, len(start)
        col = np.arange(width)
        alive = col < size[:, None]
        ids = np.where(alive, self.v.first[raw[np.minimum(start[:, None] + col, len(raw) - 1)]], -1)
        after = np.where(col + 1 < size[:, None], col + 1, width)
        before = np.broadcast_to(col - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        rank = self._rank(ids[:, :-1].ravel(), np.maximum(ids[:, 1:], 0).ravel()).reshape(n, width - 1)
        tree[:, width:2 * width - 1] = np.where((rank >= 0) & alive[:, 1:], (rank << bits) | col[:-1], _NONE)
        for low in (1 << b for b in range(bits - 1, -1, -1)):
            tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            root = tree[row, 1]
            here = root & (width - 1)
            gone = after[row, here]
            then = after[row, gone]
            new = self.v.merged[root >> bits]
            ids[row, here], alive[row, gone], after[row, here] = new, False, then
            tree[row, width + gone] = _NONE
            has = then < width
            before[row[has], then[has]] = here[has]
            key = np.full(len(row), _NONE, dtype=np.int64)
            r = self._rank(new[has], ids[row[has], then[has]])
            key[has] = np.where(r >= 0, (r << bits) | here[has], _NONE)
            tree[row, width + here] = key
            prior = before[row, here]
            has = prior >= 0
            r = self._rank(ids[row[has], prior[has]], new[has])
            tree[row[has], width + prior[has]] = np.where(r >= 0, (r << bits) | prior[has], _NONE)
            for rows, leaf in ((row, gone), (row, here), (row[has], prior[has])):
                node = width + leaf
                for _ in range(bits):
                    low = tree[rows, node]
                    low = np.minimum(low, tree[rows, node ^ 1])
                    node = node >> 1
                    tree[rows, node] = low
            row = row[tree[row, 1] != _NONE]
        return ids[alive].astype(np.int32), alive.sum(axis=1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of the texts, and the number of ids of each text."""
        parts = [self.split(t) for t in texts]
        index = list(map(self.index.get, chain.from_iterable(parts)))
        if None in index:
            if len(self.index) > CACHE:
                self._forget()
            new = [s for s in dict.fromkeys(chain.from_iterable(parts)) if s not in self.index]
            ids, count = self.merge([s.encode() for s in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.ids, self.sizes = [np.concatenate([*self.ids, ids])], [np.concatenate([*self.sizes, count])]
            index = list(map(self.index.__getitem__, chain.from_iterable(parts)))
        index = np.array(index, dtype=np.int64)
        sizes = self.sizes[0]
        place = np.cumsum(sizes) - sizes
        n = sizes[index]
        out = self.ids[0][np.repeat(place[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate(([0], np.cumsum(n)))
        bound = np.cumsum([0] + [len(p) for p in parts])
        return out, total[bound[1:]] - total[bound[:-1]]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.v.known) or not self.v.known[ids].all()):
            raise ValueError("an id that no token has")
        n = self.v.length[ids]
        raw = self.v.text[np.repeat(self.v.place[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        total = np.concatenate(([0], np.cumsum(n)))
        bound = total[np.concatenate(([0], np.cumsum(count)))]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bound[:-1], bound[1:])]


_encoders: dict[str, Encoder] = {}


def _encoder(file_text: str) -> Encoder:
    """One encoder a worker and file."""
    if file_text not in _encoders:
        _encoders.clear()
        _encoders[file_text] = Encoder(Vocabulary(file_text))
    return _encoders[file_text]


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _with(docs: DataFrame, new: list[StructField], make) -> DataFrame:
    """``docs`` with the columns ``new``, which ``make`` computes from each Arrow batch."""
    added = [f.name for f in new]
    names = [c for c in docs.columns if c not in added]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *make(b)], names=[*names, *added])
    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in names), *new]))


def _encoded(own: Encoder, texts: list[bytes]) -> pa.Array:
    ids, count = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    for lo, hi in blocks(texts):
        i, n = own.encode([t.decode("utf-8", "replace") for t in texts[lo:hi]])
        ids.append(i)
        count.append(n)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(count)).astype(np.int32)), pa.array(np.concatenate(ids)))


def _decoded(own: Encoder, lists: pa.Array) -> pa.Array:
    flat = np.asarray(lists.flatten())
    count = np.asarray(lists.value_lengths().fill_null(0))
    texts, at = [], np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    for lo in range(0, len(count), 256):
        hi = min(lo + 256, len(count))
        texts += own.decode(flat[at[lo]:at[hi]], count[lo:hi])
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of the column ``text`` as array<int> ``out``, and, if
    ``decoded`` names a column, with the text that these ids decode to."""
    file_text = read_file(path)

    def make(b):
        own = _encoder(file_text)
        ids = _encoded(own, as_bytes(b.column(b.schema.get_field_index(text))))
        return [ids] if decoded is None else [ids, _decoded(own, ids)]
    new = [StructField(out, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    return _with(docs.withColumn(text, F.col(text).cast("string")), new, make)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids in column ``ids`` (null: empty) as ``out``."""
    file_text = read_file(path)
    return _with(docs, [StructField(out, StringType())],
                 lambda b: [_decoded(_encoder(file_text), b.column(b.schema.get_field_index(ids)))])
