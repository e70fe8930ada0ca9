"""Vectorised word handling shared by the operators of this subpackage.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text (white space is ASCII, so byte runs and code point runs agree).  A word is
named by a 64-bit hash that mixes its length and eight bytes at a time, a long one by
the public xxh3; the name of a run of words combines those of its halves.  Every step
ends in a bijective, non-linear mixer, so no pattern of bytes or words makes names
fall together more often than chance.  A block of texts is hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Two families of names for runs of words: what the later half is multiplied by.
_LATER = (_U(0xD6E8FEB86659FD93), _U(0xA24BAED4963EE407))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words of more bytes are hashed one by one.
_LONG = 64

#: Texts are worked on in blocks of about so many bytes, which bounds memory.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_names(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The name of data[start:end] for each pair of bounds."""
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP)
    padded = data + bytes(8)
    eight = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]])
    own = np.flatnonzero(size <= _LONG)
    for at in range(0, _LONG, 8):
        own = own[size[own] > at]
        if not len(own):
            break
        left = np.minimum(size[own] - at, 8).astype(np.uint64)
        value = eight[start[own] + at] & (~_U(0) >> (_U(64) - _U(8) * left))
        out[own] = mix((out[own] ^ mix(value + _STEP)) * _LATER[0] + _U(at))
    return out


def _joined(first: np.ndarray, later: np.ndarray, family: int) -> np.ndarray:
    """The name of a run, from the names of its first and its later part."""
    return mix((first ^ mix(later * _LATER[family] + _STEP)) * _STEP + later)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of about BLOCK_BYTES of text each (a longer text alone)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """The words of a block of texts.

    ``hash``: one 64-bit name a word; ``start``/``end``: byte bounds in ``data``;
    ``first``: for each text the index of its first word, and one bound more.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b" ".join(texts) + b" "
        if lower:
            self.data = self.data.translate(_LOWER)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        blank = SPACE[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begin)
        self.hash = _word_names(self.data, self.start, self.end)

    def windows(self, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, name) of every run of k words of one text.  A run of
        16 words joins two of 8, and so on; other lengths join such runs in order."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.arange(n, dtype=np.int64)
        at = at[at + k <= last]
        runs, size = {1: self.hash}, 1
        while 2 * size <= k:
            runs[2 * size] = _joined(runs[size][:-size], runs[size][size:], family)
            size *= 2
        name, done = runs[size][at], size
        while done < k:
            size //= 2
            if done + size <= k:
                name = _joined(name, runs[size][at + done], family)
                done += size
        return at, name

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The name of the words lo:hi for each pair of bounds, all of a few words."""
        out = mix((hi - lo).astype(np.uint64) + _STEP)
        for k in range(int((hi - lo).max(initial=0))):
            own = lo + k < hi
            out[own] = _joined(out[own], self.hash[lo[own] + k], 1)
        return out


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
