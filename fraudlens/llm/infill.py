"""Fill-in-the-middle: a text is cut at two ranks of its units and its parts reordered.

Units are words with the white space before them, and the white space at the end.  An
indexable skip list over the units finds a cut: its lowest lane has a node a unit, each
lane above a random quarter of the nodes below, and every node carries how many units
and how many code points lie between it and the next node of its lane.  A search walks
right while the accumulated units stay within the rank, then goes down a lane; where it
ends, the accumulated code points are the place of the cut.

Each text's ranks and form come from a hash of seed and id, so reruns, other partitions
and other rows change nothing.  A text is worked on by itself in one task; there is no
shuffle.  ``restored`` is the inverse, from output and form alone.

Defined cases: a null text counts as empty; empty texts and texts that contain a marker
stay plain; white space alone is one unit; an empty prefix, middle or suffix is kept as
such; a null doc_id is hashed as the empty string; rows of one id are cut alike if their
texts are; other columns are kept as they are, and a column of a name that the operator
adds is refused; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fraudlens.llm._words import SPACE, as_bytes, mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ["n_units", "form", "prefix_chars", "middle_chars", "output"]
_WIDE = np.concatenate((SPACE, np.zeros(1, dtype=bool)))  # by code point, all from 256 on as the last


def unit_widths(text: str) -> np.ndarray:
    """The code points of each unit."""
    blank = _WIDE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 256)]
    if not len(blank):
        return np.zeros(0, dtype=np.int64)
    last = np.append(~blank[:-1] & blank[1:], True)  # the last code point of a word, or of the text
    return np.diff(np.flatnonzero(last) + 1, prepend=0)


class SkipList:
    """An indexable skip list over units of given widths."""

    #: One node of so many goes up a lane.
    FAN = 4

    def __init__(self, widths: np.ndarray, seed: int = 0):
        units = np.ones(len(widths), dtype=np.int64)
        self.lanes = [(units, widths, None)]  # units and code points to the next node, place in the lane below
        while len(units) > self.FAN:
            coin = mix(np.arange(len(units), dtype=np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 + len(self.lanes) & (1 << 64) - 1))
            up = coin % np.uint64(self.FAN) == 0
            up[0] = True  # the head is in every lane
            down = np.flatnonzero(up)
            units, widths = np.add.reduceat(units, down), np.add.reduceat(widths, down)
            self.lanes.append((units, widths, down))

    def code_points(self, rank: int) -> int:
        """The code points of the first ``rank`` units."""
        at = passed = place = 0
        for units, widths, down in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                place += int(widths[at])
                at += 1
            if passed == rank:
                break
            if down is not None:
                at = int(down[at])
        return place


def draws(key: str) -> list[int]:
    """The first four 8-digit groups of the key's hex sha256, as integers."""
    digest = hashlib.sha256(key.encode("utf-8")).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers that can be found again: the first character of each is in none at
    another place, so no marker arises where a part and a marker meet."""
    if len(set(markers)) < 3 or not all(markers) or any(m.find(o[0], 1) >= 0 for m in markers for o in markers) \
            or any(m != o and m.startswith(o) for m in markers for o in markers):
        raise ValueError("three different markers are needed, none the start of another, whose first characters occur nowhere else in them")
    return markers


def infill(doc_id: int | None, text: str, seed: int, percent: int, spm_percent: int, markers: tuple[str, str, str]):
    """(units, form, code points of prefix and of middle or None, output) of a text."""
    pre, suf, mid = markers
    widths = unit_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(f"{seed}:{'' if doc_id is None else doc_id}")
    if not text or h3 % 100 >= percent or any(m in text for m in markers):
        return n, "plain", None, None, text
    cuts = SkipList(widths, seed)
    one, two = (cuts.code_points(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if h4 % 100 < spm_percent:
        return n, "spm", one, two - one, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
    return n, "psm", one, two - one, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80,
                   markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``docs`` with n_units, form (plain, psm or spm), prefix_chars and middle_chars (code
    points, null if plain) and output.  ``percent`` of the texts are reordered, and of
    those ``spm_percent`` have the suffix first; markers: of prefix, suffix and middle."""
    markers = _checked(tuple(markers))
    clash = [c for c in docs.columns if c.lower() in ADDED]
    if clash:
        raise ValueError(f"rename the columns {clash}")
    names = docs.columns
    schema = StructType([*docs.schema.fields, *(StructField(c, StringType() if c in ("form", "output") else LongType()) for c in ADDED)])
    keyed = docs.select("*", F.col("doc_id").cast("bigint").alias("__id"), F.col("text").cast("string").alias("__text"))

    def run(batches):
        for b in batches:
            rows = [infill(i, t.decode("utf-8", "replace"), seed, percent, spm_percent, markers)
                    for i, t in zip(b.column("__id").to_pylist(), as_bytes(b.column("__text")))]
            n, form, prefix, middle, output = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=[f.name for f in schema])
    return keyed.mapInArrow(run, schema)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that was reordered to ``output``."""
    pre, suf, mid = _checked(tuple(markers))
    last = F.instr(output, mid)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at = F.instr(output, second)
        return (F.substring(output, F.lit(len(first) + 1), at - len(first) - 1),
                F.substring(output, at + len(second), last - at - len(second)),
                F.substring(output, last + len(mid), F.length(output)))
    psm, spm = parts(pre, suf), parts(suf, pre)
    return (F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
            .when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output))
