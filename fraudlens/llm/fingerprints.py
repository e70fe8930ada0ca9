"""Document fingerprints by order MinHash, in DataFrame functions only.

A text's units are its words (runs other than white space); a word of more than
``UNIT`` characters, as unspaced scripts have, gives its characters instead, word by
word.  A k-mer starts at each unit: at a word a run of ``k`` units, at such a
character a run of ``UNIT`` units, so that k-mers overlap and an inserted character
changes only those it lies in.  At the text's end they are as long as what is left
(a text of fewer than ``k`` units has one for all of them).
Equal k-mers are told apart by their occurrence number, so a text is a set of
(k-mer, occurrence) pairs, each with a hash and a place in the text.  The hash's
leading bits deal the pairs to ``2^BITS`` coordinates; of each coordinate the
``keep`` pairs of least hash are taken, put back in text order, and the tuple is
hashed.  Two texts agree in a coordinate if the same pairs were least there and
stand in the same order, which makes the share of agreeing coordinates follow the
edit distance and not the sets alone.

Defined cases: a null text is an empty one; an empty text, or one of white space,
has no coordinates and the empty fingerprint; two such are alike (1.0).  Equal texts
have equal fingerprints.  Places from 2^24 on (texts of over 16 million words) count
as one place.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm._tables import tasks

UNIT = 16
BITS = 6
_PLACE = (1 << 24) - 1
_HASH = ~_PLACE


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(values: Column, of: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """``make(from, to)`` for each run of neighbours of the sorted array ``values``
    on which ``of`` is constant."""
    def starts(size: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), size - 1), lambda j: (j == 0) | (of(F.get(values, j)) != of(F.get(values, j - 1))))
    return _let(F.size(values), lambda size: F.when(size == 0, F.array().cast("array<array<bigint>>")).otherwise(
        _let(starts(size), lambda s: F.transform(s, lambda lo, g: make(lo, F.coalesce(F.get(s, g + 1), size))))))


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_HASH))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _number(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BITS)


def _units(words: Column) -> Column:
    """The words, of long ones the characters, each after a blank (no word has one)."""
    long = F.exists(words, lambda w: F.length(w) > UNIT)
    return F.when(~long, words).otherwise(F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= UNIT, F.array(w)).otherwise(
        F.transform(F.split(w, ""), lambda c: F.concat(F.lit(" "), c))))))


def _kmers(u: Column, k: int) -> Column:
    """Hash and place of each k-mer of the units, in one bigint each."""
    def run(w: Column, i: Column, n: int) -> Column:
        return F.xxhash64(w, *[F.get(u, i + j) for j in range(1, n)])
    heads = F.slice(u, 1, F.greatest(F.size(u) - (k - 1), F.lit(1)))
    return F.transform(heads, lambda w, i: _hash(F.when(F.startswith(w, F.lit(" ")), run(w, i, UNIT)).otherwise(run(w, i, k)))
                       .bitwiseOR(_place(F.least(i, F.lit(_PLACE)).cast("bigint"))))


def _numbered(s: Column) -> Column:
    """From the sorted k-mers the sorted pairs: a first occurrence keeps its k-mer's
    hash, a later one has a hash of k-mer and occurrence number."""
    def again(x: Column, j: Column) -> Column:
        return (j > 0) & (_hash(x) == _hash(F.get(s, j - 1)))

    def later(d: Column) -> Column:  # items are read by place: slice() would copy the array for each run
        return F.flatten(_runs(d, _hash, lambda lo, hi: F.transform(F.sequence(lo, hi - 1), lambda j, o: _hash(
            F.xxhash64(_hash(F.get(d, j)), o + 1)).bitwiseOR(_place(F.get(d, j))))))
    return _let(F.filter(s, again), lambda d: F.when(F.size(d) == 0, s).otherwise(
        F.sort_array(F.concat(F.filter(s, lambda x, j: ~again(x, j)), later(d)))))


def _coordinates(v: Column, keep: int) -> Column:
    """From the sorted pairs the hashed tuple of each coordinate."""
    def in_order(x: Column) -> Column:  # place first, then 39 bits of the hash
        return F.shiftleft(_place(x), 39).bitwiseOR(F.shiftrightunsigned(x, 25))

    def one(c: Column, lo: Column, hi: Column) -> Column:
        placed = F.sort_array(F.transform(F.sequence(lo, hi - 1), lambda j: in_order(F.get(c, j))))
        word = F.xxhash64(F.transform(placed, lambda x: x.bitwiseAND(F.lit((1 << 39) - 1))))
        return F.array(word.bitwiseAND(F.lit(-(1 << BITS))).bitwiseOR(_number(F.get(c, lo))))
    least = F.filter(v, lambda x, j: (j < keep) | (_number(x) != _number(F.get(v, j - keep))))
    return _let(least, lambda c: F.flatten(_runs(c, _number, lambda lo, hi: one(c, lo, hi))))


def order_minhash(text: Column, k: int = 3, keep: int = 2) -> Column:
    """The coordinates of a text as array<bigint>; the lower BITS bits of each are its number."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(_let(words, _units), lambda u: F.when(F.size(u) == 0, F.array().cast("array<bigint>")).otherwise(
        _let(F.sort_array(_kmers(u, k)), lambda s: _let(_numbered(s), lambda v: _coordinates(v, keep)))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the coordinates of either fingerprint in which they agree."""
    low = F.lit((1 << BITS) - 1)
    either = F.size(F.array_union(F.transform(a, lambda x: x.bitwiseAND(low)), F.transform(b, lambda x: x.bitwiseAND(low))))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _position(bounds: list[int], value: Column) -> Column:
    """How many of the descending ``bounds`` are at least ``value`` (binary search)."""
    table = F.array(*[F.lit(b) for b in bounds])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(
            F.get(table, mid) >= value, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), mid.alias("hi"))))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"]


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_<column>`` of the document that follows
    in descending doc_id (after the last, the first; null ids stand last, rows of one
    id by a hash of their text).

    Ranges of ids hold about as many rows each; a range's first row is also sent to
    the range before it, as the follower of its last row, so that one shuffle by range
    is enough and no task sees more than a few ranges."""
    ids = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = 4 * tasks(docs.sparkSession)
    ends = docs.agg(F.max(ids).alias("top"), F.percentile_approx(ids, [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()
    if ends.top is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = sorted({ends.top, *ends.cuts}, reverse=True)  # values that occur, at most 4 a shuffle partition
    own = _position(bounds, F.col("_id")) - 1
    head = F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("_id"))
    before = F.pmod(F.col("_range") - 1, F.lit(len(bounds)))
    copies = F.when(head, F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest")),
                                  F.struct(before.alias("range"), F.lit(True).alias("guest")))) \
        .otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))))
    rows = (docs.withColumn("_id", ids).withColumn("_tie", F.xxhash64("text")).withColumn("_range", own)
            .withColumn("_copy", F.explode(copies)))
    order = Window.partitionBy(F.col("_copy.range")).orderBy(F.col("_copy.guest"), F.desc("_id"), "_tie")
    follow = F.lead(F.struct(*columns)).over(order)
    return (rows.withColumn("_next", follow).filter(~F.col("_copy.guest"))
            .select(*docs.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns]))


def document_fingerprints(docs: DataFrame, k: int = 3, keep: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_text, the two fingerprints (array<bigint>), near_edited
    and near_next of every row.  The edited text is the text whose last half (rounded
    down) gave way to as many characters from the start of the next document."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_next(own.withColumn("print", order_minhash(F.col("text"), k, keep)), ["text", "print"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    return (own.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited_text", edited)
            .withColumn("edited_print", order_minhash(F.col("edited_text"), k, keep))
            .select("doc_id", "n_chars", "edited_text", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
                    likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                    likeness(F.col("print"), F.col("next_print")).alias("near_next")))
