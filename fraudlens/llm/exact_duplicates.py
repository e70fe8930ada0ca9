"""Exact duplicates by a tree-merge of sorted digest runs.

A text's name is its digest: sha256, with its byte length and a second, independent
64-bit hash by which equal sha256 values are verified; only texts equal in all three are
one.  Each map task sorts its digests and keeps one entry a text (the identifier that
stays, and a count): a run, sorted by digest.

Runs are merged in binomial rounds.  The nodes of a round are numbered in base ``FAN``;
in round r the nodes whose numbers differ in digit r alone exchange: each run is cut by
digest to FAN parts, part j goes to the node with digit j, and every node merges what it
gets.  After the last round a node holds one range of digests, of the runs of all nodes.
A node thus never holds more than its share of the texts, whatever their number, and
the identifiers of equal texts are reduced at every level, so a text that a third of
all rows have is one entry a run.  Runs travel packed, a row each.

The rows get the result back by digest.  Texts that hold a thousandth of all rows or
more (so at most 1,000) are joined as a broadcast table, the others by a shuffle.

Defined cases: a null text counts as empty (``normalise`` sees the empty string); a null
identifier stays only if the text has no other; rows of one identifier and text cannot
be told apart, so all are marked as kept, and ``without_exact_duplicates`` keeps one of
them; other columns are kept as they are, and a column of a name that the operator adds
is refused; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm._tables import materialize, tasks

#: Parts of an exchange; rows of a node; entries of a run that a map task closes.
FAN = 8
ROWS = 500_000
RUN = 500_000
HOT = 1_000
ADDED = ["text_sha256", "keep_id", "group_size", "kept"]
_NONE = -(1 << 63)  # no identifier, in the largest-stays order
_RUN = "node bigint, n int, digests binary, ids binary, counts binary"

#: An entry's name: sha256 as four words, byte length, second hash.
_NAME = [("a", ">u8"), ("b", ">u8"), ("c", ">u8"), ("d", ">u8"), ("length", ">u8"), ("check", ">u8")]
NAME_BYTES = 48


def _sorted_order(name: np.ndarray) -> np.ndarray:
    """Order of names; a merge where the parts are sorted runs, as the sort is stable and
    keeps runs together.  The first words settle it but for equal ones."""
    order = np.argsort(name["a"].astype(np.uint64), kind="stable")
    own = name[order]
    tie = own["a"][1:] == own["a"][:-1]
    if (tie & (own[1:] != own[:-1])).any():
        order = np.lexsort([name[k] for k, _ in reversed(_NAME)])
    return order


def merged(name: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry a name, sorted: the largest identifier and the summed count."""
    if not len(name):
        return name, ids, counts
    order = _sorted_order(name)
    # numpy joins arrays in the machine's byte order; runs travel with the highest byte first
    name, ids, counts = name[order].astype(_NAME, copy=False), ids[order], counts[order]
    start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    return name[start], np.maximum.reduceat(ids, start), np.add.reduceat(counts, start)


def radices(nodes: int) -> list[int]:
    """The digits' sizes, each at most FAN, whose product is ``nodes`` or a little more."""
    rounds = 0
    while FAN ** rounds < nodes:
        rounds += 1
    out: list[int] = []
    for left in range(rounds, 0, -1):
        need = -(-nodes // int(np.prod(out, dtype=np.int64)))
        out.append(next(f for f in range(1, FAN + 1) if f ** left >= need))
    return out


def _part(name: np.ndarray, sizes: list[int], r: int) -> np.ndarray:
    """The digit r of the range that a digest belongs to: its first word, as a fraction,
    times the number of ranges."""
    total = int(np.prod(sizes, dtype=np.int64))
    at = (name["a"].astype(np.uint64) >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)
    return (at // np.uint64(np.prod(sizes[:r], dtype=np.int64)) % np.uint64(sizes[r])).astype(np.int64)


def _cut(entries, node: int, sizes: list[int], r: int):
    """The parts of a run of ``node`` for round r, a row each, every one sorted."""
    name, ids, counts = entries
    step = int(np.prod(sizes[:r], dtype=np.int64))
    digit = _part(name, sizes, r)
    for j in range(sizes[r]):
        own = digit == j
        if own.any():
            yield (node + (j - node // step % sizes[r]) * step, int(own.sum()), name[own].tobytes(),
                   ids[own].astype("<i8").tobytes(), counts[own].astype("<i8").tobytes())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    node, n, digests, ids, counts = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(digests, pa.binary()),
                                       pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["node", "n", "digests", "ids", "counts"])


def _entries(t: pa.Table):
    parts = [(np.frombuffer(d, dtype=_NAME), np.frombuffer(i, dtype="<i8"), np.frombuffer(c, dtype="<i8"))
             for d, i, c in zip(*(t.column(k).to_pylist() for k in ("digests", "ids", "counts")))]
    return merged(*(np.concatenate(x) for x in zip(*parts)))


def digest_runs(named: DataFrame, sizes: list[int]) -> DataFrame:
    """The sorted runs of the map tasks, cut for the first round.  named: name (binary),
    id and part (the number of the map task)."""
    nodes = int(np.prod(sizes, dtype=np.int64))

    def run(batches):
        have, size, number = [], 0, 0
        part = 0
        for b in batches:
            names = b.column("name")
            if not len(names):
                continue
            part = b.column("part")[0].as_py()
            have.append((np.frombuffer(b"".join(names.to_pylist()), dtype=_NAME), np.asarray(b.column("id")), np.ones(len(names), dtype=np.int64)))
            size += len(names)
            if size >= RUN:
                yield _rows(list(_cut(merged(*(np.concatenate(x) for x in zip(*have))), (part + number) % nodes, sizes, 0)))
                have, size, number = [], 0, number + 1
        if have:
            yield _rows(list(_cut(merged(*(np.concatenate(x) for x in zip(*have))), (part + number) % nodes, sizes, 0)))
    return named.select("name", "id", "part").mapInArrow(run, _RUN)


def tree_merge(runs: DataFrame, sizes: list[int]) -> DataFrame:
    """The merged entries of all runs: name, id and n, one row a text."""
    def exchange(r: int):
        return lambda t: pa.Table.from_batches([_rows(list(_cut(_entries(t), t.column("node")[0].as_py(), sizes, r)))])
    for r in range(1, len(sizes)):
        runs = runs.groupBy("node").applyInArrow(exchange(r), _RUN)

    def last(t: pa.Table) -> pa.Table:
        name, ids, counts = _entries(t)
        return pa.table({"name": pa.array([x.tobytes() for x in name], pa.binary()), "id": pa.array(ids), "n": pa.array(counts)})
    return runs.groupBy("node").applyInArrow(last, "name binary, id bigint, n bigint")


def _name(text: Column) -> Column:
    raw = text.cast("binary")

    def word(value: Column) -> Column:  # 8 bytes, the highest first
        return F.unhex(F.lpad(F.hex(value), 16, "0"))
    return F.concat(F.unhex(F.sha2(raw, 256)), word(F.octet_length(raw).cast("bigint")), word(F.xxhash64(raw)))


def exact_duplicates(docs: DataFrame, largest: bool = True, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with text_sha256 (of the normalised text), keep_id (the identifier that
    stays: the largest doc_id of equal texts, or the smallest), group_size and kept."""
    clash = [c for c in docs.columns if c.lower() in ADDED]
    if clash:
        raise ValueError(f"rename the columns {clash}")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # smallest: the complement turns the order round and leaves null as the last choice
    own = F.col("doc_id").cast("bigint")
    rank = F.coalesce(own if largest else F.bitwise_not(own), F.lit(_NONE))
    named = docs.select("*", _name(normalise(text) if normalise else text).alias("__name"), rank.alias("__id"))
    names = materialize(named.select(F.col("__name").alias("name"), F.col("__id").alias("id"), F.spark_partition_id().cast("bigint").alias("part")), "digest-names")
    rows = names.count()
    sizes = radices(max(2, tasks(spark), -(-rows // ROWS)))
    found = materialize(tree_merge(digest_runs(names, sizes), sizes), "digest-groups")

    many = found.filter("n > 1").select(F.col("name").alias("__name"), F.col("id").alias("__keep"), F.col("n").alias("__n"))
    hot = F.broadcast(many.filter(F.col("__n") * HOT >= max(rows, 1)))  # at most HOT rows
    with_hot = named.join(hot, "__name", "left")
    # rows of hot texts, and single ones, have nothing to look up: they do not all meet at one key
    cold = many.filter(F.col("__n") * HOT < max(rows, 1)).select(F.col("__name"), F.col("__keep").alias("__keep2"), F.col("__n").alias("__n2"))
    told = with_hot.filter("__n IS NOT NULL").unionByName(
        with_hot.filter("__n IS NULL").drop("__keep", "__n").join(cold, "__name", "left").withColumnsRenamed({"__keep2": "__keep", "__n2": "__n"}))
    keep = F.coalesce("__keep", "__id")
    back = F.when(keep != _NONE, keep if largest else F.bitwise_not(keep))
    return told.select(*docs.columns, F.lower(F.hex(F.substring("__name", 1, 32))).alias("text_sha256"), back.alias("keep_id"),
                       F.coalesce("__n", F.lit(1).cast("bigint")).alias("group_size"), F.col("__id").eqNullSafe(keep).alias("kept"))


def without_exact_duplicates(docs: DataFrame, largest: bool = True, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row of each text, that of the identifier that stays."""
    kept = exact_duplicates(docs, largest, normalise).filter("kept")
    alone = kept.filter("group_size = 1")
    # copies of one identifier: few rows an identifier and text, unless the ids are no ids
    one = F.row_number().over(Window.partitionBy("text_sha256", "__salt").orderBy(F.lit(1)))
    several = kept.filter("group_size > 1").withColumn("__salt", F.spark_partition_id())
    several = several.withColumn("__n", one).filter("__n = 1").drop("__n").withColumn("__salt", F.lit(0))
    several = several.withColumn("__n", one).filter("__n = 1").drop("__n", "__salt")
    return alone.unionByName(several).select(*docs.columns)
