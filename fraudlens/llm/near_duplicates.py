"""Near duplicates by an inverted join on MinHash coordinates.

A document's set are its distinct ``shingle``-word shingles; documents of one set are
one node.  A node's signature has ``COORDINATES`` MinHash values.  Each (coordinate,
value) has a posting list of the nodes that have it.  Two sets of Jaccard similarity
0.8 agree in 51 of 64 coordinates on average; pairs that agree in ``MATCHES`` = 36 or
more are retained (the chance to lose a pair of just 0.8 is about 1e-5, of 0.85 1e-8)
and confirmed on the full sets.

Prefix: coordinates are ordered from the shortest posting list to the longest.  A
pair that agrees in t of k coordinates has one in common among the first k - t + 1 of
both, so only those are posted, and a node that shares fewer than t values with any
other is left out.  Skip: of a pair that meets in a list, the other lists are not
merged; the agreements are counted in the two signatures.

Large groups of near copies would meet as all pairs.  So each list has a few hubs
(the nodes with the longest lists in all, the most central ones), and first only the
pairs with a hub are counted and confirmed: a few for each posting.  Nodes that this
links are one component, and then only pairs between different components of a list
are left.  Long lists are worked on in blocks of nodes; a pair is counted once and
travels in one list of partners a node and bucket, and none is dropped.  Texts that are
alike by somewhat less than ``percent`` stay apart, so a large group of them is counted
pair by pair; those lists hold eight bytes a pair that the signatures cannot rule out.

Defined cases: a null or empty text, or one without words, has no shingle and is a
component of its own; a text with fewer words has the whole sequence as its shingle;
equal ids are told apart by their sets; a null id is never a component's least id
(a component of null ids has null); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm._graph import components
from fraudlens.llm._tables import materialize, tasks
from fraudlens.llm._words import Words, as_bytes, blocks, mix

COORDINATES = 64
MATCHES = 36
HUBS = 4
#: Nodes of one posting list in one block; bytes of one bucket of full sets; postings in
#: one task; pairs counted at once.
BLOCK = 1024
BUCKET_BYTES = 32 << 20
ROWS = 65_536
PAIRS = 1 << 18
_SALT = np.random.default_rng(3).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (letters A-Z as a-z)."""
    out: list[np.ndarray] = []
    for lo, hi in blocks(texts):
        w = Words(texts[lo:hi], lower=True)
        size = np.diff(w.first)
        at, h = w.windows(shingle)
        few = np.flatnonzero((size > 0) & (size < shingle))
        doc = np.concatenate((np.searchsorted(w.first, at, side="right") - 1, few))
        h = np.concatenate((h, w.runs(w.first[few], w.first[few + 1])))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        bound = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [h[bound[i]:bound[i + 1]] for i in range(hi - lo)]
    return out


def _node(own: np.ndarray) -> int:
    """A hash of the set."""
    return int(mix(mix(own).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))[0].view(np.int64))


def _signature(own: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(own), 4096):
        np.minimum(least, mix(own[lo:lo + 4096][None] ^ _SALT[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, tag, n_shingles, node (a hash of the set), signature and sketch (the
    lowest byte of each of its values) of every row."""
    def run(batches):
        for b in batches:
            sets = shingle_sets(as_bytes(b.column("text")), shingle)
            values = [_signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()),
                 pa.array(values, pa.list_(pa.int32())),
                 pa.array([None if v is None else v.astype(np.uint8).tobytes() for v in values], pa.binary())],
                names=["doc_id", "tag", "n_shingles", "node", "signature", "sketch"])
    return docs.mapInArrow(run, "doc_id bigint, tag bigint, n_shingles bigint, node bigint, signature array<int>, sketch binary")


def postings(nodes: DataFrame) -> DataFrame:
    """list, node, weight: the prefixes of the nodes that may have a partner.  weight:
    a node's summed list lengths."""
    value = F.col("value").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    every = nodes.select("node", F.posexplode("signature").alias("coordinate", "value")).select(
        F.shiftleft(F.col("coordinate").cast("bigint"), 32).bitwiseOR(value).alias("list"), "node")
    shared = every.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = (every.join(shared, "list").groupBy("node")
           .agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("lists"))  # at most COORDINATES
           .filter(F.size("lists") >= MATCHES))
    # lists of one node come first in the order; they fill the rest of the prefix
    prefix = F.slice("lists", F.lit(1), F.size("lists") - (MATCHES - 1))
    weight = F.aggregate("lists", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return own.withColumn("weight", weight).withColumn("list", F.explode(prefix)).select("list.list", "node", "weight")


def hubs_of(posted: DataFrame) -> DataFrame:
    """list, node of the hubs: of each of HUBS parts of a list the node of most weight."""
    part = F.pmod(F.xxhash64("node"), F.lit(HUBS))
    most = posted.groupBy("list").agg(*[F.max(F.when(part == i, F.struct("weight", "node")))["node"].alias(f"h{i}") for i in range(HUBS)])
    return most.select("list", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("node")).filter("node IS NOT NULL")


def confirmed(asked: DataFrame, sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """The pairs (node, bucket, others: nodes of that bucket) as links (u, v) whose full
    sets are similar.  A node's set is sent once to each bucket where it has pairs, the
    others' sets only to their own (a node modulo ``buckets``)."""
    asked = (asked.filter("node IS NOT NULL").groupBy("node", "bucket")
             .agg(F.flatten(F.collect_list("others")).alias("others")))  # nodes of one bucket
    asked = asked.join(sets.select("node", F.col("members").alias("own")), "node")
    held = sets.select(F.col("node").alias("held"), F.col("members").alias("held_members"),
                       F.pmod("node", F.lit(buckets)).alias("held_bucket"))

    def check(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        have = {n: np.frombuffer(m, dtype=np.uint64)
                for n, m in zip(mine.column("held").to_pylist(), mine.column("held_members").to_pylist())}
        u, v = [], []
        for node, members, others in zip(*(theirs.column(c).to_pylist() for c in ("node", "own", "others"))):
            own = np.frombuffer(members, dtype=np.uint64)
            others = [o for o in others if o in have and o != node
                      and 100 * min(len(own), len(have[o])) >= percent * max(len(own), len(have[o]))]
            for lo in range(0, len(others), 256):
                part = others[lo:lo + 256]
                size = np.array([len(have[o]) for o in part])
                flat = np.concatenate([have[o] for o in part])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
                near = 100 * both >= percent * (len(own) + size - both)
                v += [o for o, ok in zip(part, near) if ok]
                u += [node] * int(near.sum())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return held.groupBy("held_bucket").cogroup(asked.groupBy("bucket")).applyInArrow(check, "u bigint, v bigint")


def pairs(posted: DataFrame, nodes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """node, bucket, others: of each list its open nodes with all nodes of other
    components, where MATCHES coordinates agree and the sizes of the sets allow
    ``percent``, each pair once: in the first list that both have posted, and of two
    open nodes from the larger one.  Rows without a node list in others the nodes that
    a task's pairs have, each once.  posted: list, node, component, open."""
    spark = posted.sparkSession
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("all"), F.count_if("open").alias("some")).filter("all > 1 AND some > 0")
    lists = sizes.select("list", F.ceil(F.col("all") / BLOCK).cast("bigint").alias("blocks"), F.ceil(F.col("some") / BLOCK).cast("bigint").alias("open_blocks"))
    prefix = posted.groupBy("node").agg(F.collect_list("list").alias("prefix"))  # at most COORDINATES
    mine = posted.join(prefix.join(nodes.select("node", "sketch", "n_shingles"), "node"), "node").join(lists, "list")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n))
    tasks_ = max(tasks(spark), -(-posted.count() // ROWS))
    # a cell: a block of a list's nodes against a block of its open nodes; a task has many cells
    cell = F.xxhash64("list", "block", "open_block")
    names = ["task", "cell", "coordinate", "node", "component", "n_shingles", "open", "prefix", "sketch"]

    def rows(df: DataFrame, prefix: str) -> DataFrame:
        df = df.withColumn("cell", cell).withColumn("task", F.pmod("cell", F.lit(tasks_))).withColumn("coordinate", F.shiftright("list", 32).cast("int"))
        return df.select(*[F.col(c).alias(prefix + c) for c in names])
    held = rows(mine.withColumn("block", own("blocks")).withColumn("open_block", every("open_blocks")), "")
    asked = rows(mine.filter("open").withColumn("open_block", own("open_blocks")).withColumn("block", every("blocks")), "open_")
    def count(theirs: pa.Table, open_: pa.Table) -> pa.Table:
        def read(t: pa.Table):
            t = t.rename_columns(names).combine_chunks()
            lists = t.column("prefix").combine_chunks()
            row = np.repeat(np.arange(t.num_rows), np.asarray(lists.value_lengths()))
            flat = np.asarray(lists.flatten())
            value, has = np.zeros((t.num_rows, COORDINATES), dtype=np.uint32), np.zeros((t.num_rows, COORDINATES), dtype=bool)
            value[row, flat >> 32], has[row, flat >> 32] = (flat & 0xFFFFFFFF).astype(np.uint32), True
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
            return *(np.asarray(t.column(c).combine_chunks()) for c in ("cell", "coordinate", "node", "component", "n_shingles", "open")), value, has, sketch
        u, v = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if theirs.num_rows and open_.num_rows:
            c1, _, n1, k1, m1, o1, v1, h1, s1 = read(theirs)
            c2, at2, n2, k2, m2, _, v2, h2, s2 = read(open_)
            order = np.argsort(c1, kind="stable")
            lo, hi = np.searchsorted(c1[order], c2), np.searchsorted(c1[order], c2, side="right")
            upto = np.cumsum(hi - lo)
            begin = 0
            while begin < len(c2):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
                n = (hi - lo)[begin:end]
                i = np.repeat(np.arange(begin, end), n)
                j = order[np.arange(n.sum()) + np.repeat(lo[begin:end] - (np.cumsum(n) - n), n)]
                apart = (k1[j] != k2[i]) & (~o1[j] | (n1[j] < n2[i])) & (100 * np.minimum(m1[j], m2[i]) >= percent * np.maximum(m1[j], m2[i]))
                i, j = i[apart], j[apart]
                enough = (s1[j] == s2[i]).sum(axis=1) >= MATCHES
                i, j = i[enough], j[enough]
                both = (v1[j] == v2[i]) & h1[j] & h2[i]
                first = both.argmax(axis=1) == at2[i]
                u.append(n2[i[first]])
                v.append(n1[j[first]])
                begin = end
        a, b = np.concatenate(u), np.concatenate(v)
        to = b % buckets
        order = np.lexsort((to, a))
        a, b, to = a[order], b[order], to[order]
        cut = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), dtype=bool), (a[1:] != a[:-1]) | (to[1:] != to[:-1]))))
        ends = np.unique(np.concatenate((a, b)))
        alone = int(len(ends) > 0)  # the last row: the ends of all pairs
        bound = np.concatenate((cut, [len(a)], [len(a) + len(ends)] * alone)).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(bound), pa.array(np.concatenate((b, ends))))
        return pa.table({"node": pa.array([*a[cut].tolist(), *[None] * alone], pa.int64()), "bucket": pa.array([*to[cut].tolist(), *[None] * alone], pa.int64()),
                         "others": others})
    return held.groupBy("task").cogroup(asked.groupBy("open_task")).applyInArrow(count, "node bigint, bucket bigint, others array<bigint>")


def outside_main(posted: DataFrame, label: DataFrame) -> DataFrame:
    """list, node, component, open of the lists with several components: open are the
    nodes outside a list's largest component."""
    of = posted.select("list", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = of.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"))
    main = (sizes.groupBy("list").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component"))["component"].alias("main"))
            .filter("parts > 1").select("list", "main"))
    return of.join(main, "list").select("list", "node", "component", (F.col("component") != F.col("main")).alias("open"))


def _ends(found: DataFrame) -> DataFrame:
    """The nodes of pairs."""
    return found.filter("node IS NULL").select(F.explode("others").alias("node")).distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, members (the full set) of the wanted nodes, from a document each."""
    first = nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("_of"), "node")

    def run(batches):
        for b in batches:
            sets = shingle_sets(as_bytes(b.column("text")), shingle)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array([_node(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "found", "members"])
    # rows of one id may have other texts, and sets, than the wanted one
    return (docs.join(first, F.coalesce("doc_id", F.lit(-1)) == F.coalesce("_of", F.lit(-1))).select("node", "text")
            .mapInArrow(run, "node bigint, found bigint, members binary").filter("node = found").drop("found"))


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, node, class (a node of the
    component), component_id and kept of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_tag())
    told = materialize(signatures(docs, shingle), "near-signatures")
    some = told.filter("n_shingles > 0")
    nodes = materialize(some.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch")), "near-nodes")
    posted = materialize(postings(nodes), "near-postings")

    buckets = max(8, 8 * (nodes.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET_BYTES)

    hub = hubs_of(posted).withColumn("hub", F.lit(True))
    near = (posted.select("list", "node").join(hub, ["list", "node"], "left")
            .select("list", "node", F.col("node").alias("component"), F.coalesce("hub", F.lit(False)).alias("open")))
    found = materialize(pairs(materialize(near, "near-hubs"), nodes, buckets, percent), "near-pairs")
    sets = materialize(full_sets(docs, nodes, _ends(found), shingle), "near-sets")
    links = materialize(confirmed(found, sets, percent, buckets), "near-links")
    label = materialize(components(links), "near-components")
    rest = materialize(pairs(materialize(outside_main(posted, label), "near-open"), nodes, buckets, percent), "near-pairs")
    missing = _ends(rest).join(sets.select("node"), "node", "left_anti")
    if not missing.isEmpty():
        sets = sets.unionByName(materialize(full_sets(docs, nodes, missing, shingle), "near-sets"))
    more = materialize(confirmed(rest, sets, percent, buckets), "near-links")
    label = materialize(components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "near-components")

    least = (label.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = (nodes.join(label, "node", "left").join(least, "component", "left")
             .select("node", F.coalesce("component", "node").alias("class"), F.coalesce("component_id", "doc_id").alias("component_id")))
    out = some.join(named, "node").unionByName(
        told.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")), allowMissingColumns=True)
    return out.select("doc_id", "tag", "n_shingles", "node", "class", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def text_tag() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("tag")


def without_near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one of its least id (of several
    texts of that id the one of least hash), and every row without words."""
    least = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))  # never null, so that one shuffle serves both steps
    told = near_duplicates(docs, shingle, percent).filter("kept").withColumn("_id", least)
    one = told.filter("n_shingles > 0").groupBy("_id", "class").agg(F.min("tag").alias("_tag")).select("_id", "_tag", F.lit(False).alias("_bare"))
    bare = told.filter("n_shingles = 0").select("_id", F.col("tag").alias("_tag"), F.lit(True).alias("_bare")).distinct()
    stay = docs.withColumn("_id", least).withColumn("_tag", text_tag()).join(one.unionByName(bare), ["_id", "_tag"])
    copy = F.row_number().over(Window.partitionBy("_id", "_tag").orderBy("_bare"))
    return stay.withColumn("_copy", copy).filter("_bare OR _copy = 1").select(*docs.columns)
