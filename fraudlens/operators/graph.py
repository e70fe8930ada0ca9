"""Card-merchant bipartite graph operators.

The graph is two DataFrames, never a driver-side object:

* ``edges``: one row per (card, merchant) pair with ``weight`` = number of
  parallel transactions (E12) - an aggregate, map-side combined;
* ``labels``: one row per node ``(node, node_type, label)``.

Iterative algorithms (label propagation, connected components) run a fixed
or convergent number of join + aggregate rounds.  Per-node choices use
``min_by`` *aggregates* (partial aggregation), never a window over a node's
neighbours, so a hub merchant holding a third of all edges is reduced
map-side instead of sorted by one task.  Each round's labels are cut from
the lineage by writing it under ``spark.checkpoint.dir`` (a shared folder on
a cluster), so a lost executor re-reads the last round instead of replaying
all of them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.session import materialize

CARD, MERCHANT = "card", "merchant"
DEFAULT_LPA_ROUNDS = 10


def _checkpoint(df: DataFrame) -> DataFrame:
    return materialize(df, "graph-round")


def _any_label_changed(pairs) -> bool:
    """One job over all (new, old) label tables of a round: did any node move?"""
    diffs = [new.join(old.withColumnRenamed("label", "_old"), "node")
                .filter(F.col("label") != F.col("_old")).select("node") for new, old in pairs]
    u = diffs[0]
    for d in diffs[1:]:
        u = u.unionByName(d)
    return u.limit(1).count() > 0


# ---------------------------------------------------------------------------
# Building blocks
# ---------------------------------------------------------------------------
def bipartite_edges(tx: DataFrame) -> DataFrame:
    """E12 + B15: collapse parallel transactions into weighted node-key pairs."""
    return tx.groupBy("card_id", "merchant_id").agg(
        F.count(F.lit(1)).alias("weight"),
        F.sum("is_fraud").cast("bigint").alias("fraud")).select(
        C.node_key(CARD, "card_id").alias("src"), C.node_key(MERCHANT, "merchant_id").alias("dst"),
        "card_id", "merchant_id", "weight", "fraud")


def nodes(edges: DataFrame) -> DataFrame:
    """All node keys with their type."""
    cards = edges.select(F.col("src").alias("node")).distinct().withColumn("node_type", F.lit(CARD))
    merch = edges.select(F.col("dst").alias("node")).distinct().withColumn("node_type", F.lit(MERCHANT))
    return cards.unionByName(merch)


def global_row_number(df: DataFrame, order_cols: list[str], name: str = "idx",
                      partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order, distributed.

    Range-partition by the order columns and record each row's partition;
    that assignment is materialised once (a sampled range partitioner read
    by two consumers could otherwise be evaluated with different
    boundaries or coalescing).  Rows are then numbered inside their
    partition and shifted by the row count of all earlier partitions (a
    window over one row per partition).  Exact for any boundaries."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = materialize(df.repartitionByRange(n, *order_cols).withColumn("_p", F.spark_partition_id()),
                    "row-number")
    counts = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_p", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"))
    wl = Window.partitionBy("_p").orderBy(*order_cols)
    # offs has one row per partition: a size-bounded broadcast.
    return (r.withColumn("_local", F.row_number().over(wl))
             .join(F.broadcast(offs), "_p")
             .withColumn(name, (F.col("_off") + F.col("_local") - 1).cast("bigint"))
             .drop("_p", "_local", "_off"))


def node_index(edges: DataFrame) -> DataFrame:
    """Dense 0-based index per node type, ordered by node key."""
    n = nodes(edges)
    cards = global_row_number(n.filter(F.col("node_type") == CARD), ["node"])
    merch = global_row_number(n.filter(F.col("node_type") == MERCHANT), ["node"])
    return cards.unionByName(merch)


def hetero_graph(edges: DataFrame, card_table: DataFrame, merchant_table: DataFrame) -> DataFrame:
    """I2 + D5 + C3: the node tables give each type a dense 0-based index (in node
    key order); edges with an endpoint in neither table are dropped (inner joins).
    Reverse edges are the same rows read dst->src."""
    def index(table: DataFrame, kind: str, column: str, node: str, name: str) -> DataFrame:
        keys = table.select(C.node_key(kind, column).alias(node)).distinct()
        return global_row_number(keys, [node], name).select(node, name)
    return (edges.join(index(card_table, CARD, "card_id", "src", "src_idx"), "src")
                 .join(index(merchant_table, MERCHANT, "merchant_id", "dst", "dst_idx"), "dst"))


# ---------------------------------------------------------------------------
# Communities
# ---------------------------------------------------------------------------
def _vote(edges: DataFrame, labels: DataFrame, listener: str, speaker: str) -> DataFrame:
    """Each ``listener`` node takes the label with the largest total edge
    weight among its ``speaker`` neighbours; ties -> smallest label."""
    lab = labels.select(F.col("node").alias(speaker), "label")
    votes = edges.join(lab, speaker).groupBy(listener, "label").agg(F.sum("weight").alias("w"))
    best = votes.groupBy(listener).agg(
        F.min_by("label", F.struct((-F.col("w")).alias("nw"), F.col("label"))).alias("label"))
    return best.select(F.col(listener).alias("node"), "label")


def label_propagation(edges: DataFrame, rounds: int = DEFAULT_LPA_ROUNDS) -> DataFrame:
    """I3 (re-aimed): deterministic weighted label propagation.

    Every node starts with its own key.  A round is two half-rounds: cards
    vote on their merchants' labels, then merchants vote on the new card
    labels (alternating avoids the flip-flop of synchronous LPA on a
    bipartite graph).  Stops early at a fixed point.  Output
    ``(node, node_type, community_id)``."""
    # The edge list is read by every round: materialise it once.
    e = _checkpoint(edges.select("src", "dst", "weight"))
    merch = e.select(F.col("dst").alias("node")).distinct().withColumn("label", F.col("node"))
    merch = _checkpoint(merch)
    cards = None
    for _ in range(rounds):
        new_cards = _checkpoint(_vote(e, merch, "src", "dst"))
        new_merch = _checkpoint(_vote(e, new_cards, "dst", "src"))
        changed = cards is None or _any_label_changed([(new_cards, cards), (new_merch, merch)])
        cards, merch = new_cards, new_merch
        if not changed:
            break
    out = cards.withColumn("node_type", F.lit(CARD)).unionByName(
        merch.withColumn("node_type", F.lit(MERCHANT)))
    return out.select("node", "node_type", F.col("label").alias("community_id"))


#: A move must gain more than this share of its node's weight, so that rounding never counts as gain.
MIN_GAIN = 1e-9
#: The moves of a round are ordered by a hash to so many buckets.
MOVE_BUCKETS = 16
#: A node with more neighbours than this is a hub: its votes are summed map-side.
HUB_ROWS = 1_000_000
#: So many moves of a round may come to the driver, and so many changes of labels and totals be
#: sent from there: 10 MB, what Spark's joins broadcast unasked.  More stay tables.
MOVES_AT_ONCE = 200_000
#: With more edges than this the votes of a state are kept, and a round sums only what moved since, ...
KEPT_EDGES = 4_000_000
#: ... until one node of so many has moved.
KEPT_SHARE = 8


def _move_bucket(node, turn: int):
    """A bucket by the first 16 bits of an md5, which SQL engines compute alike."""
    digits = F.substring(F.md5(F.concat(node, F.lit(f"/{turn}"))), 1, 4)
    return (F.conv(digits, 16, 10).cast("int") % MOVE_BUCKETS).alias("bucket")


def _best_moves(adjacent: DataFrame, state: DataFrame, two_m, resolution: float) -> DataFrame:
    """The best single move of every node that gains by one: (node, k, a, b, total_a, total_b,
    gain), from community a to b; ties -> smallest label.

    In units of edge weight, a node of weight k scores w(v, C) - resolution * k * total(C) / 2m
    at a community C without itself; the gain is the difference of two scores.  ``state``
    carries the total of a node's community, so votes need no join with totals."""
    votes = _votes(adjacent, state)
    own = state.select(F.col("node").alias("u"), F.col("label").alias("a"), "k", F.col("total").alias("total_a"))
    return _best_of(votes.join(own, "u"), two_m, resolution)


def _votes(adjacent: DataFrame, state: DataFrame) -> DataFrame:
    """(u, label, w, total): the weight of each node's edges to each community."""
    return adjacent.filter("u <> v").join(
        state.select(F.col("node").alias("v"), "label", "total"), "v").groupBy("u", "label").agg(
        F.sum("w").cast("double").alias("w"), F.max("total").alias("total"))


def _best_of(votes: DataFrame, two_m, resolution: float) -> DataFrame:
    """The best moves by ``votes`` (u, label, w, total, a, k, total_a)."""
    penalty = F.lit(float(resolution)) * F.col("k")
    v = votes.withColumn("score", F.col("w") - penalty * F.col("total") / two_m)
    other = F.col("label") != F.col("a")
    best = v.groupBy("u").agg(
        F.first("a").alias("a"), F.first("k").alias("k"), F.first("total_a").alias("total_a"),
        F.coalesce(F.max(F.when(~other, F.col("w"))), F.lit(0.0)).alias("w_a"),
        F.min(F.when(other, F.struct((-F.col("score")).alias("s"), F.col("label").alias("b"), "total"))).alias("best"))
    gain = -F.col("best.s") - (F.col("w_a") - penalty * (F.col("total_a") - F.col("k")) / two_m)
    return best.select(F.col("u").alias("node"), "k", "a", F.col("best.b").alias("b"),
                       "total_a", F.col("best.total").alias("total_b"), gain.alias("gain")) \
               .filter(F.col("gain") > MIN_GAIN * F.col("k"))


def _sides(moves: DataFrame, *columns: str) -> DataFrame:
    """A row for each community that a move touches: (label, joins, columns)."""
    return moves.selectExpr(
        "explode(array(struct(a AS label, false AS joins), struct(b AS label, true AS joins))) AS _s",
        *columns).select("_s.*", *columns)


def _accepted(moves: DataFrame, two_m, resolution: float, turn: int, names: DataFrame | None = None) -> DataFrame:
    """The moves of a round that can be made together without loss, as rows of ``moves``.
    ``names`` has the key of each node number, which gives its place in the order by hash;
    without it a node is its key.

    * A community is left or joined in a round, not both: joined if its best move in
      beats its best move out.  So no mover's neighbour leaves the community it joins.
    * Movers that leave or join one community then only add to each other's penalty.
      They are ordered (the best move of both its communities first, the others by
      hash), and one is accepted if it still gains after all before it and in its own
      bucket.  Any subset of these moves gains too.

    The best move of all is always accepted, so modularity rises in every round."""
    key = F.struct("gain", "node")
    tops = _sides(moves, "gain", "node").groupBy("label").agg(
        F.max(F.when(F.col("joins"), key)).alias("top_in"), F.max(F.when(~F.col("joins"), key)).alias("top_out"))
    joined = tops.filter("top_in is not null and (top_out is null or top_in > top_out)").select(
        F.col("label").alias("b"), "top_in")
    left = tops.filter("top_out is not null and (top_in is null or top_out > top_in)").select(
        F.col("label").alias("a"), "top_out")
    first = (key == F.col("top_in")) & (key == F.col("top_out"))
    keyed = moves.join(joined, "b").join(left, "a")
    keyed = keyed.withColumn("key", F.col("node")) if names is None else keyed.join(names, "node")
    able = _checkpoint(keyed.select(
        *moves.columns, F.when(first, F.lit(-1)).otherwise(_move_bucket(F.col("key"), turn)).alias("bucket")))
    # Of each community the weight of the movers up to each bucket, from -1 on.
    sums = ", ".join(f"sum(if(bucket <= {i}, k, 0D))" for i in range(-1, MOVE_BUCKETS))  # one expression: quick to build
    upto = _sides(able, "bucket", "k").groupBy("label").agg(F.expr(f"array({sums})").alias("upto"))
    at = F.col("bucket") + 2
    both = F.element_at("in", at) + F.element_at("out", at) - 2 * F.col("k")
    rest = F.lit(float(resolution)) * F.col("k") * both / two_m
    return able.join(upto.select(F.col("label").alias("b"), F.col("upto").alias("in")), "b") \
               .join(upto.select(F.col("label").alias("a"), F.col("upto").alias("out")), "a") \
               .filter(F.col("gain") - rest > MIN_GAIN * F.col("k")).select(*moves.columns)


def _accepted_here(moves: dict[str, np.ndarray], two_m: float, resolution: float, turn: int) -> np.ndarray:
    """``_accepted`` for moves that fit the driver (arrays by name, ``key`` that of the node):
    which of them are made."""
    n = len(moves["node"])
    labels, at = np.unique(np.concatenate([moves["a"], moves["b"]]), return_inverse=True)
    a, b, k = at[:n], at[n:], moves["k"]
    place = np.empty(n, dtype=np.int64)  # in the order of (gain, node)
    place[np.lexsort((np.unique(moves["node"], return_inverse=True)[1], moves["gain"]))] = np.arange(n)
    top_in, top_out = np.full(len(labels), -1), np.full(len(labels), -1)
    np.maximum.at(top_in, b, place)
    np.maximum.at(top_out, a, place)
    able = np.flatnonzero((top_in[b] > top_out[b]) & (top_out[a] > top_in[a]))
    used, at = np.unique(np.concatenate([a[able], b[able]]), return_inverse=True)
    first = (place[able] == top_in[b[able]]) & (place[able] == top_out[a[able]])
    digests = (hashlib.md5(f"{key}/{turn}".encode()).hexdigest() for key in moves["key"][able])
    bucket = np.where(first, 0, [int(d[:4], 16) % MOVE_BUCKETS + 1 for d in digests])
    a, b, k, gain = at[:len(able)], at[len(able):], k[able], moves["gain"][able]
    upto = np.zeros((len(used), MOVE_BUCKETS + 1))
    np.add.at(upto, (a, bucket), k)
    np.add.at(upto, (b, bucket), k)
    upto = upto.cumsum(axis=1)
    rest = resolution * k * (upto[b, bucket] + upto[a, bucket] - 2 * k) / two_m
    made = np.zeros(n, dtype=bool)
    made[able[gain - rest > MIN_GAIN * k]] = True
    return made


class _State:
    """The nodes' communities: a written table (node, label, k, total), and what changed since
    it was written, of at most MOVES_AT_ONCE rows: the labels of nodes and totals of labels."""

    def __init__(self, table: DataFrame):
        self.table, self.was, self.label, self.total = table, {}, {}, {}

    def _small(self, changed: dict, *columns: str) -> DataFrame:
        """``changed`` as a broadcast table: node, _to and, with three columns, _was; or label, _total."""
        node = dict(self.table.dtypes)["node"]
        data = [list(changed), list(changed.values()), [self.was[n] for n in changed] if len(columns) > 2 else []]
        rows = pa.table({c: pa.array(d) for c, d in zip(columns, data)})
        types = ", ".join(f"{c} {'double' if c == '_total' else node}" for c in columns)
        return F.broadcast(self.table.sparkSession.createDataFrame(rows, types))

    def now(self) -> DataFrame:
        """(node, label, k, total)."""
        if not self.label:
            return self.table
        return (self.table.join(self._small(self.label, "node", "_to"), "node", "left")
                .select("node", F.coalesce("_to", "label").alias("label"), "k", "total")
                .join(self._small(self.total, "label", "_total"), "label", "left")
                .select("node", "label", "k", F.coalesce("_total", "total").alias("total")))

    def written(self) -> DataFrame:
        """``now``, as a written table."""
        if self.label:
            self.table, self.was, self.label, self.total = _checkpoint(self.now()), {}, {}, {}
        return self.table

    def move(self, made: dict[str, np.ndarray]) -> None:
        """Takes in moves (node, k, a, b, total_a, total_b)."""
        change, before = {}, {}
        for node, k, a, b, total_a, total_b in zip(*[made[c].tolist() for c in ("node", "k", "a", "b", "total_a", "total_b")]):
            self.was.setdefault(node, a)
            self.label[node] = b
            before[a], before[b] = total_a, total_b
            change[a], change[b] = change.get(a, 0.0) - k, change.get(b, 0.0) + k
        self.total.update({c: before[c] + d for c, d in change.items()})

    def changes(self) -> int:
        return max(len(self.label), len(self.total))


class _Kept:
    """The votes of a written state, kept dealt by node like the edges: a round sums them with
    the votes of the edges to nodes that moved since."""

    def __init__(self, part: DataFrame, state: DataFrame, dealt: bool):
        self.part, self.dealt = part, dealt
        self.votes = part.join(state.select(F.col("node").alias("v"), "label", "total"), "v").groupBy("u", "label").agg(
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).persist()
        own = state.select(F.col("node").alias("u"), F.col("label").alias("a"), "k", F.col("total").alias("total_a"))
        self.own = own.repartition("u").persist()

    def best(self, state: _State, two_m, resolution: float) -> DataFrame:
        votes, own = self.votes, self.own
        if state.label:
            moved = state._small(state.label, "node", "_to", "_was").withColumnRenamed("node", "v")
            moves = self.part.join(moved, "v").selectExpr(
                "u", "explode(array(struct(_was AS label, -w AS w, -1L AS n), struct(_to AS label, w AS w, 1L AS n))) AS _s")
            total = state._small(state.total, "label", "_total")
            votes = votes.unionByName(moves.select("u", "_s.*", F.lit(None).cast("double").alias("total"))).groupBy("u", "label").agg(
                F.sum("w").alias("w"), F.sum("n").alias("n"), F.max("total").alias("total")).filter("n > 0") \
                .join(total, "label", "left").withColumn("total", F.coalesce("_total", "total")).drop("_total")
            own = own.join(moved.select(F.col("v").alias("u"), "_to"), "u", "left").select("u", F.coalesce("_to", "a").alias("a"), "k", "total_a") \
                .join(total.withColumnRenamed("label", "a"), "a", "left").select("u", "a", "k", F.coalesce("_total", "total_a").alias("total_a"))
        votes = votes.select("u", "label", F.col("w").cast("double").alias("w"), "total")
        return _best_of(votes.join(own.hint("shuffle_hash") if self.dealt else own, "u"), two_m, resolution)

    def drop(self) -> None:
        self.votes.unpersist()
        self.own.unpersist()


def _arrays(moves: DataFrame) -> dict[str, np.ndarray]:
    table = moves.toArrow()
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names}


def _settled(adjacent: DataFrame, degree: DataFrame, two_m, resolution: float,
             names: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Rounds of moves until no single move gains: (node, label, k, total), and whether any
    was made.

    Edges are held dealt by node (kept in memory or on the executors' disks, made again
    from the written edges if lost), so a round sums votes where they lie and shuffles no
    edges; those of hubs are summed map-side instead, as one task would get all of a hub's.
    Once few nodes move, the votes are kept too and a round adds what moved (``_Kept``).
    Which moves are made is settled on the driver where a round has at most MOVES_AT_ONCE of
    them, which spares it three small writes, and by joins where it has more."""
    state, turn = _State(degree.select("node", F.col("node").alias("label"), "k", F.col("k").alias("total"))), 0
    weight = degree.sparkSession.range(1).select(two_m).first()[0]
    others = adjacent.filter("u <> v")
    hubs = _checkpoint(others.groupBy("u").count().filter(F.col("count") > HUB_ROWS).select("u"))
    # One row of hubs stands for HUB_ROWS rows at least: a bounded broadcast.
    held = others.join(F.broadcast(hubs), "u", "left_anti").repartition("u").persist()
    parts = [held] if hubs.isEmpty() else [held, others.join(F.broadcast(hubs), "u", "left_semi")]
    keys = degree.select("node", F.col("node").alias("key")) if names is None else names.join(degree, "node", "left_semi").select("node", "key")
    size = degree.count()
    few = size <= MOVES_AT_ONCE  # and so the moves of every round: their keys come once
    key = dict(zip(*_arrays(keys).values())) if few else None
    kept, calm = [], False
    try:
        keep = held.count() > KEPT_EDGES
        while True:
            if state.changes() > min(MOVES_AT_ONCE, size // KEPT_SHARE if kept else MOVES_AT_ONCE):
                state.written()
                for part in kept:
                    part.drop()
                kept = []
            if keep and calm and not kept:
                kept = [_Kept(part, state.written(), part is held) for part in parts]
            if kept:
                found = [part.best(state, two_m, resolution) for part in kept]
            else:  # of a written table the size is known when a join is planned
                now = F.broadcast(state.now()) if few else state.written()
                found = [_best_moves(part, now, two_m, resolution) for part in parts]
            best = reduce(DataFrame.unionByName, found)
            if few:
                moves = _arrays(best)
                moves["key"] = np.array([key[node] for node in moves["node"].tolist()], dtype=object)
                n = len(moves["node"])
            else:
                told = Observation()
                best = _checkpoint(best.observe(told, F.count(F.lit(1)).alias("n")))
                n = told.get["n"]
                moves = _arrays(best.join(keys, "node")) if n <= MOVES_AT_ONCE else None
            if not n:
                return state.written(), turn > 0
            if moves is not None:
                made = _accepted_here(moves, weight, resolution, turn)
                state.move({c: column[made] for c, column in moves.items()})
                calm = made.sum() <= size // KEPT_SHARE // 4
            else:
                made = _checkpoint(_accepted(best, two_m, resolution, turn, names))
                change = _sides(made, "k").groupBy("label").agg(
                    F.sum(F.when(F.col("joins"), F.col("k")).otherwise(-F.col("k"))).alias("_change"))
                state = _State(_checkpoint(
                    state.written().join(made.select("node", F.col("b").alias("_to"), F.col("total_b").alias("_total")), "node", "left")
                         .select("node", F.coalesce("_to", "label").alias("label"), "k", F.coalesce("_total", "total").alias("total"))
                         .join(change, "label", "left")
                         .select("node", "label", "k", (F.col("total") + F.coalesce("_change", F.lit(0.0))).alias("total"))))
                for part in kept:
                    part.drop()
                kept, calm = [], False
            turn += 1
    finally:
        held.unpersist()
        for part in kept:
            part.drop()


def modularity_communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Communities by modularity, with levels.

    Every node starts alone.  Rounds of moves (``_best_moves``, ``_accepted``) go on until
    no single move gains; communities then become the nodes of a weighted graph with
    self loops, on which the same goes on, until a level makes no move.  The moves of a
    round are chosen so that modularity rises with each, hence there is an end and no
    round limit.  Deterministic; ``resolution`` scales the penalty (larger -> smaller
    communities).  Output ``(node, node_type, community_id)``, a community being named by
    its smallest node key.  An empty edge list gives no rows.  Weights must be positive.

    Nodes are numbered in the order of their keys.  A round is two joins and aggregates over
    the edges, without a shuffle of them, and a choice among the moves (``_settled``); tables
    too large for the driver are written under the checkpoint folder.  A hub's votes are
    reduced map-side."""
    e = _checkpoint(edges.select("src", "dst", "weight"))
    degree = e.select(F.col("src").alias("key"), "weight").unionByName(e.select(F.col("dst").alias("key"), "weight")) \
              .groupBy("key").agg(F.sum("weight").cast("double").alias("k"))
    degree = _checkpoint(global_row_number(degree, ["key"], "node"))
    two_m = F.lit(float(degree.agg(F.sum("k")).first()[0] or 0.0))
    names = degree.select("node", "key")
    # Rounds work on numbers, in the order of the keys; an edge without a key at one end only counts as weight.
    e = e.join(names.withColumnsRenamed({"node": "u", "key": "src"}), "src") \
         .join(names.withColumnsRenamed({"node": "v", "key": "dst"}), "dst").select("u", "v", F.col("weight").alias("w"))
    adjacent = _checkpoint(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    degree = degree.filter("key IS NOT NULL").select("node", "k")
    member = degree.select("node", F.col("node").alias("label"))
    while True:
        state, moved = _settled(adjacent, degree, two_m, resolution, names)
        if not moved:
            break
        up = state.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        member = _checkpoint(member.join(up, "label").select("node", F.col("_up").alias("label")))
        label = state.select("node", "label")
        adjacent = _checkpoint(
            adjacent.join(label.withColumnsRenamed({"node": "u", "label": "_u"}), "u")
                    .join(label.withColumnsRenamed({"node": "v", "label": "_v"}), "v")
                    .groupBy(F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.sum("w").alias("w")))
        degree = _checkpoint(state.groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k")))
    first = member.groupBy("label").agg(F.min("node").alias("first"))
    out = member.join(first, "label").join(names, "node").join(
        names.select(F.col("node").alias("first"), F.col("key").alias("community_id")), "first").select(F.col("key").alias("node"), "community_id")
    return out.select(
        "node", F.when(F.col("node").startswith(f"{CARD}_"), CARD).otherwise(MERCHANT).alias("node_type"),
        "community_id")


def connected_components(edges: DataFrame) -> DataFrame:
    """I4: connected components by alternating large-star / small-star
    rounds (Kiveris et al., 2014): O(log^2 n) rounds instead of the
    O(diameter) of min-label propagation.  Each star step is a grouped
    ``min`` (partial aggregation) joined back to the edge list, then a
    ``distinct``; the edge list is materialised after every round.  Rounds end
    when count and hash sum of the edge list no longer change: every node then
    hangs off its component's smallest node key."""
    lab = component_labels(edges)
    return lab.withColumn("node_type", F.when(F.col("node").startswith(f"{CARD}_"), CARD)
                          .otherwise(MERCHANT))


def component_labels(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (src, dst of any
    ordered type) that has another neighbour than itself."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    und = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    cur = _checkpoint(und.filter(F.col("u") != F.col("v")).distinct())

    def star_min(pairs):
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))

    def mark(pairs):
        return pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = mark(cur)
    while True:
        # Large star: every larger neighbour of u links to u's smallest neighbour-or-self.
        large = cur.join(star_min(cur), "u").filter(F.col("v") > F.col("u")) \
                   .select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(large.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        down = large.filter(F.col("v") <= F.col("u"))
        sm = star_min(down)
        small = down.join(sm, "u").select(F.col("v").alias("u"), "m").unionByName(
            sm.select("u", "m")).select("u", F.col("m").alias("v"))
        small = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        new = _checkpoint(small.filter(F.col("u") != F.col("v")).distinct())
        cur, now = new, mark(new)
        if now == before:
            break
        before = now
    return star_min(cur).select(F.col("u").alias("node"), F.col("m").alias("component"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0,
               community_col: str = "community_id") -> DataFrame:
    """Q = sum_c [ L_c / m - resolution * (d_c / 2m)^2 ] on the weighted
    undirected graph (L_c: intra-community weight, d_c: weighted degree)."""
    lab = communities.select("node", F.col(community_col).alias("c"))
    e = edges.select("src", "dst", "weight")
    m = e.select(F.sum("weight")).scalar()
    ends = e.join(lab.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src") \
            .join(lab.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
    intra = ends.filter(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("c")) \
                .agg(F.sum("weight").alias("l"))
    deg = e.select(F.col("src").alias("node"), "weight").unionByName(
        e.select(F.col("dst").alias("node"), "weight"))
    dc = deg.join(lab, "node").groupBy("c").agg(F.sum("weight").alias("d"))
    per = dc.join(intra, "c", "left").select(
        (F.coalesce("l", F.lit(0)) / m - F.lit(resolution) * F.pow(F.col("d") / (2 * m), 2)).alias("q"))
    return per.agg(F.round(F.sum("q"), 9).alias("modularity"))


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose both endpoints are in ``members`` (column ``node``);
    two left-semi joins."""
    m = members.select("node")
    return (edges.join(m.withColumnRenamed("node", "src"), "src", "left_semi")
                 .join(m.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def community_detail(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Per community node count and induced edge count (edge = distinct pair)."""
    lab = communities.select("node", "community_id")
    nodes_ = lab.groupBy("community_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.sum(F.when(F.col("node").startswith(f"{CARD}_"), 1).otherwise(0)).cast("bigint").alias("card_nodes"))
    ends = edges.join(lab.select(F.col("node").alias("src"), F.col("community_id").alias("cs")), "src") \
                .join(lab.select(F.col("node").alias("dst"), F.col("community_id").alias("cd")), "dst")
    ec = ends.filter(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("community_id")) \
             .agg(F.count(F.lit(1)).alias("edge_count"), F.sum("weight").alias("transactions"))
    return nodes_.join(ec, "community_id", "left").fillna(0, ["edge_count", "transactions"])


def display_sample(edges: DataFrame, communities: DataFrame, community_id,
                   max_cards: int = 25, max_merchants: int = 12, seed: int = 42) -> DataFrame:
    """I8: a reproducible sample of one community (<= 25 cards, <= 12
    merchants, chosen by seeded hash order) and the *real* edges among them.

    The sample is the feature (a display subset); the per-type top-n is a
    distributed top-k over the one community's nodes."""
    lab = communities.filter(F.col("community_id") == F.lit(community_id)) \
                     .withColumn("_h", C.seeded(seed, "node"))

    def top(kind, k):  # distributed top-k (TakeOrderedAndProject), no window
        return lab.filter(F.col("node_type") == kind).orderBy("_h", "node").limit(k)
    keep = top(CARD, max_cards).unionByName(top(MERCHANT, max_merchants))
    return induced_edges(edges, keep).select("src", "dst", "weight")


# ---------------------------------------------------------------------------
# Neighbourhood aggregation (data steps of GraphSAGE / GAT / auto-encoder)
# ---------------------------------------------------------------------------
def neighbour_mean(edges: DataFrame, features: DataFrame, key_from: str, key_to: str,
                   cols: list[str]) -> DataFrame:
    """Mean of neighbour feature columns over incoming edges (multi-edges
    counted by weight), one aggregate with partial aggregation."""
    f = features.select(F.col(key_from).alias("_k"), *cols)
    j = edges.join(f, edges[key_from] == f["_k"])
    w = F.col("weight")
    return j.groupBy(key_to).agg(
        *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in cols])


def attention_aggregate(edges: DataFrame, src_feat: DataFrame, dst_feat: DataFrame,
                        key_src: str, key_dst: str, cols: list[str],
                        a_src: list[float], a_dst: list[float], slope: float = 0.2) -> DataFrame:
    """One attention head with fixed weights: e = LeakyReLU(a_s.h_s +
    a_d.h_d), alpha = softmax of e over each destination's in-edges (no self
    loops), output sum(alpha * h_s).  Max and sum per destination are
    grouped aggregates joined back."""
    hs = src_feat.select(F.col(key_src).alias(key_src), *[F.col(c).alias(f"s_{c}") for c in cols])
    hd = dst_feat.select(F.col(key_dst).alias(key_dst), *[F.col(c).alias(f"d_{c}") for c in cols])
    j = edges.select(key_src, key_dst).join(hs, key_src).join(hd, key_dst)
    raw = sum((F.lit(a) * F.col(f"s_{c}") for a, c in zip(a_src, cols)), F.lit(0.0)) + \
        sum((F.lit(a) * F.col(f"d_{c}") for a, c in zip(a_dst, cols)), F.lit(0.0))
    j = j.withColumn("_e", F.when(raw > 0, raw).otherwise(raw * slope))
    mx = j.groupBy(key_dst).agg(F.max("_e").alias("_mx"))
    j = j.join(mx, key_dst).withColumn("_x", F.exp(F.col("_e") - F.col("_mx")))
    return j.groupBy(key_dst).agg(
        *[(F.sum(F.col("_x") * F.col(f"s_{c}")) / F.sum("_x")).alias(c) for c in cols])


def propagate(edges: DataFrame, card_feat: DataFrame, merchant_feat: DataFrame,
              cols: list[str], layers: int = 2):
    """``layers`` rounds of mean aggregation in both directions with a
    ReLU between rounds (identity weights: the data movement of a
    heterogeneous GraphSAGE layer).  Returns (card, merchant) tables."""
    c, m = card_feat, merchant_feat
    for i in range(layers):
        new_m = neighbour_mean(edges, c, "card_id", "merchant_id", cols)
        new_c = neighbour_mean(edges, m, "merchant_id", "card_id", cols)
        if i < layers - 1:
            new_m = new_m.select("merchant_id", *[F.greatest(F.col(x), F.lit(0.0)).alias(x) for x in cols])
            new_c = new_c.select("card_id", *[F.greatest(F.col(x), F.lit(0.0)).alias(x) for x in cols])
        c, m = new_c, new_m
    return c, m


def reconstruction_anomaly(edges: DataFrame, card_vec: DataFrame, merchant_vec: DataFrame,
                           vec: str = "z") -> DataFrame:
    """I15 + D6: 1 - sigmoid(z_card . z_merchant) per edge."""
    j = edges.join(card_vec.select("card_id", F.col(vec).alias("zc")), "card_id") \
             .join(merchant_vec.select("merchant_id", F.col(vec).alias("zm")), "merchant_id")
    return j.withColumn("anomaly", 1 - C.sigmoid(C.vec_dot("zc", "zm")))


def negative_samples(edges: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """I16: ``n`` uniform (card, merchant) pairs (default: as many as edges);
    positives are not excluded, as in the reference.  Ids are drawn by a
    seeded hash of the sample number into the dense node indices."""
    spark = edges.sparkSession
    idx = node_index(edges)
    nc = idx.filter(F.col("node_type") == CARD).select(F.count(F.lit(1))).scalar()
    nm = idx.filter(F.col("node_type") == MERCHANT).select(F.count(F.lit(1))).scalar()
    total = n if n is not None else edges.count()
    draws = spark.range(total).select(
        "id", (C.seeded(f"{seed}:c", "id") % nc).alias("src_idx"),
        (C.seeded(f"{seed}:m", "id") % nm).alias("dst_idx"))
    ci = idx.filter(F.col("node_type") == CARD).select(F.col("idx").alias("src_idx"), F.col("node").alias("src"))
    mi = idx.filter(F.col("node_type") == MERCHANT).select(F.col("idx").alias("dst_idx"), F.col("node").alias("dst"))
    return draws.join(ci, "src_idx").join(mi, "dst_idx").select("id", "src", "dst")
