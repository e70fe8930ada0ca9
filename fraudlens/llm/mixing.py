"""Mixing sources to target weights, by fixed-length blocks of words.

Every source's documents stand on one line of words, in the order of a hash of
their ids, and the line is cut to blocks of ``block`` words.  A source whose target
is ``e`` times its size and a rest gives ``e`` whole passes and a last pass that
stops at the target.  Each pass is a sequence of slots.  Slots are dealt to output
shards: every slot draws its shard, so a source's counts over the shards are a
multinomial draw; the counts then give each shard its range of the source's slots.
A pseudorandom permutation of the source's block numbers (another one in each pass)
maps a slot to its block, and the blocks are joined with the documents' pieces by
source and block number.

Targets are filled like water: a source gets its weight's share of ``budget`` times
all words, at most ``most`` times its own, and what it cannot take is shared again.

Only DataFrame functions are used.  Running sums go through (source, hash bucket)
sums first, so a source that holds a third of the rows is no task of its own.

Defined cases: a null text has no words; a null source is a source of its own, the
last one; a document without words takes none; repeated rows are rows of their own;
a source without words has target 0; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm._tables import materialize, tasks

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, target (in words)."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on.
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Sources in the order in which a rising level fills them: those before the
    # first one that the level leaves below its cap are full.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    own = own.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    own = own.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return own.select("source", "source_size", target.alias("target"))


def _name(source: Column) -> Column:
    """A join key for a source: null has a value of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _lines(docs: DataFrame) -> DataFrame:
    """``docs`` (name, key, size, ...) and ``at``, the place of a document's first word
    on its source's line."""
    buckets = 4 * tasks(docs.sparkSession)
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit("line")), F.lit(buckets)))
    sums = docs.groupBy("name", "bucket").agg(F.sum("size").alias("n"))
    start = sums.select("name", "bucket", (F.sum("n").over(Window.partitionBy("name").orderBy("bucket")) - F.col("n")).alias("start"))
    within = Window.partitionBy("name", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (docs.withColumn("upto", F.sum("size").over(within)).join(start, ["name", "bucket"])
            .withColumn("at", F.col("start") + F.col("upto") - F.col("size")).drop("bucket", "upto", "start"))


def _permuted(slot: Column, n: Column, salt: Column) -> Column:
    """The place of ``slot`` under a pseudorandom permutation of 0..n-1: a Feistel
    network on the pairs below a*b >= n, walked until the value is below n.  A walk
    leaves 0..n-1 for a*b-n < a values at most; 64 steps are enough for n below 4096,
    and beyond that a walk that long has a chance under 64^-64."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.ceil(n / a).cast("bigint")

    def step(x: Column) -> Column:
        left, right = F.floor(x / b).cast("bigint"), F.pmod(x, b)
        for i in range(0, 4, 2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, salt, F.lit(i)), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, salt, F.lit(i + 1)), b), b)
        return left * b + right

    walk = F.sequence(F.lit(1), F.least(a * b - n + 1, F.lit(64)).cast("int"))
    return F.aggregate(walk, F.struct(slot.cast("bigint").alias("x"), F.lit(False).alias("done")),
                       lambda s, _: F.when(s["done"], s).otherwise(_stepped(step(s["x"]), n)))["x"]


def _stepped(x: Column, n: Column) -> Column:
    # bind x once: a lambda variable is evaluated a single time
    return F.element_at(F.transform(F.array(x), lambda v: F.struct(v.alias("x"), (v < n).alias("done"))), 1)


def place_slots(targets: DataFrame, block: int, shard_words: int, seed: int) -> DataFrame:
    """One row a slot: name, pass, shard, slot, block_no and ``words``, how many of the
    block's words the mix takes (the last slot of a target may stop early)."""
    spark = targets.sparkSession
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, -int(-words // shard_words))
    plan = (targets.filter("source_size > 0").withColumn("name", _name(F.col("source")))
            .withColumn("take", F.floor(F.col("target") + 0.5).cast("bigint"))
            .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("bigint"))
            .withColumn("whole", F.floor(F.col("take") / F.col("source_size")).cast("bigint"))
            .withColumn("rest", F.col("take") - F.col("whole") * F.col("source_size"))
            .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))))
            .withColumn("need", F.when(F.col("pass") < F.col("whole"), F.col("source_size")).otherwise(F.col("rest")))
            .filter("need > 0")
            # one slot more than the words fill: the source's short last block may come early
            .withColumn("slots", F.least(F.col("blocks"), F.ceil(F.col("need") / F.lit(block)).cast("bigint") + 1))
            .withColumn("salt", F.xxhash64(F.lit(seed), F.col("name"), F.col("pass"))))
    # The draw: every slot picks a shard.  Slots are made in runs of 1024, so that a
    # large source's are made by many tasks.
    run = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / 1024).cast("bigint")))
    one = F.explode(F.sequence(F.col("run") * 1024, F.least(F.col("run") * 1024 + 1023, F.col("slots") - 1)))
    drawn = (plan.withColumn("run", run).repartition(tasks(spark), "name", "pass", "run").withColumn("draw", one)
             .withColumn("shard", F.pmod(F.xxhash64("salt", "draw", F.lit("shard")), F.lit(shards))))
    counts = drawn.groupBy("name", "pass", "salt", "blocks", "need", "source_size", "shard").agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.partitionBy("name", "pass").orderBy("shard")) - F.col("n")
    slots = (counts.withColumn("first", first).repartition(tasks(spark), "name", "pass", "shard")
             .withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
             .withColumn("block_no", _permuted(F.col("slot"), F.col("blocks"), F.col("salt"))))
    slots = materialize(slots, "mix-slots")
    # Words before a slot: full blocks, but for the source's short last one if that came earlier.
    last = F.col("blocks") - 1
    short = F.col("blocks") * block - F.col("source_size")
    early = slots.filter(F.col("block_no") == last).select("name", "pass", F.col("slot").alias("short_slot"))
    slots = slots.join(early, ["name", "pass"], "left")
    begun = F.col("slot") * block - F.when(F.col("short_slot") < F.col("slot"), short).otherwise(0)
    length = F.when(F.col("block_no") == last, block - short).otherwise(F.lit(block))
    return (slots.withColumn("words", F.least(length, F.col("need") - begun).cast("bigint")).filter("words > 0")
            .select("name", "pass", "shard", "slot", "block_no", "words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, block: int = 128,
        shard_words: int = 1 << 22, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces).

    rows: key, copy, doc_id, size, source_size, target of every row of ``docs``.
    pieces: key, copy, pass, shard, slot, from_word, to_word: the words (from 0) of a
    row that a slot takes.  ``document_key`` makes the key; ``copy`` counts rows that
    agree in id, source and text."""
    sized = materialize(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), document_key().alias("key")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, budget, most), "mix-targets")
    copy = F.row_number().over(Window.partitionBy("key").orderBy("size")).cast("bigint") - 1
    rows = (sized.withColumn("name", _name(F.col("source"))).withColumn("copy", copy)
            .join(targets.withColumn("name", _name(F.col("source"))).drop("source"), "name"))
    lines = _lines(rows.filter("size > 0").select("name", F.struct("key", "copy").alias("key"), "size"))
    ends = [F.floor(F.col("at") / block).cast("bigint"), F.floor((F.col("at") + F.col("size") - 1) / block).cast("bigint")]
    parts = lines.withColumn("block_no", F.explode(F.sequence(*ends)))
    pieces = (parts.join(place_slots(targets, block, shard_words, seed), ["name", "block_no"])
              .withColumn("from_word", F.greatest(F.lit(0).cast("bigint"), F.col("block_no") * block - F.col("at")))
              .withColumn("to_word", F.least(F.col("size"), F.col("block_no") * block + F.col("words") - F.col("at")))
              .filter("to_word > from_word")
              .select("key.key", "key.copy", "pass", "shard", "slot", "from_word", "to_word"))
    return rows.select("key", "copy", "doc_id", "size", "source_size", "target"), pieces


def document_key() -> Column:
    """A row's id, source and text as one join key (never null)."""
    return F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("doc_id", "source", "text")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs``: doc_id, size, source_size, target, taken (words)."""
    rows, pieces = mix(docs, **options)
    taken = pieces.groupBy("key", "copy").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return (rows.join(taken, ["key", "copy"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")))


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes
    words of a row.  A row that is taken whole keeps its text; one that is taken in
    part holds its taken words, in text order, joined by a space."""
    _, pieces = mix(docs, **options)
    uses = (pieces.groupBy("key", "copy", "pass").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("ranges")))  # at most a document's blocks
    copy = F.row_number().over(Window.partitionBy("key").orderBy("doc_id")).cast("bigint") - 1
    own = docs.withColumn("key", document_key()).withColumn("copy", copy)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    part = F.flatten(F.transform("ranges", lambda r: F.slice(
        F.col("words"), (r["from_word"] + 1).cast("int"), (r["to_word"] - r["from_word"]).cast("int"))))
    text = F.when(F.col("taken") == F.size("words"), F.col("text")).otherwise(F.array_join(part, " "))
    names = docs.columns
    mixed = uses.join(own, ["key", "copy"]).withColumn("words", words).withColumn("text", text)
    if "n_chars" in names:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("bigint"))
    return mixed.select(*names)
