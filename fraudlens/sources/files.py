"""File sources and sinks (A1-A10).

Readers always take an explicit schema (no inference pass, stable types);
writers never go through pandas or the driver.  Directories written here
are Spark directories (many part files), readable by Spark or DuckDB.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.session import ensure_checkpoint_dir


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def _is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


# --- A1 / A5: CSV ------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A1: headered CSV with an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A5: headered CSV directory."""
    df.write.mode("overwrite").option("header", True).csv(path)


# --- A2 / A3 / A4: feature tables -----------------------------------------------------
def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A4: overwrite a Parquet directory (optionally partitioned, e.g. by day)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_feature_table(spark: SparkSession, data_dir: str, name: str,
                       csv_schema: T.StructType | str | None = None) -> DataFrame:
    """A2: ``{name}.csv`` when present (needs a schema), else ``{name}.parquet``
    (a file or a Spark directory)."""
    base = data_dir.rstrip("/")
    csv = f"{base}/{name}.csv"
    if csv_schema is not None and finished(spark, csv):
        return read_csv(spark, csv, csv_schema)
    return spark.read.parquet(f"{base}/{name}.parquet")


def pruned_scan(spark: SparkSession, candidates: list[str], wanted: list[str]) -> DataFrame:
    """A3: first existing path wins; keep the wanted columns that exist (the
    projection reaches the Parquet reader as its ReadSchema)."""
    for path in candidates:
        if finished(spark, path):
            df = spark.read.parquet(path)
            present = set(df.columns)
            return df.select(*[c for c in wanted if c in present])
    raise FileNotFoundError(f"none of {candidates} exists")


# --- A6 / A7: JSON ----------------------------------------------------------------------
def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines directory (nested columns stay nested)."""
    df.write.mode("overwrite").json(path)


STATS_FIELDS = [("total_transactions", "count"), ("fraud_transactions", "count"),
                ("fraud_rate", "double"), ("num_cards", "count"), ("num_merchants", "count"),
                ("density", "double"), ("time_concentration", "double"), ("night_ratio", "double"),
                ("amt_mean", "double"), ("amt_std", "double"), ("round_amt_ratio", "double")]


def write_communities(stats: DataFrame, members: DataFrame, path: str) -> None:
    """Community results as JSON Lines - ``stats`` one line per
    community (stats nested in a struct), ``members`` one line per node.
    The reference's single document keeps a community's node list in one
    array; the long form never gathers a community into one task."""
    s = stats.select(F.col("community_id").cast("string").alias("community_id"),
                     F.struct(*[F.col(c) for c, _ in STATS_FIELDS]).alias("stats"))
    write_json(s, f"{path}/stats")
    write_json(members.select(F.col("community_id").cast("string").alias("community_id"), "node"),
               f"{path}/members")


def _stats_struct(numbers_as_text: bool) -> T.StructType:
    def t(kind):
        if kind == "count":
            return T.StringType() if numbers_as_text else T.LongType()
        return T.DoubleType()
    return T.StructType([T.StructField(c, t(k)) for c, k in STATS_FIELDS])


def _cast_stats(col: str) -> list:
    out = []
    for c, kind in STATS_FIELDS:
        v = F.col(f"{col}.{c}")
        # Counts may arrive as text ("20"): tolerant cast, as the reference's int().
        out.append((v.try_cast("double").try_cast("bigint") if kind == "count" else v).alias(c))
    return out


def read_communities(spark: SparkSession, path: str):
    """A7 for the long form written by ``write_communities``: returns
    (stats table, node -> community table); counts read as text and cast."""
    schema = T.StructType([T.StructField("community_id", T.StringType()),
                           T.StructField("stats", _stats_struct(True))])
    stats = spark.read.schema(schema).json(f"{path}/stats")
    stats = stats.select("community_id", *_cast_stats("stats"))
    members = spark.read.schema("community_id string, node string").json(f"{path}/members")
    return stats, members


def read_communities_document(spark: SparkSession, path: str):
    """A7 for the reference's single JSON document
    ``{"communities": {id: [nodes]}, "stats": {id: {...}}, ...}``: a map
    schema, ``explode`` of the maps into (key, value) rows and of the node
    lists into one row per node."""
    schema = T.StructType([
        T.StructField("communities", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("stats", T.MapType(T.StringType(), _stats_struct(True)))])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    stats = doc.select(F.explode("stats").alias("community_id", "s")).select(
        "community_id", *_cast_stats("s"))
    members = doc.select(F.explode("communities").alias("community_id", "nodes")).select(
        "community_id", F.explode("nodes").alias("node"))
    return stats, members


# --- A8: model metric files -----------------------------------------------------------------
METRIC_NAMES = ("auc", "ap", "precision", "recall", "f1")


def collect_model_metrics(spark: SparkSession, candidates: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Model, source and the metrics of each model whose file has them all.

    Per model the first candidate (path, section) that exists decides: a model
    whose file lacks the section or a metric is left out, later candidates are not
    tried.  Files may be indented (one JSON object over many lines)."""
    metric = T.StructType([T.StructField(m, T.DoubleType()) for m in METRIC_NAMES])
    out = spark.createDataFrame([], "model string, source string, " + ", ".join(f"{m} double" for m in METRIC_NAMES))
    for model, own in candidates.items():  # configuration: a handful of entries
        found = next(((p, s) for p, s in own if _exists(spark, p)), None)
        if found:
            path, section = found
            one = spark.read.schema(T.StructType([T.StructField(section, metric)])).option("multiLine", True).json(path)
            out = out.unionByName(one.select(F.lit(model).alias("model"), F.lit(path).alias("source"),
                                             *[F.col(f"{section}.{m}").alias(m) for m in METRIC_NAMES]))
    return out.dropna(subset=list(METRIC_NAMES))


# --- A9: stage reuse -------------------------------------------------------------------------------
def finished(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet file, or a directory that its writer has completed, is there."""
    return _exists(spark, f"{path}/_SUCCESS") or (_exists(spark, path) and not _is_dir(spark, path))


def stage(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the stage's Parquet output if it is complete, else build, write, read."""
    if not finished(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def shared_stage(spark: SparkSession, name: str, inputs: list[str], params: tuple, build) -> DataFrame:
    """A9 across queries: one table a session for an operator, its parameters and the state
    of its input files (path, length, time of change); a changed, added or lost file gives
    another table.  It lies under the checkpoint folder and is rebuilt if its writer did
    not complete it.  One row of the listing reaches the driver, however many the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs).select(
        "path", "length", "modificationTime")
    state = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime")),
                      F.sum("length")).first()
    key = hashlib.sha256(repr((spark.sparkContext.applicationId, name, sorted(inputs), params, tuple(state))).encode())
    return stage(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/shared/{name}-{key.hexdigest()[:32]}", build)


# --- A10: embeddings ------------------------------------------------------------------------------
def write_embeddings(df: DataFrame, key: str, cols: list[str], path: str, node_type: str) -> None:
    """A10: node vectors as ``array<double>`` Parquet, one directory per type."""
    write_parquet(df.select(F.col(key).alias("node"), F.array(*cols).alias("embedding")),
                  f"{path}/{node_type}")


def read_embeddings(spark: SparkSession, path: str, node_type: str) -> DataFrame:
    return spark.read.schema("node string, embedding array<double>").parquet(f"{path}/{node_type}")
