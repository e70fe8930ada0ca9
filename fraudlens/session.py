"""Spark session helpers.

The engine never creates its own cluster topology: on a cluster the caller
hands in a session that already carries the right conf.  ``get_spark`` is the
convenience used by tests, ``bench.py`` and ``__spark_entry__``.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

# Settings every query in this package relies on.
#  * UTC: event timestamps arrive as timestamp_ntz and are turned into epoch
#    seconds; calendar parts must not depend on the host zone.
#  * ANSI: x/0 and bad casts raise, so every division below is guarded.
#  * AQE: coalesces shuffle partitions, splits skewed join partitions and
#    switches sort-merge joins to broadcast when a side turns out small.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Whether the shuffle files of an execution go at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "fraudlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("FRAUDLENS_DRIVER_MEMORY", "16g"),
    })
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when nothing is configured and Spark runs in one process (tests)
    a private folder under the system temp dir is created; on a cluster that
    would be another folder on each machine, so an unset one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises on some versions
            configured = None
    if not configured and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="fraudlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_sources(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once an application: the
    executors need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="fraudlens-src-"), "fraudlens-sources.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as a Parquet table under the session's
    checkpoint directory (a shared folder on a cluster) and reading it back.

    Unlike ``Dataset.checkpoint()``, which evaluates the plan once for the
    action and again to write the RDD checkpoint, the write evaluates it
    once; the re-read table is columnar, so consumers prune columns and push
    filters into the scan.  Never a local checkpoint: the files survive the
    loss of the executors that wrote them.  The shuffle files of the write are
    of no more use after it and go at its end: they would stay until the
    driver's garbage collector happens to find their stages gone."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)  # known: no job to infer it
