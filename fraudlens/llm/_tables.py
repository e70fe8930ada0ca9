"""Small helpers on tables for the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fraudlens
from fraudlens.session import materialize as _written

__all__ = ["documents", "held_out", "materialize", "read", "ship", "tasks"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once an application: the
    executors need not have it installed.  Arrow batches are kept small, as some texts
    are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(fraudlens.__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="fraudlens-src-"), "fraudlens.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 0 modulo 5 (a null id: held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder.  The shuffle files of its write
    go with the write; those of earlier jobs when the driver's garbage collector finds
    their stages gone, which is asked for here, as it may take long otherwise."""
    out = _written(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
