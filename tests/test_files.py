"""Metric files (A8), stage reuse (A9), feature tables (A2, A3) and the checkpoint folder."""

import json

import pytest

from fraudlens.sources import files as IO

FULL = {"auc": 0.9, "ap": 0.5, "precision": 0.25, "recall": 0.75, "f1": 0.375}


def write(path, obj):
    path.write_text(json.dumps(obj, indent=2))
    return str(path)


def test_first_existing_metric_file_decides(spark, tmp_path):
    part = {k: v for k, v in FULL.items() if k != "recall"}
    good = write(tmp_path / "good.json", {"fusion": FULL, "baseline": {**FULL, "auc": 0.5}})
    bad = write(tmp_path / "bad.json", {"fusion": part})
    got = {r.model: r for r in IO.collect_model_metrics(spark, {
        "a": [(f"{tmp_path}/none.json", "fusion"), (good, "fusion"), (bad, "fusion")],
        "b": [(good, "baseline")],
        "c": [(bad, "fusion"), (good, "fusion")],
        "d": [(f"{tmp_path}/none.json", "fusion")]}).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].source == good and got["a"].recall == 0.75 and got["b"].auc == 0.5


def test_unfinished_stage_is_built_again(spark, tmp_path):
    path = f"{tmp_path}/stage.parquet"
    (tmp_path / "stage.parquet" / "_temporary").mkdir(parents=True)
    build = lambda: spark.range(3)
    assert IO.stage(spark, path, build).count() == 3
    assert IO.stage(spark, path, lambda: 1 / 0).count() == 3


def test_feature_table_prefers_a_finished_csv(spark, tmp_path):
    IO.write_parquet(spark.range(5).selectExpr("id AS a", "id AS b"), f"{tmp_path}/t.parquet")
    assert IO.read_feature_table(spark, str(tmp_path), "t", "a bigint").count() == 5
    IO.write_csv(spark.range(2).selectExpr("id AS a"), f"{tmp_path}/t.csv")
    assert IO.read_feature_table(spark, str(tmp_path), "t", "a bigint").count() == 2
    assert IO.pruned_scan(spark, [f"{tmp_path}/x.parquet", f"{tmp_path}/t.parquet"], ["b", "z"]).columns == ["b"]


def test_checkpoint_folder_is_needed_on_a_cluster():
    from fraudlens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_materialize_leaves_no_shuffle_files(spark):
    import glob

    from pyspark.sql import functions as F

    from fraudlens.session import SHUFFLE_CLEANUP, materialize

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}

    before, kept = files(), spark.conf.get(SHUFFLE_CLEANUP)
    t = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert not files() - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == kept
    assert t.count() == 7
