"""Scaler, splits, fusion, hand fixture of the reference's community test."""

import math

from pyspark.sql import functions as F

from fraudlens.operators import community as CM
from fraudlens.operators import graph as G
from fraudlens.operators import learning as L
from fraudlens.sources import files as IO


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "x double, c double")
    out = L.standard_scale(df, ["x", "c"]).collect()
    # population std of [1, 2, 4] is 1.2472 (Spark ML would use the sample std 1.5275)
    assert abs(out[0].x - (1 - 7 / 3) / 1.247219128924647) < 1e-12
    assert all(r.c == 0.0 for r in out)  # constant column: scale 1, centred to 0


def test_global_row_number_matches_sort(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.col("id"))
    got = {r.k: r.idx for r in G.global_row_number(df, ["k"], "idx", partitions=7).collect()}
    assert got == {k: k for k in range(500)}


def test_time_split_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("transaction_id"), (F.col("id") % 97).alias("dt"))
    s = {r.split: r["count"] for r in L.time_split(df).groupBy("split").count().collect()}
    assert s == {"train": 700, "val": 150, "test": 150}


def test_stratified_split_uses_float_truncation(spark):
    df = spark.range(720).select(F.col("id").alias("i"), F.lit(1).alias("y"))
    s = {r.split: r["count"] for r in L.stratified_split(df, "y", "i").groupBy("split").count().collect()}
    assert s["train"] == int(720 * 0.7) == 503


def fixture_communities(spark):
    # Two communities; card_0, card_1 -> 0, card_3 -> 1, card_2 unassigned.
    comm = spark.createDataFrame([("card_0", "card", "0"), ("card_1", "card", "0"),
                                  ("card_3", "card", "1")], "node string, node_type string, community_id string")
    stats = spark.createDataFrame([("0", 0.6, 0.4, 0.8, 0.3, 10, 5, 50), ("1", 0.1, 0.2, 0.3, 0.1, 20, 10, 10 ** 6)],
                                  "community_id string, fraud_rate double, density double, "
                                  "time_concentration double, night_ratio double, num_cards long, num_merchants long, total_transactions long")
    cards = spark.createDataFrame([(f"{i}",) for i in range(4)], "card_id string")
    return comm, stats, cards


def test_card_community_features_fixture(spark):
    comm, stats, cards = fixture_communities(spark)
    out = {r.card_id: r for r in CM.card_community_features(cards, comm, stats).collect()}
    assert [out["0"][f"comm_{i}"] for i in range(6)] == [0.6, 0.4, 0.8, 0.3, 2.0, round(math.log1p(50) / 10, 9)]
    assert out["3"].comm_5 == 1.0
    assert all(out["2"][f"comm_{i}"] == 0.0 for i in range(6))
    assert (out["0"].community_risk, out["2"].community_risk, out["3"].community_risk) == (0.6, 0.05, 0.1)


def test_missing_amount_is_no_round_amount(spark):
    from fraudlens.operators.encodings import clean
    df = spark.createDataFrame([(1, 1, 1, 0, None), (2, 1, 1, 0, 5.0)], "transaction_id long, card1 long, addr1 int, dt long, amt double")
    a, b = clean(df).orderBy("transaction_id").collect()
    assert (a.amt, a.is_round_amt, a.log_amt, a.amt_decimal) == (0.0, 0, None, None) and b.is_round_amt == 1


def test_fusion_predicts_before_rounding(spark):
    from fraudlens.operators import learning as L
    r = L.tri_fusion(spark.createDataFrame([(0.9999994, 0.0, 0.0)], "g double, a double, c double"), "g", "a", "c").first()
    assert (r.fused_score, r.fused_pred) == (0.5, 0)


def test_alpha_fusion_boundaries(spark):
    from fraudlens.functions import columns as C
    df = spark.createDataFrame([(0.9, 0.05)], "p double, r double")
    r = df.select(C.alpha_fusion("p", "r", 1.0).alias("a1"), C.alpha_fusion("p", "r", 0.0).alias("a0")).first()
    assert (r.a1, r.a0) == (0.9, 0.05)


def test_tri_fusion_formula(spark):
    df = spark.createDataFrame([(0.8, 0.5, 0.1)], "g double, a double, c double")
    r = L.tri_fusion(df, "g", "a", "c").first()
    assert abs(r.fused_score - round(0.5 * 0.8 + 0.3 * 0.5 + 0.2 * 0.1, 6)) < 1e-12 and r.fused_pred == 1


def test_community_document_string_counts(spark, tmp_path):
    doc = tmp_path / "communities.json"
    doc.write_text('{"communities": {"0": ["card_1", "merchant_2"]}, "stats": {"0": '
                   '{"total_transactions": 50, "fraud_transactions": "20", "fraud_rate": 0.4, '
                   '"num_cards": 1, "num_merchants": 1}}}')
    stats, members = IO.read_communities_document(spark, str(doc))
    s = stats.first()
    assert s.fraud_transactions == 20 and s.total_transactions == 50
    assert sorted(r.node for r in members.collect()) == ["card_1", "merchant_2"]


def test_borderline_counts(spark):
    train = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, y int")
    val = spark.createDataFrame([(100, 1, 0.5), (101, 1, 0.6), (102, 0, 0.9)], "id long, y int, s double")
    out = L.borderline_shift(train, val, "s", "y", "id", strategy="both", copies=1)
    rows = out.collect()
    assert sum(r.is_copy for r in rows) == 2
    assert sum(1 for r in rows if not r.is_copy and r.weight == 2.0) == 2
    assert all(r.y == 1 for r in rows if r.is_copy)


def test_unseen_node_takes_the_mean_vector(spark):
    edges = spark.createDataFrame([("a", "m"), ("new", "m")], "card_id string, merchant_id string")
    cards = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "card_id string, x double")
    merchants = spark.createDataFrame([("m", 5.0)], "merchant_id string, x double")
    got = {r.card_id: (r.card_emb_x, r.emb_diff_x) for r in L.pair_features(edges, cards, merchants, ["x"]).collect()}
    assert got == {"a": (1.0, -4.0), "new": (2.0, -3.0)}


def test_the_models_get_every_numeric_edge_column(spark):
    from fraudlens.operators import nodes as N
    from fraudlens.plans import learning as PL
    import __spark_entry__ as entry
    entry._prepare(spark)
    got = PL._edge_features(spark, entry.SMOKE_DIR)
    assert got.count() == spark.read.parquet(f"{entry.SMOKE_DIR}/events.parquet").count()
    want = set(N.EDGE_BASE_COLUMNS) - set(N.EDGE_NON_FEATURES)
    assert set(got.columns) == want | {"transaction_id"} and len(want) > 30
    assert PL.MAX_ROUNDS == 2000


def test_kmeans_reads_whole_vectors(spark):
    """Vectors of 70 that differ in the last component only, and a shorter one."""
    from fraudlens.plans import learning as PL
    import __spark_entry__ as entry
    entry._prepare(spark)
    rows = [(i, [1.0] * 69 + [float(i % 2)]) for i in range(40)] + [(40, [1.0] * 69), (41, None)]
    df = spark.createDataFrame(rows[:41], "vec_id bigint, embedding array<float>")
    got = dict(PL._cluster_embeddings(df, k=2).select("vec_id", "cluster").collect())
    assert len({got[i] for i in range(0, 41, 2)}) == 1 and len({got[i] for i in range(1, 40, 2)}) == 1 and got[0] != got[1]
    assert PL._cluster_embeddings(spark.createDataFrame(rows, df.schema), k=2).count() == 42
