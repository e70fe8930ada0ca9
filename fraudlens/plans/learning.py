"""Registered learning-data, model and fusion queries (E10, E11, F10, H1, I9,
J2-J14, B25-B27, B29, B31-B33, C9, D6, D10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.operators import community as CM
from fraudlens.operators import graph as G
from fraudlens.operators import learning as L
from fraudlens.operators import metrics as M
from fraudlens.operators import nodes as N
from fraudlens.operators import scoring as SC
from fraudlens.operators.enrich import enriched_transactions
from fraudlens.plans import graph as PG
from fraudlens.plans import sql as S
from fraudlens.plans.metrics import SCORE_SQL, scored
from fraudlens.plans.registry import TX_SQL, register
from fraudlens.session import ensure_checkpoint_dir, materialize
from fraudlens.sources.tables import read_table, transactions
from fraudlens.streaming import pipelines as P

FEATS = PG.NODE_FEATS


def _card_feats(spark, sf_dir):
    return PG._node_features(PG._tx(spark, sf_dir), "card_id")


@register("standard_scaled", S.ctes(TX_SQL, PG.NODE_FEAT_SQL, "p AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
    for c in FEATS) + " FROM cf)") + "SELECT card_id, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 9) AS {c}" for c in FEATS) + " FROM cf, p")
def standard_scaled(spark, sf_dir):
    """E10 + B13: population-std scaling (constant column -> scale 1)."""
    s = L.standard_scale(_card_feats(spark, sf_dir), FEATS)
    return s.select("card_id", *[F.round(c, 9).alias(c) for c in FEATS])


SPLIT_SQL = """
pos AS (SELECT transaction_id, is_fraud, dt, row_number() OVER (ORDER BY dt, transaction_id) - 1 AS p,
               count(*) OVER () AS n FROM tx),
spl AS (SELECT transaction_id, is_fraud, CASE WHEN p < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
          WHEN p < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM pos)"""


def _time_split(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("transaction_id", "dt", "is_fraud")
    return L.time_split(tx)


@register("time_split", S.ctes(TX_SQL, SPLIT_SQL) + "SELECT transaction_id, split FROM spl")
def time_split(spark, sf_dir):
    """70 / 15 / 15 split by time order (ties by id)."""
    return _time_split(spark, sf_dir).select("transaction_id", "split")


@register("split_stats", S.ctes(TX_SQL, SPLIT_SQL) + """
SELECT split, count(*) AS size, avg(is_fraud) AS fraud_rate FROM spl GROUP BY split""")
def split_stats(spark, sf_dir):
    """Size and fraud rate per split."""
    return L.split_stats(_time_split(spark, sf_dir))


def _strat(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("transaction_id", "is_fraud")
    return L.stratified_split(tx, "is_fraud", "transaction_id", seed=42)


@register("stratified_split", S.ctes(TX_SQL, f"""
pos AS (SELECT transaction_id, is_fraud, count(*) OVER (PARTITION BY is_fraud) AS n,
               row_number() OVER (PARTITION BY is_fraud ORDER BY {S.seeded(42, 'transaction_id')}, transaction_id) - 1 AS p FROM tx)""") + """
SELECT transaction_id, is_fraud, CASE WHEN p < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
       WHEN p < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM pos""")
def stratified_split(spark, sf_dir):
    """Stratified 70 / 15 / 15 split in seeded hash order."""
    return _strat(spark, sf_dir)


@register("stratified_split_sizes", S.ctes(TX_SQL, """
c AS (SELECT is_fraud, count(*) AS n FROM tx GROUP BY is_fraud),
s AS (SELECT is_fraud, 'train' AS split, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS size FROM c
      UNION ALL SELECT is_fraud, 'val', CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) FROM c
      UNION ALL SELECT is_fraud, 'test', CAST(n - floor(n * CAST(0.7 AS DOUBLE)) - floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) FROM c)""")
    + "SELECT is_fraud, split, size FROM s WHERE size > 0")
def stratified_split_sizes(spark, sf_dir):
    """Per-label split sizes (independent of the hash order)."""
    return _strat(spark, sf_dir).groupBy("is_fraud", "split").agg(F.count(F.lit(1)).alias("size"))


def _borderline(spark, sf_dir):
    sp = _time_split(spark, sf_dir).join(scored(spark, sf_dir).select("transaction_id", "score"),
                                         "transaction_id")
    train = sp.filter(F.col("split") == "train")
    val = sp.filter(F.col("split") == "val")
    return L.borderline_shift(train, val, "score", "is_fraud", "transaction_id")


@register("borderline_shift", S.ctes(TX_SQL, SPLIT_SQL, SCORE_SQL, f"""
j AS (SELECT spl.*, sc.score FROM spl JOIN sc ON spl.transaction_id = sc.transaction_id),
need AS (SELECT is_fraud, count(*) AS need FROM j WHERE split = 'val' AND score BETWEEN 0.3 AND 0.7 GROUP BY is_fraud),
tr AS (SELECT transaction_id, is_fraud, count(*) OVER (PARTITION BY is_fraud) AS pool,
              row_number() OVER (PARTITION BY is_fraud ORDER BY {S.seeded(42, 'transaction_id')}, transaction_id) - 1 AS p
       FROM j WHERE split = 'train'),
pk AS (SELECT tr.transaction_id, tr.is_fraud,
              coalesce(need, 0) // pool + CASE WHEN p < coalesce(need, 0) % pool THEN 1 ELSE 0 END AS picks
       FROM tr LEFT JOIN need ON need.is_fraud = tr.is_fraud)""") + """
SELECT transaction_id, is_fraud, CASE WHEN picks > 0 THEN 2.0 ELSE CAST(1.0 AS DOUBLE) END AS weight, FALSE AS is_copy FROM pk
UNION ALL
SELECT transaction_id, is_fraud, CAST(2.0 AS DOUBLE) AS weight, TRUE AS is_copy
FROM (SELECT transaction_id, is_fraud, unnest(range(picks)) AS r FROM pk)""")
def borderline_shift(spark, sf_dir):
    """J8 + C9 + H2: borderline-matched training rows reweighted and copied."""
    return _borderline(spark, sf_dir).select("transaction_id", "is_fraud", "weight", "is_copy")


@register("borderline_summary", S.ctes(TX_SQL, SPLIT_SQL, SCORE_SQL, """
j AS (SELECT spl.*, sc.score FROM spl JOIN sc ON spl.transaction_id = sc.transaction_id),
need AS (SELECT is_fraud, count(*) AS need FROM j WHERE split = 'val' AND score BETWEEN 0.3 AND 0.7
         GROUP BY is_fraud),
pool AS (SELECT is_fraud, count(*) AS pool FROM j WHERE split = 'train' GROUP BY is_fraud)""") + """
SELECT pool.is_fraud, pool AS train_rows, CAST(least(coalesce(need, 0), pool) AS BIGINT) AS weighted_rows,
       CAST(coalesce(need, 0) AS BIGINT) AS copy_rows
FROM pool LEFT JOIN need ON pool.is_fraud = need.is_fraud""")
def borderline_summary(spark, sf_dir):
    """Rows, reweighted rows and copies per label after borderline shifting."""
    b = _borderline(spark, sf_dir)
    return b.groupBy("is_fraud").agg(
        F.sum(F.when(~F.col("is_copy"), 1).otherwise(0)).cast("bigint").alias("train_rows"),
        F.sum(F.when(~F.col("is_copy") & (F.col("weight") > 1), 1).otherwise(0)).cast("bigint").alias("weighted_rows"),
        F.sum(F.when(F.col("is_copy"), 1).otherwise(0)).cast("bigint").alias("copy_rows"))


# ---------------------------------------------------------------------------
# Tri-signal fusion (J10): score + reconstruction anomaly + community risk
# ---------------------------------------------------------------------------
def _edge_anomaly(spark, sf_dir):
    tx = PG._tx(spark, sf_dir)
    edges = G.bipartite_edges(tx)
    cf = PG._node_features(tx, "card_id")
    m1 = G.neighbour_mean(edges, cf, "card_id", "merchant_id", FEATS)
    zc = cf.select("card_id", C.vec_cosine_normalise(F.array(*FEATS)).alias("z"))
    zm = m1.select("merchant_id", C.vec_cosine_normalise(F.array(*FEATS)).alias("z"))
    return G.reconstruction_anomaly(edges, zc, zm).select("card_id", "merchant_id", "anomaly")


ANOMALY_SQL = ",\n".join([PG._mean_sql("cf", "card_id", "merchant_id", "am1"),
                          PG._norm_sql("cf", "card_id", "zc"), PG._norm_sql("am1", "merchant_id", "zm"),
                          "an AS (SELECT e.card_id, e.merchant_id, 1 - 1 / (1 + exp(-("
                          + " + ".join(f"zc.{c} * zm.{c}" for c in FEATS)
                          + "))) AS anomaly FROM e JOIN zc ON zc.card_id = e.card_id "
                          "JOIN zm ON zm.merchant_id = e.merchant_id)"])


@register("tri_fusion", PG.graph_sql(PG.STATS_SQL, PG.NODE_FEAT_SQL, ANOMALY_SQL, SPLIT_SQL, SCORE_SQL, """
t AS (
  SELECT tx.transaction_id, tx.is_fraud AS label, sc.score AS gnn_prob, an.anomaly,
         coalesce(sus.risk_score, 0.0) AS comm_risk
  FROM tx JOIN spl ON spl.transaction_id = tx.transaction_id AND spl.split = 'test'
  JOIN sc ON sc.transaction_id = tx.transaction_id
  JOIN an ON an.card_id = tx.card_id AND an.merchant_id = tx.merchant_id
  LEFT JOIN comm cc ON cc.node = 'card_' || tx.card_id
  LEFT JOIN (SELECT * FROM rk WHERE fraud_rate >= 0.02 AND total_transactions >= 100 AND num_cards >= 10) sus
         ON sus.community_id = cc.community_id),
t2 AS (SELECT *, (anomaly - (SELECT min(anomaly) FROM t)) /
                 ((SELECT max(anomaly) FROM t) - (SELECT min(anomaly) FROM t) + 1e-8) AS ae FROM t)""", resolution=1.5) + """
SELECT transaction_id, label, round(gnn_prob, 6) AS gnn_prob, round(ae, 6) AS ae_score,
       round(comm_risk, 6) AS comm_risk,
       round(least(greatest(0.0 + 0.5 * gnn_prob + 0.3 * ae + 0.2 * comm_risk, 0.0), 1.0), 6) AS fused_score,
       CASE WHEN least(greatest(0.0 + 0.5 * gnn_prob + 0.3 * ae + 0.2 * comm_risk, 0.0), 1.0) >= 0.5
            THEN 1 ELSE 0 END AS fused_pred
FROM t2""")
def tri_fusion(spark, sf_dir):
    """J10 + B27 + B29 + D9 + I15: weighted fusion on the test split."""
    comm = PG._communities(spark, sf_dir, resolution=1.5)  # fixed value of the fusion
    stats = PG._stats(spark, sf_dir, comm)
    tx = PG._tx(spark, sf_dir)
    cards = CM.card_suspicious_risk(tx.select("card_id").distinct(), comm, stats, **CM.SUSPICIOUS_PIPELINE)
    test = _time_split(spark, sf_dir).filter(F.col("split") == "test").select("transaction_id")
    t = (tx.join(test, "transaction_id")
           .join(scored(spark, sf_dir).select("transaction_id", F.col("score").alias("gnn_prob")), "transaction_id")
           .join(_edge_anomaly(spark, sf_dir), ["card_id", "merchant_id"])
           .join(cards, "card_id", "left"))
    t = L.min_max(t, "anomaly", "ae")
    f = L.tri_fusion(t.fillna(0.0, ["comm_risk"]), "gnn_prob", "ae", "comm_risk")
    return f.select("transaction_id", F.col("is_fraud").alias("label"),
                    F.round("gnn_prob", 6).alias("gnn_prob"), F.round("ae", 6).alias("ae_score"),
                    F.round("comm_risk", 6).alias("comm_risk"), "fused_score", "fused_pred")


# ---------------------------------------------------------------------------
# Hybrid features (J5): propagated node vectors, pair features, community features
# ---------------------------------------------------------------------------
def _embeddings(spark, sf_dir):
    tx = PG._tx(spark, sf_dir)
    c, m = G.propagate(G.bipartite_edges(tx), PG._node_features(tx, "card_id"),
                       PG._node_features(tx, "merchant_id"), FEATS, 2)
    return (c.select("card_id", *[F.round(x, 9).alias(x) for x in FEATS]),
            m.select("merchant_id", *[F.round(x, 9).alias(x) for x in FEATS]))


PROP_SQL = ",\n".join([PG._mean_sql("cf", "card_id", "merchant_id", "pm1a"),
                       PG._mean_sql("mf", "merchant_id", "card_id", "pc1a"),
                       PG._relu_sql("pm1a", "merchant_id", "pm1"), PG._relu_sql("pc1a", "card_id", "pc1"),
                       PG._mean_sql("pc1", "card_id", "merchant_id", "pm2r"),
                       PG._mean_sql("pm1", "merchant_id", "card_id", "pc2r"),
                       "pc2 AS (SELECT card_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in FEATS) + " FROM pc2r)",
                       "pm2 AS (SELECT merchant_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in FEATS) + " FROM pm2r)"])

HYBRID_COLS = ([f"card_emb_{c}" for c in FEATS] + [f"merchant_emb_{c}" for c in FEATS]
               + [f"emb_diff_{c}" for c in FEATS] + [f"emb_prod_{c}" for c in FEATS])


def _hybrid(spark, sf_dir):
    tx = PG._tx(spark, sf_dir)
    ce, me = _embeddings(spark, sf_dir)
    cards = _card_communities(spark, sf_dir)
    return _with_communities(L.pair_features(tx, ce, me, FEATS), cards)


def _card_communities(spark, sf_dir, train=None):
    """Community features of every card; with ``train`` (transaction_id) the statistics
    are those of these rows alone, so no label of another split enters them."""
    comm = PG._communities(spark, sf_dir)
    tx = PG._tx(spark, sf_dir)
    own = tx if train is None else tx.join(train, "transaction_id", "left_semi")
    stats = CM.with_risk(CM.community_stats(own.withColumn("hour", C.hour_of_day("dt")), comm, "hour"))
    return CM.card_community_features(tx.select("card_id").distinct(), comm, stats)


def _with_communities(pf, cards):
    return pf.join(cards.drop("community_id", "community_risk"), "card_id", "left") \
             .fillna(0.0, [f"comm_{i}" for i in range(6)])


@register("hybrid_features", PG.graph_sql(PG.STATS_SQL, PG.NODE_FEAT_SQL, PROP_SQL) + "SELECT tx.transaction_id, "
    + ", ".join(f"pc2.{c} AS card_emb_{c}" for c in FEATS) + ", "
    + ", ".join(f"pm2.{c} AS merchant_emb_{c}" for c in FEATS) + ", "
    + ", ".join(f"pc2.{c} - pm2.{c} AS emb_diff_{c}" for c in FEATS) + ", "
    + ", ".join(f"pc2.{c} * pm2.{c} AS emb_prod_{c}" for c in FEATS) + """, tx.amt,
  coalesce(CAST(rk.fraud_rate AS DOUBLE), 0.0) AS comm_0, coalesce(CAST(rk.density AS DOUBLE), 0.0) AS comm_1,
  coalesce(CAST(rk.time_concentration AS DOUBLE), 0.0) AS comm_2, coalesce(CAST(rk.night_ratio AS DOUBLE), 0.0) AS comm_3,
  coalesce(CAST(rk.num_cards AS DOUBLE) / greatest(rk.num_merchants, 1), 0.0) AS comm_4,
  coalesce(round(least(ln(1 + rk.total_transactions) / 10.0, 1.0), 9), 0.0) AS comm_5
FROM tx JOIN pc2 ON pc2.card_id = tx.card_id JOIN pm2 ON pm2.merchant_id = tx.merchant_id
LEFT JOIN comm cc ON cc.node = 'card_' || tx.card_id LEFT JOIN rk ON rk.community_id = cc.community_id""")
def hybrid_features(spark, sf_dir):
    """J5 + D6 + B25 + D8 + D10: node vectors, diff / product and community features per edge."""
    h = _hybrid(spark, sf_dir)
    return h.select("transaction_id", *HYBRID_COLS, "amt", *[f"comm_{i}" for i in range(6)])


#: Upper bound of the boosting rounds, and how many without a better validation AP end
#: them.  The reference waits 100 rounds; a round of Spark ML takes about a second however
#: few the rows, so the queries wait less.
MAX_ROUNDS = 2000
PATIENCE = 20


def _edge_features(spark, sf_dir):
    """transaction_id and every numeric column of the edge table that is a feature."""
    e = N.edge_table(enriched_transactions(spark, sf_dir))
    kinds = ("double", "float", "bigint", "int")
    return e.select("transaction_id", *[c for c, kind in e.dtypes if kind in kinds and c not in N.EDGE_NON_FEATURES])


def _hybrid_table(spark, sf_dir):
    """(transaction_id, split, is_fraud and every feature of a transaction, the names of the
    edge features): written once, for all models that are made of it."""
    edges = _edge_features(spark, sf_dir)
    split = materialize(_time_split(spark, sf_dir).select("transaction_id", "split"), "hybrid-split")
    ce, me = (materialize(t, "hybrid-vectors") for t in _embeddings(spark, sf_dir))
    cards = materialize(_card_communities(spark, sf_dir, split.filter("split = 'train'")), "hybrid-communities")
    h = _with_communities(L.pair_features(PG._tx(spark, sf_dir), ce, me, FEATS), cards)
    own = [c for c in edges.columns if c != "transaction_id"]
    h = h.drop("amt", "dt").join(edges, "transaction_id").join(split, "transaction_id")
    h = materialize(h.select("transaction_id", "split", "is_fraud", *HYBRID_COLS, *[f"comm_{i}" for i in range(6)], *own), "hybrid-features")
    return h, own, (ce, me, cards)


def _fit(h, names, patience=PATIENCE, **params):
    """Scaler fitted on train only (E10), class weight, boosting that ends on validation AP,
    threshold from the validation sweep: (model, scaled vectors, threshold, rounds, AP)."""
    train = h.filter(F.col("split") == "train")
    cw = M.class_weight(train.select(F.col("is_fraud").alias("label"))).select("class_weight").scalar()
    scaled = L.scale_by(h, names, L.scaler_params(train, names).first()).withColumn("w", F.when(F.col("is_fraud") == 1, F.coalesce(cw, F.lit(1.0))).otherwise(1.0))
    data = materialize(L.assemble(scaled, names).select("transaction_id", "split", "is_fraud", "w", "features"), "hybrid-vectors")
    val = data.filter(F.col("split") == "val")
    model, rounds, ap = L.train_gbt_by_ap(data.filter(F.col("split") == "train"), val, "is_fraud", "w", patience=patience, max_rounds=MAX_ROUNDS, **params)
    sweep = L.positive_probability(model, val).select(F.col("prob").alias("score"), F.col("is_fraud").alias("label"))
    threshold = M.best_threshold(M.threshold_sweep(sweep)).select("best_threshold").first()[0]
    return model, data, threshold, rounds, ap


def _test_metrics(model, data, threshold, ap):
    """Test metrics of a model, with its threshold, its number of trees and the validation
    AP that chose it."""
    test = L.positive_probability(model, data.filter(F.col("split") == "test"))
    ev = M.evaluate(test.select(F.col("prob").alias("score"), F.col("is_fraud").alias("label")), threshold=threshold)
    return ev.withColumns({"threshold": F.lit(threshold), "trees": F.lit(model.getNumTrees), "val_ap": F.round(F.lit(ap), 9)})


HYBRID_NAMES = HYBRID_COLS + [f"comm_{i}" for i in range(6)]


@register("gbt_model")
def gbt_model(spark, sf_dir):
    """J3 + J9 + J14 + E31: boosted trees on hybrid features, as many as validation AP
    asks for, threshold from the validation sweep, persisted and reloaded, test metrics
    (rows-only)."""
    h, edges, _ = _hybrid_table(spark, sf_dir)
    names = HYBRID_NAMES + edges
    model, data, threshold, _, ap = _fit(h, names)
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/models/hybrid-gbt-{uuid.uuid4().hex}"
    L.save_model(model, path, threshold, names)
    model, threshold, _ = L.load_model(path)
    return _test_metrics(model, data, threshold, ap)


@register("gbt_importances")
def gbt_importances(spark, sf_dir):
    """J12 + G6: top-30 feature importances normalised by the maximum (rows-only)."""
    h, edges, _ = _hybrid_table(spark, sf_dir)
    model, *_ = _fit(h, HYBRID_NAMES + edges)
    return L.importances(model, HYBRID_NAMES + edges, 30)


@register("gbt_comparator")
def gbt_comparator(spark, sf_dir):
    """J4 + J11 + H3: embeddings-only vs embeddings + community features, one metrics row
    per variant, of models on one feature table (rows-only)."""
    h, edges, _ = _hybrid_table(spark, sf_dir)
    out = None
    for name, cols in {"embeddings": HYBRID_COLS + edges, "embeddings+community": HYBRID_NAMES + edges}.items():
        model, data, threshold, _, ap = _fit(h, cols, **L.GBT_LIGHT)
        ev = _test_metrics(model, data, threshold, ap).withColumn("variant", F.lit(name))
        out = ev if out is None else out.unionByName(ev)
    return out


#: What an incoming transaction tells by itself and by its card's history in the stream.
STREAM_COLS = ["amt", "hour", "tx_1h", "tx_24h", "gap", "new_card", "burst"]


def stream_pipeline(spark, sf_dir, patience=PATIENCE):
    """The pipeline that scores incoming transactions, trained on the earliest 70 %: node
    vectors, community features and what the row and its card's history tell; saved and
    loaded again (J14)."""
    split = materialize(_time_split(spark, sf_dir).select("transaction_id", "split"), "stream-split")
    ce, me = (materialize(t, "stream-vectors") for t in _embeddings(spark, sf_dir))
    cards = materialize(_card_communities(spark, sf_dir, split.filter("split = 'train'")), "stream-communities")
    tx = PG._tx(spark, sf_dir)
    rows = tx.join(P.velocity_table(tx), "transaction_id").withColumn("hour", C.hour_of_day("dt"))
    h = _with_communities(L.pair_features(rows, ce, me, FEATS), cards).join(split, "transaction_id")
    names = HYBRID_NAMES + STREAM_COLS
    h = materialize(h.select("transaction_id", "split", "is_fraud", *names), "stream-features")
    model, _, threshold, _, _ = _fit(h, names, patience)
    made = SC.make_pipeline(model, names, threshold, h.filter("split = 'train'"), ce, me, cards.drop("community_id", "community_risk"), FEATS)
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/models/stream-{uuid.uuid4().hex}"
    SC.save_pipeline(made, path)
    return SC.load_pipeline(spark, path)


@register("stream_model_scoring")
def stream_model_scoring(spark, sf_dir):
    """J13 + J14 + L1: every transaction scored as it comes by the saved pipeline, with the
    history of the stream's keyed state (rows-only; tests compare with the batch form)."""
    return P.stream_model_scoring(spark, P.transaction_stream(spark, sf_dir), stream_pipeline(spark, sf_dir))


@register("stacked_embeddings", PG.graph_sql(PG.NODE_FEAT_SQL, PROP_SQL)
          + "SELECT 'card_' || card_id AS node, 'card' AS node_type, " + ", ".join(FEATS) + " FROM pc2 "
          + "UNION ALL SELECT 'merchant_' || merchant_id AS node, 'merchant' AS node_type, "
          + ", ".join(FEATS) + " FROM pm2")
def stacked_embeddings(spark, sf_dir):
    """H1: card and merchant vectors stacked with their node type."""
    ce, me = _embeddings(spark, sf_dir)
    return (ce.select(C.node_key(G.CARD, "card_id").alias("node"), F.lit(G.CARD).alias("node_type"), *FEATS)
              .unionByName(me.select(C.node_key(G.MERCHANT, "merchant_id").alias("node"),
                                     F.lit(G.MERCHANT).alias("node_type"), *FEATS)))


@register("kmeans_nodes")
def kmeans_nodes(spark, sf_dir):
    """I9 + H1 + E10: seeded k-means on the stacked, scaled node vectors (rows-only)."""
    return L.kmeans_clusters(stacked_embeddings(spark, sf_dir), FEATS, k=8, seed=42,
                             id_cols=("node", "node_type"))


@register("kmeans_embeddings")
def kmeans_embeddings(spark, sf_dir):
    """Seeded k-means (k = 10) on the scaled embeddings table, every component of
    its longest vector (one that a vector lacks counts as 0) (rows-only)."""
    return _cluster_embeddings(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def _cluster_embeddings(emb, k=10):
    dim = emb.agg(F.max(F.size("embedding"))).first()[0] or 1
    cols = [f"e{i}" for i in range(max(dim, 1))]
    wide = emb.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)])
    return L.kmeans_clusters(wide, cols, k=k, seed=42, id_cols=("vec_id",))


@register("embedding_norms", """
SELECT vec_id, label, round(ln(1 + sqrt(list_sum(list_transform(embedding,
       lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 9) AS norm_log FROM embeddings""")
def embedding_norms(spark, sf_dir):
    """log1p of each vector's L2 norm."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    v = F.transform("embedding", lambda x: x.cast("double"))
    return emb.select("vec_id", "label", F.round(F.log1p(C.vec_norm(v)), 9).alias("norm_log"))


@register("time_units", S.ctes(TX_SQL) + """
SELECT transaction_id, CASE WHEN (SELECT max(dt) FROM tx) > 1000 THEN dt / 3600.0 ELSE CAST(dt AS DOUBLE) END AS t,
       round(ln(1 + greatest(amt, 0.0)), 9) AS amt_log FROM tx""")
def time_units(spark, sf_dir):
    """Seconds -> hours when the maximum exceeds 1000; log1p(max(amount, 0))."""
    tx = transactions(spark, sf_dir).select("transaction_id", "dt", "amt")
    t = L.time_in_hours_if_seconds(tx, "dt", "t")
    return t.select("transaction_id", "t", F.round(F.log1p(F.greatest("amt", F.lit(0.0))), 9).alias("amt_log"))


# ---------------------------------------------------------------------------
# Extra features and fusion variants (J7, B30), card history (C7, G5), samples
# ---------------------------------------------------------------------------
@register("ae_community_features", PG.graph_sql(PG.STATS_SQL, PG.NODE_FEAT_SQL, ANOMALY_SQL, """
t AS (
  SELECT tx.transaction_id, an.anomaly, coalesce(rk.risk_score, 0.0) AS community_risk
  FROM tx JOIN an ON an.card_id = tx.card_id AND an.merchant_id = tx.merchant_id
  LEFT JOIN comm cc ON cc.node = 'card_' || tx.card_id
  LEFT JOIN rk ON rk.community_id = cc.community_id)""") + """
SELECT transaction_id, round((anomaly - (SELECT min(anomaly) FROM t)) /
       ((SELECT max(anomaly) FROM t) - (SELECT min(anomaly) FROM t) + 1e-8), 9) AS ae_anomaly_score,
       community_risk FROM t""")
def ae_community_features(spark, sf_dir):
    """J7 + B27 + D9: auto-encoder score min-max scaled over all edges and
    the risk of the card's community (any community; 0 when none)."""
    comm = PG._communities(spark, sf_dir)
    stats = PG._stats(spark, sf_dir, comm)
    tx = PG._tx(spark, sf_dir)
    cards = CM.card_suspicious_risk(tx.select("card_id").distinct(), comm, stats, suspicious_only=False)
    t = tx.join(_edge_anomaly(spark, sf_dir), ["card_id", "merchant_id"]) \
          .join(cards.withColumnRenamed("comm_risk", "community_risk"), "card_id", "left")
    t = L.min_max(t, "anomaly", "ae")
    return t.select("transaction_id", F.round("ae", 9).alias("ae_anomaly_score"),
                    F.coalesce("community_risk", F.lit(0.0)).alias("community_risk"))


ALPHA = 0.7


@register("alpha_fusion", PG.graph_sql(PG.STATS_SQL, SCORE_SQL) + f"""
SELECT sc.transaction_id, sc.score AS model_prob, coalesce(rk.fraud_rate, 0.05) AS community_risk,
       round({ALPHA} * sc.score + {1 - ALPHA!r} * coalesce(rk.fraud_rate, 0.05), 9) AS fused_prob
FROM sc JOIN tx ON tx.transaction_id = sc.transaction_id
LEFT JOIN comm cc ON cc.node = 'card_' || tx.card_id
LEFT JOIN rk ON rk.community_id = cc.community_id""")
def alpha_fusion(spark, sf_dir):
    """B30 + D8: fused = 0.7 * model probability + 0.3 * community risk (0.05 default)."""
    comm = PG._communities(spark, sf_dir)
    stats = PG._stats(spark, sf_dir, comm)
    tx = PG._tx(spark, sf_dir)
    cards = CM.card_community_features(tx.select("card_id").distinct(), comm, stats)
    j = scored(spark, sf_dir).join(tx.select("transaction_id", "card_id"), "transaction_id") \
        .join(cards.select("card_id", "community_risk"), "card_id", "left")
    return j.select("transaction_id", F.col("score").alias("model_prob"), "community_risk",
                    F.round(C.alpha_fusion("score", "community_risk", ALPHA), 9).alias("fused_prob"))


HISTORY_N = 20


@register("card_history", S.ctes(TX_SQL, f"""
busiest AS (SELECT arg_min(card_id, (-n, card_id)) AS cid FROM (SELECT card_id, count(*) AS n FROM tx GROUP BY card_id)),
h AS (SELECT transaction_id, dt, amt, is_fraud FROM tx WHERE card_id = (SELECT cid FROM busiest)
      ORDER BY dt DESC, transaction_id DESC LIMIT {HISTORY_N})""") + """
SELECT *, count(*) OVER () AS n, CAST(sum(is_fraud) OVER () AS BIGINT) AS fraud_count,
       round(avg(amt) OVER (), 9) AS amt_mean, max(amt) OVER () AS amt_max FROM h""")
def card_history(spark, sf_dir):
    """C7 + G5 + G9: the busiest card's latest 20 transactions with their
    count / fraud / mean / max (window over the 20 selected rows)."""
    from pyspark.sql import Window
    tx = PG._tx(spark, sf_dir)
    counts = tx.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))
    cid = counts.agg(F.min_by("card_id", F.struct((-F.col("n")).alias("m"), F.col("card_id")))).scalar()
    h = (tx.filter(F.col("card_id") == cid)
           .orderBy(F.col("dt").desc(), F.col("transaction_id").desc()).limit(HISTORY_N)
           .select("transaction_id", "dt", "amt", "is_fraud"))
    w = Window.partitionBy()
    return h.select("*", F.count(F.lit(1)).over(w).alias("n"),
                    F.sum("is_fraud").over(w).cast("bigint").alias("fraud_count"),
                    F.round(F.avg("amt").over(w), 9).alias("amt_mean"), F.max("amt").over(w).alias("amt_max"))


@register("card_sample", S.ctes(TX_SQL) + "SELECT DISTINCT card1 FROM tx ORDER BY card1 LIMIT 10")
def card_sample(spark, sf_dir):
    """G10 + E9: first ten distinct card ids (distributed distinct + top-k)."""
    return transactions(spark, sf_dir).select("card1").distinct().orderBy("card1").limit(10)
