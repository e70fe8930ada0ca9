"""Registered graph and community queries (I1-I16, E12-E15, E34, E35, C3, C5,
C8, D5-D9, F9, G2, G8, J5-J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.operators import community as CM
from fraudlens.operators import graph as G
from fraudlens.plans import sql as S
from fraudlens.plans.registry import TX_SQL, register
from fraudlens.sources import files
from fraudlens.sources.tables import identity, transactions

LPA_ROUNDS = G.DEFAULT_LPA_ROUNDS
RESOLUTION = 1.0

EDGES_SQL = """
e AS (SELECT 'card_' || card_id AS src, 'merchant_' || merchant_id AS dst, card_id, merchant_id,
             count(*) AS weight, CAST(sum(is_fraud) AS BIGINT) AS fraud
      FROM tx GROUP BY card_id, merchant_id)"""


def _lpa_sql(rounds: int = LPA_ROUNDS, out: str = "lpa", p: str = "l") -> str:
    """Plain weighted label propagation, unrolled (CTE names prefixed by ``p``)."""
    parts = [f"{p}m0 AS (SELECT DISTINCT dst AS node, dst AS label FROM e)"]
    for r in range(1, rounds + 1):
        parts.append(f"""{p}c{r} AS (
  SELECT src AS node, arg_min(label, (-w, label)) AS label FROM (
    SELECT e.src, m.label, sum(e.weight) AS w FROM e JOIN {p}m{r-1} m ON e.dst = m.node
    GROUP BY e.src, m.label) GROUP BY src)""")
        parts.append(f"""{p}m{r} AS (
  SELECT dst AS node, arg_min(label, (-w, label)) AS label FROM (
    SELECT e.dst, c.label, sum(e.weight) AS w FROM e JOIN {p}c{r} c ON e.src = c.node
    GROUP BY e.dst, c.label) GROUP BY dst)""")
    parts.append(f"""{out} AS (
  SELECT node, 'card' AS node_type, label AS community_id FROM {p}c{rounds}
  UNION ALL SELECT node, 'merchant' AS node_type, label AS community_id FROM {p}m{rounds})""")
    return ",\n".join(parts)


#: Levels that the oracle spells out; a level without moves repeats its input.
SQL_LEVELS = 5


def _louvain_sql(resolution: float = 1.0, out: str = "comm") -> str:
    """The oracle of ``modularity_communities``: a recursive query a level, whose rounds
    end when no move is left."""
    parts = ["""a0 AS MATERIALIZED (SELECT src AS u, dst AS v, weight AS w FROM e
  UNION ALL SELECT dst AS u, src AS v, weight AS w FROM e)""",
             "g0 AS MATERIALIZED (SELECT u AS node, CAST(sum(w) AS DOUBLE) AS k FROM a0 GROUP BY u)",
             "tm AS MATERIALIZED (SELECT sum(k) AS m2 FROM g0)",
             "f0 AS MATERIALIZED (SELECT node, node AS label FROM g0)"]
    g = f"CAST({resolution!r} AS DOUBLE)"
    for i in range(SQL_LEVELS):
        parts.append(f"""s{i}(turn, node, label, k) AS (
  SELECT 0, node, node, k FROM g{i}
  UNION ALL (
  WITH s AS MATERIALIZED (SELECT * FROM s{i}),
  t AS (SELECT label, sum(k) AS total FROM s GROUP BY label),
  n AS MATERIALIZED (SELECT s.*, total FROM s JOIN t ON t.label = s.label),
  vo AS (SELECT a.u, n.label, n.total, CAST(sum(a.w) AS DOUBLE) AS w FROM a{i} a JOIN n ON n.node = a.v
         WHERE a.u <> a.v GROUP BY a.u, n.label, n.total),
  sc AS (SELECT n.node, n.k, n.label AS a, vo.label AS b, vo.w - {g} * n.k * vo.total / (SELECT m2 FROM tm) AS score
         FROM vo JOIN n ON n.node = vo.u WHERE vo.label <> n.label),
  ow AS (SELECT n.node, coalesce(vo.w, 0.0) - {g} * n.k * (n.total - n.k) / (SELECT m2 FROM tm) AS score
         FROM n LEFT JOIN vo ON vo.u = n.node AND vo.label = n.label),
  mv AS MATERIALIZED (SELECT * FROM (
           SELECT sc.node, k, a, b, sc.score - ow.score AS gain,
                  row_number() OVER (PARTITION BY sc.node ORDER BY sc.score DESC, b) AS place
           FROM sc JOIN ow ON ow.node = sc.node)
         WHERE place = 1 AND gain > {G.MIN_GAIN!r} * k),
  ti AS (SELECT b AS label, max((gain, node)) AS top FROM mv GROUP BY b),
  tl AS (SELECT a AS label, max((gain, node)) AS top FROM mv GROUP BY a),
  ab AS MATERIALIZED (SELECT mv.*, CASE WHEN (gain, node) = i.top AND (gain, node) = l.top THEN -1
           ELSE CAST('0x' || substr(md5(node || '/' || (SELECT max(turn) FROM s)), 1, 4) AS INTEGER) % {G.MOVE_BUCKETS} END AS bucket
         FROM mv JOIN ti i ON i.label = mv.b JOIN tl l ON l.label = mv.a
         LEFT JOIN ti ai ON ai.label = mv.a LEFT JOIN tl bl ON bl.label = mv.b
         WHERE (ai.top IS NULL OR l.top > ai.top) AND (bl.top IS NULL OR i.top > bl.top)),
  ac AS MATERIALIZED (SELECT x.node, x.b FROM (SELECT *,
           sum(k) OVER (PARTITION BY b ORDER BY bucket) AS k_in, sum(k) OVER (PARTITION BY a ORDER BY bucket) AS k_out
         FROM ab) x
         WHERE gain - {g} * k * (k_in + k_out - 2 * k) / (SELECT m2 FROM tm) > {G.MIN_GAIN!r} * k)
  SELECT s.turn + 1, s.node, coalesce(ac.b, s.label), s.k FROM s LEFT JOIN ac ON ac.node = s.node
  WHERE (SELECT count(*) FROM ac) > 0))""")
        parts.append(f"l{i} AS MATERIALIZED (SELECT node, any_value(k) AS k, arg_max(label, turn) AS label FROM s{i} GROUP BY node)")
        parts.append(f"f{i + 1} AS MATERIALIZED (SELECT f.node, l.label FROM f{i} f JOIN l{i} l ON l.node = f.label)")
        parts.append(f"""a{i + 1} AS MATERIALIZED (SELECT x.label AS u, y.label AS v, sum(w) AS w FROM a{i} a
  JOIN l{i} x ON x.node = a.u JOIN l{i} y ON y.node = a.v GROUP BY x.label, y.label)""")
        parts.append(f"g{i + 1} AS MATERIALIZED (SELECT label AS node, sum(k) AS k FROM l{i} GROUP BY label)")
    parts.append(f"""{out} AS MATERIALIZED (
  SELECT node, CASE WHEN starts_with(node, 'card_') THEN 'card' ELSE 'merchant' END AS node_type,
         min(node) OVER (PARTITION BY label) AS community_id FROM f{SQL_LEVELS})""")
    return ",\n".join(parts)


COMMUNITY_SQL = _louvain_sql()
PLAIN_LPA_SQL = _lpa_sql()

CLEAN_HOUR = "CAST((dt // 3600) % 24 AS INTEGER)"

STATS_SQL = f"""
ec AS (
  SELECT tx.*, {CLEAN_HOUR} AS hour, cc.community_id AS card_comm, mc.community_id AS merchant_comm
  FROM tx LEFT JOIN comm cc ON cc.node = 'card_' || tx.card_id
          LEFT JOIN comm mc ON mc.node = 'merchant_' || tx.merchant_id),
st0 AS (
  SELECT card_comm AS community_id, count(*) AS total_transactions,
    CAST(sum(is_fraud) AS BIGINT) AS fraud_transactions,
    count(DISTINCT card_id) AS num_cards, count(DISTINCT merchant_id) AS num_merchants,
    stddev_pop(CAST(hour AS DOUBLE)) AS tstd, max(CAST(hour AS DOUBLE)) AS tmax,
    min(CAST(hour AS DOUBLE)) AS tmin,
    avg(CASE WHEN fmod(hour, 24) >= 0 AND fmod(hour, 24) < 6 THEN 1 ELSE 0 END) AS night_ratio,
    CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) / count(*) AS amt_mean,
    round(stddev_pop(amt), 9) AS amt_std,
    avg(CASE WHEN abs(amt - round_even(amt, 0)) < 0.01 THEN 1 ELSE 0 END) AS round_amt_ratio
  FROM ec WHERE card_comm = merchant_comm GROUP BY card_comm),
st AS (
  SELECT community_id, total_transactions, fraud_transactions,
    fraud_transactions / total_transactions AS fraud_rate, num_cards, num_merchants,
    total_transactions / (num_cards * num_merchants) AS density,
    round(CASE WHEN tmax - tmin + 1 > 0 THEN 1 - tstd / (tmax - tmin + 1) ELSE 1.0 END, 9) AS time_concentration,
    night_ratio, amt_mean, amt_std, round_amt_ratio
  FROM st0),
rk0 AS (
  SELECT *,
    0.6 * least(density, 1.0) + 0.4 * CASE WHEN num_merchants > 0
        THEN least(num_cards / num_merchants / 10.0, 1.0) ELSE 0.0 END AS topo,
    0.4 * time_concentration + 0.3 * least(night_ratio * 2.0, 1.0) + 0.3 * round_amt_ratio AS behav
  FROM st),
rk AS (
  SELECT community_id, total_transactions, fraud_transactions, fraud_rate, num_cards, num_merchants,
    density, time_concentration, night_ratio, amt_mean, amt_std, round_amt_ratio,
    round(topo, 9) AS topology_anomaly, round(behav, 9) AS behavior_anomaly,
    round((0.4 * least(fraud_rate * 5.0, 1.0) + 0.3 * topo + 0.3 * behav)
          * (0.5 + 0.5 * least(ln(1 + total_transactions) / 10.0, 1.0)), 9) AS risk_score
  FROM rk0),
sus AS (
  SELECT * FROM rk WHERE fraud_rate >= 0.1 AND total_transactions >= 10 AND num_cards >= 3)"""


def graph_sql(*extra: str, resolution: float = RESOLUTION) -> str:
    body = S.ctes(TX_SQL, EDGES_SQL, COMMUNITY_SQL if resolution == RESOLUTION else _louvain_sql(resolution=resolution), *extra)
    return body.replace("WITH", "WITH RECURSIVE", 1)


def _tx(spark, sf_dir):
    return transactions(spark, sf_dir).select(
        "transaction_id", "card_id", "merchant_id", "dt", "amt", "is_fraud")


def _edges(spark, sf_dir):
    return G.bipartite_edges(_tx(spark, sf_dir))


def _communities(spark, sf_dir, resolution: float = RESOLUTION):
    """Built once a session for all queries that read them."""
    return files.shared_stage(spark, "communities", [f"{sf_dir}/events.parquet"], (resolution,),
                              lambda: G.modularity_communities(_edges(spark, sf_dir), resolution))


def _stats(spark, sf_dir, comm=None):
    tx = _tx(spark, sf_dir).withColumn("hour", C.hour_of_day("dt"))
    comm = comm if comm is not None else _communities(spark, sf_dir)
    return CM.with_risk(CM.community_stats(tx, comm, "hour"))


@register("bipartite_edges", S.ctes(TX_SQL, EDGES_SQL) + "SELECT src, dst, weight, fraud FROM e")
def bipartite_edges(spark, sf_dir):
    """E12 + B15: weighted card-merchant pairs."""
    return _edges(spark, sf_dir).select("src", "dst", "weight", "fraud")


@register("node_index", S.ctes(TX_SQL, EDGES_SQL) + """
SELECT node, node_type, row_number() OVER (PARTITION BY node_type ORDER BY node) - 1 AS idx
FROM (SELECT DISTINCT src AS node, 'card' AS node_type FROM e
      UNION ALL SELECT DISTINCT dst AS node, 'merchant' AS node_type FROM e)""")
def node_index(spark, sf_dir):
    """Dense per-type node index (range-partitioned prefix counts)."""
    return G.node_index(_edges(spark, sf_dir))


@register("hetero_graph", S.ctes(TX_SQL, EDGES_SQL, """
kc AS (SELECT DISTINCT 'card_' || CAST(s_suppkey AS VARCHAR) AS src FROM supplier),
km AS (SELECT DISTINCT 'merchant_' || merchant_id AS dst FROM tx),
ci AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS idx FROM kc),
mi AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS idx FROM km)""") + """
SELECT e.src, e.dst, e.weight, ci.idx AS src_idx, mi.idx AS dst_idx
FROM e JOIN ci ON ci.src = e.src JOIN mi ON mi.dst = e.dst""")
def hetero_graph(spark, sf_dir):
    """I2 + D5 + C3: indexed edges restricted to cards known to the identity table."""
    edges = _edges(spark, sf_dir)
    known_cards = identity(spark, sf_dir).select(F.col("card1").cast("string").alias("card_id"))
    known_merch = _tx(spark, sf_dir).select("merchant_id").distinct()
    g = G.hetero_graph(edges, known_cards, known_merch)
    return g.select("src", "dst", "weight", "src_idx", "dst_idx")


@register("dropped_edges", S.ctes(TX_SQL, EDGES_SQL) + """
SELECT count(*) AS dropped_edges, CAST(coalesce(sum(weight), 0) AS BIGINT) AS dropped_transactions
FROM e WHERE card_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)""")
def dropped_edges(spark, sf_dir):
    """Edges (and transactions) whose card is unknown, via an anti join."""
    known = identity(spark, sf_dir).select(F.col("card1").cast("string").alias("card_id"))
    d = _edges(spark, sf_dir).join(known, "card_id", "left_anti")
    return d.agg(F.count(F.lit(1)).alias("dropped_edges"),
                 F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("dropped_transactions"))


@register("communities", graph_sql() + "SELECT node, node_type, community_id FROM comm", headline=True)
def communities(spark, sf_dir):
    """I3 + E15 (long form): modularity-gain communities (resolution 1)."""
    return _communities(spark, sf_dir)


@register("label_propagation", S.ctes(TX_SQL, EDGES_SQL, PLAIN_LPA_SQL)
          + "SELECT node, node_type, community_id FROM lpa")
def label_propagation(spark, sf_dir):
    """Plain weighted label propagation (the baseline detector)."""
    return G.label_propagation(_edges(spark, sf_dir), LPA_ROUNDS)


@register("connected_components", "WITH RECURSIVE " + ",\n".join(
    p.strip("\n") for p in (TX_SQL, EDGES_SQL, """
und AS (SELECT src, dst FROM e UNION SELECT dst AS src, src AS dst FROM e),
reach(node, comp) AS (
  SELECT DISTINCT src, src FROM und
  UNION
  SELECT u.dst, r.comp FROM reach r JOIN und u ON u.src = r.node)""")) + """
SELECT node, min(comp) AS component,
       CASE WHEN starts_with(node, 'card_') THEN 'card' ELSE 'merchant' END AS node_type
FROM reach GROUP BY node""")
def connected_components(spark, sf_dir):
    """I4: connected components by large-star / small-star rounds."""
    return G.connected_components(_edges(spark, sf_dir))


@register("modularity", graph_sql("""
lab AS (SELECT node, community_id AS c FROM comm),
m AS (SELECT sum(weight) AS m FROM e),
intra AS (SELECT ls.c, sum(e.weight) AS l FROM e JOIN lab ls ON ls.node = e.src
          JOIN lab ld ON ld.node = e.dst WHERE ls.c = ld.c GROUP BY ls.c),
dg AS (SELECT src AS node, weight FROM e UNION ALL SELECT dst AS node, weight FROM e),
dc AS (SELECT lab.c, sum(weight) AS d FROM dg JOIN lab ON lab.node = dg.node GROUP BY lab.c)""") + """
SELECT round(sum(coalesce(l, 0) / (SELECT m FROM m) - 1.0 * pow(d / (2 * (SELECT m FROM m)), 2)), 9)
       AS modularity
FROM dc LEFT JOIN intra ON dc.c = intra.c""")
def modularity(spark, sf_dir):
    """Modularity (resolution 1) of the label-propagation partition."""
    edges = _edges(spark, sf_dir)
    return G.modularity(edges, _communities(spark, sf_dir), 1.0)


@register("community_stats", graph_sql(STATS_SQL) + "SELECT * FROM rk", headline=True)
def community_stats(spark, sf_dir):
    """E13 + C8 + I10-I12: intra-community statistics with risk scores."""
    return _stats(spark, sf_dir)


@register("suspicious_communities", graph_sql(STATS_SQL) + "SELECT * FROM sus")
def suspicious_communities(spark, sf_dir):
    """C5 + I13 + G2: suspicious rings ordered by risk (defaults 0.1 / 10 / 3)."""
    return CM.suspicious(_stats(spark, sf_dir), **CM.SUSPICIOUS_DEFAULT)


@register("community_evaluation", graph_sql(STATS_SQL) + """
, ev AS (
  SELECT (SELECT CAST(sum(is_fraud) AS BIGINT) FROM tx) AS total_fraud,
         (SELECT count(*) FROM tx) AS total_transactions,
         (SELECT count(*) FROM sus) AS suspicious_communities,
         (SELECT CAST(coalesce(sum(fraud_transactions), 0) AS BIGINT) FROM sus) AS fraud_in_suspicious,
         (SELECT CAST(coalesce(sum(total_transactions), 0) AS BIGINT) FROM sus) AS tx_in_suspicious),
ev2 AS (
  SELECT *, CASE WHEN total_fraud > 0 THEN fraud_in_suspicious / total_fraud ELSE 0.0 END AS community_recall,
         CASE WHEN tx_in_suspicious > 0 THEN fraud_in_suspicious / tx_in_suspicious ELSE 0.0 END AS community_precision
  FROM ev)
SELECT *, CASE WHEN community_precision + community_recall > 0
  THEN 2 * community_precision * community_recall / (community_precision + community_recall)
  ELSE 0.0 END AS community_f1 FROM ev2""".replace("\n, ev AS", ", ev AS", 1))
def community_evaluation(spark, sf_dir):
    """Community-level coverage recall / precision / F1."""
    sus = CM.suspicious(_stats(spark, sf_dir), **CM.SUSPICIOUS_DEFAULT)
    return CM.community_evaluation(_tx(spark, sf_dir), sus)


DETAIL_SQL = """
nd AS (SELECT community_id, count(*) AS node_count,
              CAST(sum(CASE WHEN starts_with(node, 'card_') THEN 1 ELSE 0 END) AS BIGINT) AS card_nodes
       FROM comm GROUP BY community_id),
ed AS (SELECT cs.community_id, count(*) AS edge_count, sum(e.weight) AS transactions
       FROM e JOIN comm cs ON cs.node = e.src JOIN comm cd ON cd.node = e.dst
       WHERE cs.community_id = cd.community_id GROUP BY cs.community_id)"""


@register("community_detail", graph_sql(DETAIL_SQL) + """
SELECT nd.community_id, node_count, card_nodes, coalesce(edge_count, 0) AS edge_count,
       CAST(coalesce(transactions, 0) AS BIGINT) AS transactions
FROM nd LEFT JOIN ed ON nd.community_id = ed.community_id""")
def community_detail(spark, sf_dir):
    """Node / edge counts per community."""
    edges = _edges(spark, sf_dir)
    d = G.community_detail(edges, _communities(spark, sf_dir))
    return d.withColumn("transactions", F.col("transactions").cast("bigint"))


BIGGEST_SQL = """
big AS (SELECT arg_min(community_id, (-n, community_id)) AS cid
        FROM (SELECT community_id, count(*) AS n FROM comm GROUP BY community_id))"""


def _biggest(comm):
    sizes = CM.community_sizes(comm)
    return sizes.agg(F.min_by("community_id", F.struct((-F.col("size")).alias("s"),
                                                       F.col("community_id")))).scalar()


@register("community_subgraph", graph_sql(BIGGEST_SQL) + """
SELECT e.src, e.dst, e.weight FROM e
WHERE e.src IN (SELECT node FROM comm WHERE community_id = (SELECT cid FROM big))
  AND e.dst IN (SELECT node FROM comm WHERE community_id = (SELECT cid FROM big))""")
def community_subgraph(spark, sf_dir):
    """Induced subgraph of the largest community (semi joins)."""
    edges = _edges(spark, sf_dir)
    comm = _communities(spark, sf_dir)
    members = comm.filter(F.col("community_id") == _biggest(comm))
    return G.induced_edges(edges, members).select("src", "dst", "weight")


@register("display_sample", graph_sql(BIGGEST_SQL, f"""
mem AS (SELECT node, starts_with(node, 'card_') AS is_card FROM comm WHERE community_id = (SELECT cid FROM big)),
rk AS (SELECT node, is_card, row_number() OVER (PARTITION BY is_card ORDER BY {S.seeded(42, 'node')}, node) AS r FROM mem),
kept AS (SELECT node FROM rk WHERE r <= CASE WHEN is_card THEN 25 ELSE 12 END)""") + """
SELECT e.src, e.dst, e.weight FROM e WHERE e.src IN (SELECT node FROM kept) AND e.dst IN (SELECT node FROM kept)""")
def display_sample(spark, sf_dir):
    """I8: <= 25 cards and <= 12 merchants of the largest community (seeded
    hash order) with the real edges among them."""
    edges = _edges(spark, sf_dir)
    comm = _communities(spark, sf_dir)
    return G.display_sample(edges, comm, _biggest(comm))


@register("top_risk_communities", graph_sql(STATS_SQL) + """
SELECT community_id, total_transactions, fraud_rate, risk_score FROM rk
WHERE total_transactions >= 100 ORDER BY fraud_rate DESC, community_id LIMIT 10""")
def top_risk_communities(spark, sf_dir):
    """C6 + G8: ten communities with the highest fraud rate among those with >= 100 rows."""
    s = _stats(spark, sf_dir).filter(F.col("total_transactions") >= 100)
    return s.orderBy(F.col("fraud_rate").desc(), "community_id").limit(10).select(
        "community_id", "total_transactions", "fraud_rate", "risk_score")


@register("community_rank", graph_sql(STATS_SQL) + """
SELECT community_id, risk_score, row_number() OVER (ORDER BY risk_score DESC, community_id) AS rank
FROM rk""")
def community_rank(spark, sf_dir):
    """rank of every community by risk (distributed global row number)."""
    s = _stats(spark, sf_dir).select("community_id", "risk_score",
                                     (-F.col("risk_score")).alias("_neg"))
    r = G.global_row_number(s, ["_neg", "community_id"], "rank")
    return r.select("community_id", "risk_score", (F.col("rank") + 1).alias("rank"))


@register("card_community_features", graph_sql(STATS_SQL) + """
SELECT c.card_id, cc.community_id,
  coalesce(CAST(rk.fraud_rate AS DOUBLE), 0.0) AS comm_0, coalesce(CAST(rk.density AS DOUBLE), 0.0) AS comm_1,
  coalesce(CAST(rk.time_concentration AS DOUBLE), 0.0) AS comm_2, coalesce(CAST(rk.night_ratio AS DOUBLE), 0.0) AS comm_3,
  coalesce(CAST(rk.num_cards AS DOUBLE) / greatest(rk.num_merchants, 1), 0.0) AS comm_4,
  coalesce(round(least(ln(1 + rk.total_transactions) / 10.0, 1.0), 9), 0.0) AS comm_5,
  coalesce(rk.fraud_rate, 0.05) AS community_risk
FROM (SELECT DISTINCT card_id FROM tx) c
LEFT JOIN comm cc ON cc.node = 'card_' || c.card_id AND cc.node_type = 'card'
LEFT JOIN rk ON rk.community_id = cc.community_id""")
def card_community_features(spark, sf_dir):
    """D8 + J5: six community features per card (zeros when none) and the
    scalar community risk (0.05 default)."""
    comm = _communities(spark, sf_dir)
    stats = _stats(spark, sf_dir, comm)
    cards = _tx(spark, sf_dir).select("card_id").distinct()
    return CM.card_community_features(cards, comm, stats).select(
        "card_id", "community_id", *[f"comm_{i}" for i in range(6)], "community_risk")


@register("edge_community_features", graph_sql(STATS_SQL) + """
SELECT ec.transaction_id,
  coalesce(CAST(rk.total_transactions AS DOUBLE), 0.0) AS cf_0, coalesce(rk.fraud_rate, 0.0) AS cf_1,
  coalesce(CAST(rk.num_cards AS DOUBLE), 0.0) AS cf_2, coalesce(CAST(rk.num_merchants AS DOUBLE), 0.0) AS cf_3,
  coalesce(rk.density, 0.0) AS cf_4,
  coalesce(CASE WHEN rk.num_merchants > 0 THEN CAST(rk.num_cards AS DOUBLE) / rk.num_merchants ELSE 0.0 END, 0.0) AS cf_5,
  coalesce(rk.time_concentration, 0.0) AS cf_6, coalesce(rk.night_ratio, 0.0) AS cf_7, coalesce(rk.amt_mean, 0.0) AS cf_8,
  coalesce(rk.amt_std, 0.0) AS cf_9, coalesce(rk.round_amt_ratio, 0.0) AS cf_10, coalesce(rk.topology_anomaly, 0.0) AS cf_11,
  coalesce(rk.behavior_anomaly, 0.0) AS cf_12, coalesce(rk.risk_score, 0.0) AS cf_13
FROM ec LEFT JOIN rk ON rk.community_id = CASE WHEN ec.card_comm = ec.merchant_comm THEN ec.card_comm END""")
def edge_community_features(spark, sf_dir):
    """D7 + J6: 14 community features per edge when both endpoints share a
    community, zeros otherwise."""
    comm = _communities(spark, sf_dir)
    stats = _stats(spark, sf_dir, comm)
    e = CM.edge_community_features(_tx(spark, sf_dir), comm, stats)
    return e.select("transaction_id", *[f"cf_{i}" for i in range(len(CM.FOURTEEN_FEATURES))])


@register("card_suspicious_risk", graph_sql(STATS_SQL) + """
SELECT c.card_id, coalesce(sus.risk_score, 0.0) AS comm_risk
FROM (SELECT DISTINCT card_id FROM tx) c
LEFT JOIN comm cc ON cc.node = 'card_' || c.card_id AND cc.node_type = 'card'
LEFT JOIN sus ON sus.community_id = cc.community_id""")
def card_suspicious_risk(spark, sf_dir):
    """Per card, the risk score of its community if suspicious, else 0."""
    comm = _communities(spark, sf_dir)
    stats = _stats(spark, sf_dir, comm)
    cards = _tx(spark, sf_dir).select("card_id").distinct()
    return CM.card_suspicious_risk(cards, comm, stats, **CM.SUSPICIOUS_DEFAULT).select(
        "card_id", "comm_risk")


# ---------------------------------------------------------------------------
# Neighbourhood aggregation on simple node features
# ---------------------------------------------------------------------------
NODE_FEATS = ["n_tx", "amt_mean", "night_ratio"]


def _node_features(tx, key):
    return tx.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("n_tx"),
        (F.sum(C.money("amt")).cast("double") / F.count(F.lit(1))).alias("amt_mean"),
        F.avg(C.is_night(C.hour_of_day("dt")).cast("double")).alias("night_ratio"))


NODE_FEAT_SQL = """
cf AS (SELECT card_id, CAST(count(*) AS DOUBLE) AS n_tx,
              CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) / count(*) AS amt_mean,
              avg(CASE WHEN (dt // 3600) % 24 < 6 THEN 1.0 ELSE 0.0 END) AS night_ratio
       FROM tx GROUP BY card_id),
mf AS (SELECT merchant_id, CAST(count(*) AS DOUBLE) AS n_tx,
              CAST(sum(CAST(amt AS DECIMAL(18,3))) AS DOUBLE) / count(*) AS amt_mean,
              avg(CASE WHEN (dt // 3600) % 24 < 6 THEN 1.0 ELSE 0.0 END) AS night_ratio
       FROM tx GROUP BY merchant_id)"""


def _r9(df, key):
    return df.select(key, *[F.round(c, 9).alias(c) for c in NODE_FEATS])


@register("neighbour_mean", S.ctes(TX_SQL, EDGES_SQL, NODE_FEAT_SQL) + "SELECT e.merchant_id, " + ", ".join(
    f"round(sum(cf.{c} * e.weight) / sum(e.weight), 9) AS {c}" for c in NODE_FEATS)
    + " FROM e JOIN cf ON cf.card_id = e.card_id GROUP BY e.merchant_id")
def neighbour_mean(spark, sf_dir):
    """Merchant <- mean of its cards' features (one SAGE-style mean step)."""
    tx = _tx(spark, sf_dir)
    out = G.neighbour_mean(G.bipartite_edges(tx), _node_features(tx, "card_id"),
                           "card_id", "merchant_id", NODE_FEATS)
    return _r9(out, "merchant_id")


A_SRC, A_DST = [0.01, 0.005, 1.0], [0.02, -0.01, -0.5]


@register("attention_aggregate", S.ctes(TX_SQL, EDGES_SQL, NODE_FEAT_SQL, """
sc AS (
  SELECT e.card_id, e.merchant_id, cf.n_tx AS s_n_tx, cf.amt_mean AS s_amt_mean, cf.night_ratio AS s_night_ratio,
    (""" + " + ".join(f"{a} * cf.{c}" for a, c in zip(A_SRC, NODE_FEATS)) + ") + ("
    + " + ".join(f"{a} * mf.{c}" for a, c in zip(A_DST, NODE_FEATS)) + """) AS raw
  FROM e JOIN cf ON cf.card_id = e.card_id JOIN mf ON mf.merchant_id = e.merchant_id),
sc2 AS (SELECT *, CASE WHEN raw > 0 THEN raw ELSE raw * 0.2 END AS ev FROM sc),
sc3 AS (SELECT *, exp(ev - max(ev) OVER (PARTITION BY merchant_id)) AS x FROM sc2)""") + "SELECT merchant_id, " + ", ".join(
    f"round(sum(x * s_{c}) / sum(x), 9) AS {c}" for c in NODE_FEATS) + " FROM sc3 GROUP BY merchant_id")
def attention_aggregate(spark, sf_dir):
    """One attention head (fixed weights, softmax over in-edges)."""
    tx = _tx(spark, sf_dir)
    edges = G.bipartite_edges(tx)
    out = G.attention_aggregate(edges, _node_features(tx, "card_id"), _node_features(tx, "merchant_id"),
                                "card_id", "merchant_id", NODE_FEATS, A_SRC, A_DST)
    return _r9(out, "merchant_id")


def _mean_sql(src_tab, src_key, dst_key, name):
    return (f"{name} AS (SELECT e.{dst_key}, " + ", ".join(
        f"sum({src_tab}.{c} * e.weight) / sum(e.weight) AS {c}" for c in NODE_FEATS)
        + f" FROM e JOIN {src_tab} ON {src_tab}.{src_key} = e.{src_key} GROUP BY e.{dst_key})")


def _relu_sql(src, key, name):
    return f"{name} AS (SELECT {key}, " + ", ".join(f"greatest({c}, 0.0) AS {c}" for c in NODE_FEATS) + f" FROM {src})"


@register("propagation", S.ctes(TX_SQL, EDGES_SQL, NODE_FEAT_SQL,
                                _mean_sql("cf", "card_id", "merchant_id", "m1a"),
                                _mean_sql("mf", "merchant_id", "card_id", "c1a"),
                                _relu_sql("m1a", "merchant_id", "m1"), _relu_sql("c1a", "card_id", "c1"),
                                _mean_sql("c1", "card_id", "merchant_id", "m2"),
                                _mean_sql("m1", "merchant_id", "card_id", "c2"))
    + "SELECT 'card_' || card_id AS node, " + ", ".join(f"round({c}, 9) AS {c}" for c in NODE_FEATS) + " FROM c2 "
    + "UNION ALL SELECT 'merchant_' || merchant_id AS node, " + ", ".join(f"round({c}, 9) AS {c}" for c in NODE_FEATS) + " FROM m2")
def propagation(spark, sf_dir):
    """Two rounds of bidirectional mean aggregation with ReLU between."""
    tx = _tx(spark, sf_dir)
    c, m = G.propagate(G.bipartite_edges(tx), _node_features(tx, "card_id"),
                       _node_features(tx, "merchant_id"), NODE_FEATS, 2)
    cc = _r9(c, "card_id").select(C.node_key(G.CARD, "card_id").alias("node"), *NODE_FEATS)
    mm = _r9(m, "merchant_id").select(C.node_key(G.MERCHANT, "merchant_id").alias("node"), *NODE_FEATS)
    return cc.unionByName(mm)


def _norm_sql(tab, key, name):
    n = "sqrt(" + " + ".join(f"{c} * {c}" for c in NODE_FEATS) + ")"
    return f"{name} AS (SELECT {key}, " + ", ".join(f"{c} / ({n} + 1e-8) AS {c}" for c in NODE_FEATS) + f" FROM {tab})"


@register("reconstruction_anomaly", S.ctes(TX_SQL, EDGES_SQL, NODE_FEAT_SQL,
                                           _mean_sql("cf", "card_id", "merchant_id", "m1"),
                                           _norm_sql("cf", "card_id", "zc"), _norm_sql("m1", "merchant_id", "zm"))
    + "SELECT e.src, e.dst, round(1 - 1 / (1 + exp(-(" + " + ".join(f"zc.{c} * zm.{c}" for c in NODE_FEATS)
    + "))), 9) AS anomaly FROM e JOIN zc ON zc.card_id = e.card_id JOIN zm ON zm.merchant_id = e.merchant_id")
def reconstruction_anomaly(spark, sf_dir):
    """I15 + B33 + D6: 1 - sigmoid(z_card . z_merchant) with cosine-normalised
    card features and their merchant neighbour means."""
    tx = _tx(spark, sf_dir)
    edges = G.bipartite_edges(tx)
    cf = _node_features(tx, "card_id")
    m1 = G.neighbour_mean(edges, cf, "card_id", "merchant_id", NODE_FEATS)
    zc = cf.select("card_id", C.vec_cosine_normalise(F.array(*NODE_FEATS)).alias("z"))
    zm = m1.select("merchant_id", C.vec_cosine_normalise(F.array(*NODE_FEATS)).alias("z"))
    out = G.reconstruction_anomaly(edges, zc, zm)
    return out.select("src", "dst", F.round("anomaly", 9).alias("anomaly"))


@register("negative_samples", S.ctes(TX_SQL, EDGES_SQL, f"""
c AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT src FROM e)),
m AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT dst FROM e)),
d AS (SELECT unnest(range((SELECT count(*) FROM e))) AS id)""") + f"""
SELECT d.id, c.src, m.dst FROM d JOIN c ON c.place = {S.seeded('42:c', 'd.id')} % c.n
JOIN m ON m.place = {S.seeded('42:m', 'd.id')} % m.n""")
def negative_samples(spark, sf_dir):
    """I16: uniform negative (card, merchant) pairs, as many as edges (seeded hash)."""
    return G.negative_samples(_edges(spark, sf_dir))
