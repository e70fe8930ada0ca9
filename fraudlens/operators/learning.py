"""Learning-data preparation, model training and score fusion
(E10, E11, F10, H1, H2, I9, J2-J14, B25-B33, D10).

Data preparation is plain DataFrame algebra: scalers and min-max bounds are
one-pass global aggregates used through scalar subqueries; splits and
sample picks are positions from ``global_row_number`` (range-partitioned
prefix counts) instead of per-label windows, so the majority class never
lands in a single task.  Models are Spark ML estimators trained on the
cluster; nothing is collected to the driver except model parameters and the
(bounded) feature-importance vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions import columns as C
from fraudlens.operators.graph import global_row_number

PRECISION = 9
SPLIT_TRAIN, SPLIT_VAL = 0.7, 0.15
TRI_WEIGHTS = (0.5, 0.3, 0.2)       # fixed values: GNN, auto-encoder, community
MINMAX_EPS = 1e-8
#: The lighter comparator (J4): about 31 leaves, larger steps, coarser bins.
GBT_LIGHT = dict(maxDepth=5, stepSize=0.05, maxBins=64)
GBT_DEFAULTS = dict(maxDepth=6, stepSize=0.03, subsamplingRate=0.7, featureSubsetStrategy="0.7",
                    minInstancesPerNode=50, maxBins=255, maxIter=40, seed=42)


# --- E10 scaling ------------------------------------------------------------------
def scaler_params(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and scale (population std, 1 when the std is 0)."""
    aggs = []
    for c in cols:
        x = C.finite_or_zero(c)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    p = df.agg(*aggs)
    return p.select(*[F.col(f"{c}__mean") for c in cols],
                    *[F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std"))
                      .alias(f"{c}__scale") for c in cols])


def scale_by(df: DataFrame, cols: list[str], params) -> DataFrame:
    """Scale ``cols`` with a row of ``scaler_params`` (two numbers a column, which a model
    keeps anyway): literals plan in no time where a hundred columns of a subquery do not."""
    scaled = {c: (C.finite_or_zero(c) - F.lit(params[f"{c}__mean"] or 0.0)) / F.lit(params[f"{c}__scale"] or 1.0) for c in cols}
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale ``cols`` with parameters fitted on ``fit_on`` (default ``df``);
    NaN / inf -> 0 before and after (B13).  The parameters are one struct
    scalar subquery, evaluated once."""
    params = scaler_params(fit_on if fit_on is not None else df, cols)
    p = params.select(F.struct(*params.columns).alias("p")).scalar()
    out = df
    for c in cols:
        z = (C.finite_or_zero(c) - p.getField(f"{c}__mean")) / p.getField(f"{c}__scale")
        out = out.withColumn(c, C.finite_or_zero(z))
    return out


def min_max(df: DataFrame, col: str, out: str, over: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min + 1e-8), bounds from ``over`` (default df)."""
    src = over if over is not None else df
    b = src.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = b.select("lo").scalar(), b.select("hi").scalar()
    return df.withColumn(out, (F.col(col) - lo) / (hi - lo + MINMAX_EPS))


# --- F10, J2, E11 splits -----------------------------------------------------------
def time_split(df: DataFrame, order_cols=("dt", "transaction_id"), train: float = SPLIT_TRAIN,
               val: float = SPLIT_VAL) -> DataFrame:
    """first int(0.7 n) rows by time -> train, next int(0.15 n) -> val,
    rest -> test (ties broken by id)."""
    n = df.select(F.count(F.lit(1))).scalar()
    n_train = F.floor(n * F.lit(train)).cast("bigint")
    n_val = F.floor(n * F.lit(val)).cast("bigint")
    r = global_row_number(df, list(order_cols), "_pos")
    split = (F.when(F.col("_pos") < n_train, "train")
             .when(F.col("_pos") < n_train + n_val, "val").otherwise("test"))
    return r.withColumn("split", split).drop("_pos")


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 42,
                     train: float = SPLIT_TRAIN, val: float = SPLIT_VAL) -> DataFrame:
    """Per label, rows in seeded hash order; the first int(0.7 n_label)
    -> train, the next int(0.15 n_label) -> val, the rest -> test.

    Positions come from one global ordering by (label, hash, id) minus the
    number of rows of smaller labels, so no label is gathered in one task."""
    h = df.withColumn("_h", C.seeded(seed, id_col))
    r = global_row_number(h, [label, "_h", id_col], "_pos")
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    # One row per label value: a bounded table.
    starts = per.select(label, "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    r = r.join(F.broadcast(starts), label)
    pos = F.col("_pos") - F.col("_start")
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_val = F.floor(F.col("_n") * F.lit(val))
    split = F.when(pos < n_train, "train").when(pos < n_train + n_val, "val").otherwise("test")
    return r.withColumn("split", split).drop("_pos", "_start", "_n", "_h")


def split_stats(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Size and fraud rate per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("size"),
                                   F.avg(label).alias("fraud_rate"))


# --- J8 borderline shifting ----------------------------------------------------------
def borderline_shift(train: DataFrame, val_scored: DataFrame, score: str, label: str,
                     id_col: str, low: float = 0.30, high: float = 0.70, strategy: str = "both",
                     weight: float = 2.0, copies: int = 1, seed: int = 42) -> DataFrame:
    """Count validation rows with ``low <= score <= high`` per label
    (C9), pick that many training rows of the same label in seeded hash
    order (with wrap-around when more are needed than exist), multiply their
    weight (``weight``/``both``) and append ``copies`` copies per pick
    (``copy``/``both``).  Output = train rows (+ copies) with ``weight`` and
    ``is_copy`` columns."""
    need = val_scored.filter(F.col(score).between(low, high)).groupBy(label).agg(
        F.count(F.lit(1)).alias("_need"))
    pool = train.groupBy(label).agg(F.count(F.lit(1)).alias("_pool"))
    h = train.withColumn("_h", C.seeded(seed, id_col))
    r = global_row_number(h, [label, "_h", id_col], "_pos")
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    starts = pool.select(label, "_pool", F.coalesce(F.sum("_pool").over(w), F.lit(0)).alias("_start"))
    # Both tables have one row per label value.
    r = r.join(F.broadcast(starts), label).join(F.broadcast(need), label, "left")
    pos = F.col("_pos") - F.col("_start")
    nd = F.coalesce(F.col("_need"), F.lit(0))
    picks = (F.floor(nd / F.col("_pool")) + F.when(pos < nd % F.col("_pool"), 1).otherwise(0)).cast("int")
    r = r.withColumn("_picks", picks)
    wcol = F.when((F.col("_picks") > 0) & F.lit(strategy in ("weight", "both")), F.lit(weight)).otherwise(1.0)
    r = r.withColumn("weight", wcol.cast("double")).withColumn("is_copy", F.lit(False))
    base = r.drop("_h", "_pos", "_start", "_pool", "_need")
    if strategy in ("copy", "both") and copies > 0:
        extra = base.filter(F.col("_picks") > 0).withColumn(
            "_rep", F.explode(F.sequence(F.lit(1), F.col("_picks") * copies))).drop("_rep") \
            .withColumn("is_copy", F.lit(True))
        base = base.unionByName(extra)  # H2
    return base.drop("_picks")


# --- B25, D6, D10, J5-J7 hybrid features -------------------------------------------------
def pair_features(edges: DataFrame, card_emb: DataFrame, merch_emb: DataFrame, dims: list[str],
                  default_to_mean: bool = True) -> DataFrame:
    """D6 + B25 (+ D10): per edge, card and merchant vectors, their
    difference and element-wise product as scalar columns; a node without a
    vector takes the mean vector of its type (one aggregate row)."""
    def side(emb, key, prefix):
        mean = emb.agg(F.struct(*[F.avg(d).alias(d) for d in dims]).alias("m")).scalar()  # one subquery a side
        cols = []
        for d in dims:
            v = F.col(f"{prefix}_emb_{d}")
            if default_to_mean:
                v = F.coalesce(v, mean[d])
            cols.append(v.alias(f"{prefix}_emb_{d}"))
        return emb.select(key, *[F.col(d).alias(f"{prefix}_emb_{d}") for d in dims]), cols
    ce, ccols = side(card_emb, "card_id", "card")
    me, mcols = side(merch_emb, "merchant_id", "merchant")
    j = edges.join(ce, "card_id", "left").join(me, "merchant_id", "left")
    j = j.select(*[c for c in j.columns if "_emb_" not in c], *ccols, *mcols)
    for d in dims:
        j = j.withColumn(f"emb_diff_{d}", F.col(f"card_emb_{d}") - F.col(f"merchant_emb_{d}")) \
             .withColumn(f"emb_prod_{d}", F.col(f"card_emb_{d}") * F.col(f"merchant_emb_{d}"))
    return j


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """Vector of the named columns in order; a missing column counts as
    0 and NaN / inf become 0."""
    from pyspark.ml.feature import VectorAssembler
    present = set(df.columns)
    tmp = [f"__f{i}" for i in range(len(names))]
    d = df.select("*", *[(C.finite_or_zero(n) if n in present else F.lit(0.0)).alias(t)
                         for n, t in zip(names, tmp)])
    va = VectorAssembler(inputCols=tmp, outputCol=out, handleInvalid="keep")
    return va.transform(d).drop(*tmp)


# --- J10 tri-signal fusion ------------------------------------------------------------------
def tri_fusion(df: DataFrame, gnn: str, ae_norm: str, comm: str,
               weights=TRI_WEIGHTS, threshold: float = 0.5) -> DataFrame:
    """J10 + B29: fused = clip(0.5 gnn + 0.3 ae + 0.2 comm), prediction at 0.5, score
    rounded to 6 after that."""
    fused = C.linear_fusion([(weights[0], F.col(gnn)), (weights[1], F.col(ae_norm)),
                             (weights[2], F.col(comm))])
    return (df.withColumn("_fused", fused).withColumn("fused_score", F.round("_fused", 6))
            .withColumn("fused_pred", (F.col("_fused") >= threshold).cast("int")).drop("_fused"))


# --- B31-B33 ---------------------------------------------------------------------------------
def time_in_hours_if_seconds(df: DataFrame, col: str, out: str) -> DataFrame:
    """Divide by 3600 when the column's maximum exceeds 1000."""
    mx = df.select(F.max(col)).scalar()
    return df.withColumn(out, F.when(mx > 1000, F.col(col) / 3600.0).otherwise(F.col(col).cast("double")))



# --- I9 clustering ---------------------------------------------------------------------------
def kmeans_clusters(df: DataFrame, cols: list[str], k: int = 8, seed: int = 42,
                    id_cols=("node",)) -> DataFrame:
    """Seeded k-means on standardised columns; cluster per row.

    Spark ML's scaler divides by the sample std where the reference divides
    by the population std: a common factor on every axis, so the clusters
    are the same (and a constant column is 0 after centring either way).
    The assembled vectors are materialised once for the k-means passes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from fraudlens.session import materialize
    v = materialize(assemble(df.select(*id_cols, *cols), cols, "raw"), "kmeans-input")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True,
                            withStd=True).fit(v).transform(v)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).select(*id_cols, "cluster")


# --- J3, J4, J12, J14 boosted trees ------------------------------------------------------------
def train_gbt(train_val: DataFrame, label: str = "label", weight: str | None = None,
              validation_col: str | None = None, **params):
    """Spark ML gradient-boosted trees on ``features``.  With a
    validation indicator column the model stops on validation loss."""
    from pyspark.ml.classification import GBTClassifier
    p = dict(GBT_DEFAULTS)
    p.update(params)
    est = GBTClassifier(featuresCol="features", labelCol=label, **p)
    if weight:
        est = est.setWeightCol(weight)
    if validation_col:
        est = est.setValidationIndicatorCol(validation_col)
    return est.fit(train_val)


#: Scores are counted in so many bins when prefixes of a model are compared.
STAGE_BINS = 8192


def _tree_arrays(model) -> list[tuple]:
    """(feature or -1, threshold, left, right, value times weight) of each tree's nodes, as
    arrays; a model's nodes are bounded by its rounds and depth.  Splits are numeric."""
    import uuid

    import numpy as np
    from pyspark.sql import SparkSession

    from fraudlens.session import ensure_checkpoint_dir
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/stages-{uuid.uuid4().hex}"
    model.write().save(path)
    split = "nodeData.split"
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", f"{split}.featureIndex",
        F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).collect()
    out = []
    for t, weight in enumerate(model.treeWeights):
        own = sorted((r for r in rows if r.treeID == t), key=lambda r: r.id)
        inner = [r.leftChild >= 0 for r in own]
        out.append((np.array([r.featureIndex if i else -1 for r, i in zip(own, inner)]), np.array([r.threshold if i else 0.0 for r, i in zip(own, inner)]),
                    np.array([r.leftChild if i else k for k, (r, i) in enumerate(zip(own, inner))]),
                    np.array([r.rightChild if i else k for k, (r, i) in enumerate(zip(own, inner))]), weight * np.array([r.prediction for r in own])))
    return out


def staged_average_precision(model, data: DataFrame, label: str) -> DataFrame:
    """(rounds, ap) of every prefix of the model's trees on ``data`` (features, label), in
    one pass: each task walks the trees over its rows and counts labels by prefix and
    score bin, the counts are summed, and a prefix' AP comes from its bins (scores of one
    of the STAGE_BINS bins count as ties)."""
    from pyspark.ml.functions import vector_to_array
    trees, bins = _tree_arrays(model), STAGE_BINS
    depth = model.getMaxDepth()

    def count(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1)
            y = np.asarray(b.column("y")) > 0
            margin, rows = np.zeros(len(x)), np.arange(len(x))
            key = np.zeros((len(trees), len(x)), dtype=np.int64)
            for t, (feature, threshold, left, right, value) in enumerate(trees):
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                margin += value[at]
                key[t] = t * bins + np.minimum((bins / (1 + np.exp(-2 * margin))).astype(np.int64), bins - 1)
            own, at = np.unique(key, return_inverse=True)
            at = at.reshape(key.shape)
            n, pos = np.bincount(at.ravel(), minlength=len(own)), np.bincount(at[:, y].ravel(), minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array((own // bins + 1).astype(np.int32)), pa.array((own % bins).astype(np.int32)), pa.array(pos), pa.array(n)],
                                             names=["rounds", "bin", "pos", "n"])
    told = data.select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y")).mapInArrow(count, "rounds int, bin int, pos bigint, n bigint")
    told = told.groupBy("rounds", "bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    w = Window.partitionBy("rounds").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # at most STAGE_BINS rows
    told = told.withColumn("precision", F.sum("pos").over(w) / F.sum("n").over(w))
    return told.groupBy("rounds").agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")).otherwise(0.0).alias("ap"))


def first_rounds(model, rounds: int):
    """The model of the first ``rounds`` trees."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession
    sc = SparkSession.getActiveSession().sparkContext
    jvm = sc._jvm
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = sc._gateway.new_array(kind, rounds), sc._gateway.new_array(sc._gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = model.trees[i]._java_obj, float(model.treeWeights[i])
    short = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, 2))
    return model._copyValues(short)


def train_gbt_by_ap(train: DataFrame, val: DataFrame, label: str, weight: str | None = None, patience: int = 100,
                    start: int | None = None, max_rounds: int = 2000, **params):
    """(model, rounds trained, validation AP) of boosting that stops once ``patience``
    rounds brought no better average precision on ``val``, cut at the best round (of equal
    ones the first).  Spark ML cannot go on with a model, so one that has not waited long
    enough is trained again with twice the rounds; its first trees are the same."""
    rounds = min(max_rounds, start or 2 * patience)
    while True:
        model = train_gbt(train, label, weight, maxIter=rounds, **params)
        told = [(r.ap, -r.rounds) for r in staged_average_precision(model, val, label).collect()]  # a row a round
        ap, best = max(told, default=(0.0, -model.getNumTrees))
        if rounds >= max_rounds or rounds + best >= patience or model.getNumTrees < rounds:
            return first_rounds(model, -best), rounds, ap
        rounds = min(max_rounds, 2 * rounds)


def positive_probability(model, df: DataFrame, out: str = "prob") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def importances(model, names: list[str], top_k: int | None = 30) -> DataFrame:
    """J12 + G6: feature importances (bounded by the feature count) ranked,
    normalised by the maximum."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    vals = model.featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double")
    mx = df.select(F.max("importance")).scalar()
    df = df.withColumn("relative", F.when(mx > 0, F.col("importance") / mx).otherwise(0.0))
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(top_k) if top_k else df


def save_model(model, path: str, threshold: float, feature_names: list[str]) -> None:
    """Model + threshold + feature names (params as a JSON table)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(float(threshold), feature_names)], "threshold double, feature_names array<string>") \
         .coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_model(path: str):
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    params = spark.read.json(f"{path}/params").first()
    return GBTClassificationModel.load(f"{path}/model"), params["threshold"], list(params["feature_names"])
