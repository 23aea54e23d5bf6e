"""Training of the linear ranker and of its calibrators with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .score import TRAINED_FEATURES, TrainedRanker, sigmoid, stratum

LEAST_STRATUM, LEAST_ISOTONIC = 15, 40


def examples(pairs: DataFrame, labels: DataFrame, keep: int = 10) -> DataFrame:
    """Training rows: of each request its best ``keep`` pairs by name similarity and the true one.

    ``pairs`` are features with matched objects (``has_label``: the object holds
    the label's house); requests with a label whose object is missing are left out.
    """
    rows = pairs.join(labels.select("id", "label"), "id")
    order = Window.partitionBy("id").orderBy(F.desc("street_sim"), "name_rank", "obj_seq")
    hit = F.coalesce("has_label", F.lit(False)) & F.col("label").isNotNull()
    first = F.row_number().over(Window.partitionBy("id").orderBy(hit.desc(), "name_rank", "obj_seq")) == 1
    d = rows.withColumn("rn", F.row_number().over(order)).withColumn("y", F.when(hit & first, 1.0).otherwise(0.0))
    d = d.withColumn("found", F.max("y").over(Window.partitionBy("id")))
    return d.filter((F.col("label").isNull() | (F.col("found") > 0)) & ((F.col("rn") <= keep) | (F.col("y") > 0))).drop("found", "rn")


def split(labels: DataFrame, seed: int = 42, share: float = 0.25) -> DataFrame:
    """``labels`` with is_val: a share of each channel and kind, in the order of a keyed hash."""
    group = [F.col("channel"), F.col("label").isNull()]
    order = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return labels.withColumn("is_val", F.row_number().over(order) <= F.ceil(n * share))


def _logistic(rows: DataFrame, features: list[str], strength: float, weight: str | None) -> tuple[list[float], float]:
    """Coefficients and intercept of an L2-penalised logistic regression; ``strength`` multiplies the loss."""
    total = rows.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (strength * total), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10)
    fitted = (model.setWeightCol(weight) if weight else model).fit(data)
    return [float(c) for c in fitted.coefficients], float(fitted.intercept)


def fit_calibrator(rows: DataFrame) -> dict:
    """Calibrator of (z, p, y): identity with one class, isotonic from forty rows on, else a sigmoid of z."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes")).first()
    if stats.classes < 2:
        return {"type": "identity", "n": stats.n}
    if stats.n < LEAST_ISOTONIC:
        (a,), b = _logistic(rows, ["z"], 1e6, None)
        return {"type": "platt", "a": a, "b": b, "n": stats.n}
    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(rows)
    return {"type": "isotonic", "x": [float(v) for v in model.boundaries], "y": [float(v) for v in model.predictions], "n": stats.n}


def fit(train: DataFrame, val: DataFrame, strength: float = 0.3, balanced: bool = True, features: list[str] | None = None, seed: int = 42) -> dict:
    """Model document from training and validation examples (feature columns and y)."""
    features = features or list(TRAINED_FEATURES)
    weight = None
    if balanced:
        n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
        train = train.withColumn("w", F.when(F.col("y") > 0, sum(n.values()) / (2 * max(n.get(1.0, 1), 1))).otherwise(sum(n.values()) / (2 * max(n.get(0.0, 1), 1))))
        weight = "w"
    coef, intercept = _logistic(train, features, strength, weight)
    freq = train.agg(F.median("name_freq")).first()[0] or 0.0
    model = {"version": 1, "feature_names": features, "coef": coef, "intercept": intercept, "freq_median": float(freq), "seed": seed}
    z = TrainedRanker(model).logit()
    scored = val.withColumn("z", z).withColumn("p", sigmoid(z)).withColumn("stratum", stratum(float(freq))).select("z", "p", "y", "stratum").persist()
    model["global_calibrator"] = fit_calibrator(scored)
    # a stratum is one of eight: channel, frequency and city each have two values
    counts = scored.groupBy("stratum").count().filter(F.col("count") >= LEAST_STRATUM).collect()
    model["strata_calibrators"] = {r.stratum: fit_calibrator(scored.filter(F.col("stratum") == r.stratum)) for r in counts}
    scored.unpersist()
    return model
