"""Next-hour risk: scaling, logistic regression, scoring, evaluation and comparison with rules and anomalies."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.functions import columns as C
from gridlens.operators.aggregate import alert_types_per_key
from gridlens.operators.clean import require_columns
from gridlens.operators.features import split_checks


@dataclass(frozen=True)
class RiskModel:
    """Scaling statistics and coefficients, one number per feature, in feature order."""

    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    version: str = S.MODEL_VERSION

    def margin(self) -> Column:
        terms = zip(S.FEATURES, self.means, self.scales, self.coefficients, strict=True)
        return sum(((F.col(f) - m) / s * c for f, m, s, c in terms), F.lit(self.intercept))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def scaling_statistics(train: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation per feature; a constant feature keeps scale 1."""
    row = train.agg(
        *[F.avg(f).alias(f"mean_{f}") for f in S.FEATURES], *[F.stddev_pop(f).alias(f"scale_{f}") for f in S.FEATURES]
    ).first()
    return [row[f"mean_{f}"] for f in S.FEATURES], [row[f"scale_{f}"] or 1.0 for f in S.FEATURES]


def standardise(df: DataFrame, means: list[float], scales: list[float]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - m) / s for f, m, s in zip(S.FEATURES, means, scales, strict=True)})


def balanced_weights(train: DataFrame, label: str = "high_activity_risk") -> tuple[int, Column]:
    """Row count and the weight column rows / (2 * rows of the label)."""
    sizes = {row[0]: row[1] for row in train.groupBy(label).count().collect()}
    rows = sum(sizes.values())
    if set(sizes) != {0, 1}:
        raise ValueError(f"training needs both classes, found {sorted(sizes)}")
    return rows, F.when(F.col(label) == 1, rows / (2 * sizes[1])).otherwise(rows / (2 * sizes[0]))


def fit_risk(train: DataFrame, max_iter: int = 1000, strength: float = 1.0) -> RiskModel:
    """L2 logistic regression with balanced class weights on standardised features.

    The penalty is 1 / (strength * rows) because Spark averages the loss over the weights while the
    usual C-parametrised objective sums it.
    """
    means, scales = scaling_statistics(train)
    rows, weight = balanced_weights(train)
    vectors = VectorAssembler(inputCols=S.FEATURES, outputCol="features").transform(
        standardise(train, means, scales).withColumn("weight", weight)
    )
    fitted = LogisticRegression(
        featuresCol="features",
        labelCol="high_activity_risk",
        weightCol="weight",
        regParam=1 / (strength * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-9,
    ).fit(vectors.select("features", "high_activity_risk", "weight"))
    return RiskModel(means, scales, [float(c) for c in fitted.coefficients], float(fitted.intercept))


def model_table(spark: SparkSession, model: RiskModel) -> DataFrame:
    return spark.createDataFrame(
        [asdict(model)],
        "means array<double>, scales array<double>, coefficients array<double>, intercept double, version string",
    )


def save_model(spark: SparkSession, model: RiskModel, path: str) -> None:
    model_table(spark, model).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> RiskModel:
    row = spark.read.parquet(path).first()
    model = RiskModel(**row.asDict())
    if len(model.coefficients) != len(S.FEATURES):
        raise ValueError(f"model has {len(model.coefficients)} coefficients, expected {S.FEATURES}")
    return model


def coefficient_table(spark: SparkSession, model: RiskModel) -> DataFrame:
    rows = [(f, c, abs(c)) for f, c in zip(S.FEATURES, model.coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, absolute_coefficient double").orderBy(
        F.desc("absolute_coefficient"), "feature"
    )


def predict(df: DataFrame, model: RiskModel) -> DataFrame:
    return df.withColumn("ml_prediction", F.when(model.margin() > 0, 1).otherwise(0))


def risk_scores(features: DataFrame, model: RiskModel) -> DataFrame:
    """risk_score, risk_level and model_version per feature row."""
    require_columns(features, ["grid_id", "feature_timestamp", *S.FEATURES], "feature table")
    return (
        features.withColumn("risk_score", model.probability())
        .withColumn("risk_level", C.risk_level(F.col("risk_score")))
        .select(
            "grid_id",
            F.col("feature_timestamp").alias("timestamp"),
            "risk_score",
            "risk_level",
            F.lit(model.version).alias("model_version"),
        )
    )


def check_scoring_input(features: DataFrame) -> DataFrame:
    """Fails on an empty feature table or on repeated cell and timestamp keys."""
    require_columns(features, ["grid_id", "feature_timestamp", *S.FEATURES], "feature table")
    keys = features.groupBy("grid_id", "feature_timestamp").count()
    facts = keys.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("count") > 1).alias("repeated")).first()
    if facts["keys"] == 0:
        raise ValueError("feature table is empty")
    if facts["repeated"]:
        raise ValueError(f"feature table repeats {facts['repeated']} cell and timestamp keys")
    return features


def score_one(model: RiskModel, features: dict[str, float]) -> dict:
    """The scoring contract for a single feature record."""
    missing = [f for f in S.FEATURES if f not in features]
    if missing:
        raise ValueError(f"missing model features: {missing}")
    margin = model.intercept
    for f, m, s, c in zip(S.FEATURES, model.means, model.scales, model.coefficients, strict=True):
        margin += (float(features[f]) - m) / s * c
    score = 1 / (1 + math.exp(-margin)) if margin >= 0 else math.exp(margin) / (1 + math.exp(margin))
    level = "HIGH" if score >= S.RISK_HIGH else "MEDIUM" if score >= S.RISK_MEDIUM else "LOW"
    return {"risk_score": score, "risk_level": level, "model_version": model.version}


def score_records(records: DataFrame, model: RiskModel, features: str = "features") -> DataFrame:
    """The scoring contract for a table of records, features being a map of names to numbers: score, level and version, or the names that are missing."""
    missing = F.filter(F.array(*map(F.lit, S.FEATURES)), lambda name: ~F.map_contains_key(features, name))
    named = records.withColumn("missing_features", missing).withColumns({f: F.try_element_at(features, F.lit(f)) for f in S.FEATURES})
    complete = F.size("missing_features") == 0
    scored = named.withColumn("risk_score", F.when(complete, model.probability())).drop(*S.FEATURES)
    return scored.withColumns(
        {"risk_level": F.when(complete, C.risk_level(F.col("risk_score"))), "model_version": F.when(complete, F.lit(model.version))}
    )


def fit_gradient(train: DataFrame, model: RiskModel) -> DataFrame:
    """Gradient of the class-balanced, L2-penalised log loss per row at a model's coefficients: zero where the fit is exact."""
    label = F.col("high_activity_risk")
    rows = standardise(train, model.means, model.scales).withColumn("y", label.cast("double"))
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positive")).first()
    n, positive = counts["n"], counts["positive"]
    margin = F.lit(model.intercept)
    for name, coefficient in zip(S.FEATURES, model.coefficients, strict=True):
        margin = margin + F.col(name) * coefficient
    weight = F.when(F.col("y") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    residual = weight * (1 / (1 + F.exp(-margin)) - F.col("y"))
    sums = [((F.sum(residual * F.col(f)) + c) / n).alias(f) for f, c in zip(S.FEATURES, model.coefficients, strict=True)]
    wide = rows.agg(*sums, (F.sum(residual) / n).alias("intercept"))
    return wide.unpivot([], [*S.FEATURES, "intercept"], "coefficient", "gradient").withColumn("train_rows", F.lit(n))


def evaluate(predicted: DataFrame) -> DataFrame:
    """Confusion counts and accuracy, precision, recall; an undefined ratio is 0."""
    y, p = F.col("high_activity_risk"), F.col("ml_prediction")
    counts = predicted.agg(
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
    )
    tp, fp, fn, tn = (F.col(n) for n in ("true_positives", "false_positives", "false_negatives", "true_negatives"))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    return counts.withColumns(
        {
            "accuracy": share(tp + tn, tp + tn + fp + fn),
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "test_base_rate": share(tp + fn, tp + tn + fp + fn),
        }
    )


def compare_with_rules(predicted: DataFrame, alerts: DataFrame) -> DataFrame:
    """Joins predictions to the rule alerts of the same cell and hour and names the (dis)agreement."""
    rules = alert_types_per_key(alerts).withColumnRenamed("timestamp", "feature_timestamp")
    model, rule = F.col("ml_prediction") == 1, F.col("np3_positive")
    return (
        predicted.join(rules, ["grid_id", "feature_timestamp"], "left")
        .withColumn("np3_positive", F.coalesce("np3_positive", F.lit(False)))
        .withColumn("np3_alert_types", F.coalesce("np3_alert_types", F.lit("NO_ALERT")))
        .withColumn("agreement", model == rule)
        .withColumn(
            "disagreement_type",
            F.when(model & rule, "BOTH_RISK")
            .when(model, "ML3_ONLY_RISK")
            .when(rule, "NP3_ONLY_ALERT")
            .otherwise("AGREEMENT"),
        )
    )


def agreement_counts(compared: DataFrame) -> DataFrame:
    kind = F.col("disagreement_type")
    return compared.agg(
        F.count_if("np3_positive").alias("np3_positive_test_rows"),
        F.count_if(F.col("ml_prediction") == 1).alias("ml3_positive_test_rows"),
        F.count_if(kind == "BOTH_RISK").alias("both_positive"),
        F.count_if(kind == "ML3_ONLY_RISK").alias("ml3_only_risk"),
        F.count_if(kind == "NP3_ONLY_ALERT").alias("np3_only_alert"),
        F.count_if("agreement").alias("agreement"),
    )


def evaluation_record(split: DataFrame, compared_test: DataFrame, threshold: float) -> DataFrame:
    """One nested record per run: algorithm, threshold, metrics, split bounds, class rates and rule comparison."""
    parts = {
        "metrics": evaluate(compared_test),
        "split": split_checks(split),
        "rates": split.agg(
            F.avg(F.when(F.col("split") == "train", F.col("high_activity_risk"))).alias("train_positive_rate"),
            F.avg(F.when(F.col("split") == "test", F.col("high_activity_risk"))).alias("test_positive_rate"),
        ),
        "np3_comparison": agreement_counts(compared_test),
    }
    rows = None
    for name, part in parts.items():
        row = part.select(F.struct("*").alias(name))
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    return rows.agg(
        F.lit("Logistic Regression").alias("algorithm"), F.lit(float(threshold)).alias("threshold"), *[F.max(n).alias(n) for n in parts]
    )


def three_way(
    labelled: DataFrame, scores: DataFrame, alerts: DataFrame, positive_col: str = "high_activity_risk"
) -> DataFrame:
    """Model, anomaly and rule flags of the same cell and hour side by side.

    positive_col is the label by default; pass "ml_prediction" to compare predictions.
    """
    keys = ["grid_id", "feature_timestamp"]
    anomalies = scores.select(
        "grid_id",
        F.col("timestamp").alias("feature_timestamp"),
        "anomaly_score",
        "direction",
        F.col("direction").isin("HIGH", "LOW").alias("ml4_positive"),
    )
    rules = (
        alerts.where(F.col("alert_type").isin(S.RISING_ALERTS))
        .select("grid_id", F.col("timestamp").alias("feature_timestamp"))
        .distinct()
        .withColumn("np3_positive", F.lit(True))
    )
    joined = labelled.join(anomalies, keys, "left").join(rules, keys, "left")
    flags = joined.withColumns(
        {
            "ml3_positive": F.col(positive_col) == 1,
            "ml4_positive": F.coalesce("ml4_positive", F.lit(False)),
            "np3_positive": F.coalesce("np3_positive", F.lit(False)),
        }
    )
    return flags.withColumn("three_way_result", three_way_label())


# --- fixed values: label of each combination of the anomaly, model and rule flags ---
THREE_WAY_LABELS = {
    (True, True, True): "ALL_THREE",
    (True, True, False): "ML4_ML3",
    (True, False, True): "ML4_NP3",
    (False, True, True): "ML3_NP3",
    (True, False, False): "ML4_ONLY",
    (False, True, False): "ML3_ONLY",
    (False, False, True): "NP3_ONLY",
    (False, False, False): "ALL_NEGATIVE",
}


def three_way_label() -> Column:
    label = F.lit(None).cast("string")
    for (anomaly, model, rule), name in THREE_WAY_LABELS.items():
        matches = (F.col("ml4_positive") == anomaly) & (F.col("ml3_positive") == model) & (F.col("np3_positive") == rule)
        label = F.when(matches, name).otherwise(label)
    return label
