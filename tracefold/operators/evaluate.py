"""Splits, prediction aggregation and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracefold import rules
from tracefold.functions.literals import lookup
from tracefold.operators.features import unit_hash
from tracefold.operators.ordering import number_rows, running_total


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def stratified_split(samples: DataFrame, val: float = 0.1, test: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """Exact class shares in test and validation, the rest in training.

    Rows are ordered by a seeded hash inside their class; the position comes
    from a distributed count, so a class may be most of the table.
    """
    ordered = samples.withColumn("_h", unit_hash(seed, F.col("file_id")))
    placed = number_rows(ordered, ["_h", "file_id"], ["label"], "_pos")
    sizes = samples.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    n_test, n_val = F.round(F.col("_n") * test), F.round(F.col("_n") * val)
    part = F.when(F.col("_pos") < n_test, "test").when(
        F.col("_pos") < n_test + n_val, "val").otherwise("train")
    sizes = sizes.withColumnRenamed("label", "_label")
    return (placed.join(sizes, placed["label"].eqNullSafe(sizes["_label"]))
            .withColumn("split", part).drop("_h", "_pos", "_n", "_label"))


def class_distribution(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_weights(samples: DataFrame) -> DataFrame:
    """total / (classes · count) per class."""
    counts = class_distribution(samples)
    every = W.partitionBy(F.lit(1))  # one row per class
    return counts.select("label", "n", (
        F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def mc_aggregate(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Class, confidence and sample variance over repeated passes, per sample or other keys."""
    keys = keys or ["sample_id"]
    per_class = predictions.groupBy(*keys, "class").agg(
        F.avg("prob").alias("mean"), F.var_samp("prob").alias("var"))
    best = F.max_by(F.struct("class", "mean", "var"), F.struct("mean", -F.col("class")))
    return per_class.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.class").alias("prediction"),
        F.col("_b.mean").alias("confidence"), F.col("_b.var").alias("variance"))


def ensemble_mean(predictions: DataFrame) -> DataFrame:
    """Mean over passes of each model, then over models."""
    return (predictions.groupBy("sample_id", "model_id", "class")
            .agg(F.avg("prob").alias("prob")).groupBy("sample_id", "class")
            .agg(F.avg("prob").alias("prob")))


def threshold_predict(probabilities: DataFrame,
                      threshold: float = rules.DECISION_THRESHOLD) -> DataFrame:
    """Decision on the malware probability, confidence and review flag."""
    bad = F.col("prob") >= threshold
    confidence = F.when(bad, F.col("prob")).otherwise(1.0 - F.col("prob"))
    return (probabilities.where(F.col("class") == 1)
            .select("sample_id", bad.cast("int").alias("prediction"),
                    confidence.alias("confidence"),
                    (confidence < rules.REVIEW_CONFIDENCE).alias("needs_review")))


def label_name(prediction: Column) -> Column:
    names = {0: "BENIGN", 1: "MALWARE", -1: "ERROR"}
    return F.coalesce(lookup(prediction.cast("int"), names), F.lit("UNKNOWN"))


def classification_metrics(results: DataFrame) -> DataFrame:
    """Counts and rates from (prediction, label); empty input gives no row."""
    p, l = F.col("prediction"), F.col("label")
    counts = results.agg(
        F.count_if((p == 1) & (l == 1)).alias("tp"), F.count_if((p == 0) & (l == 0)).alias("tn"),
        F.count_if((p == 1) & (l == 0)).alias("fp"), F.count_if((p == 0) & (l == 1)).alias("fn"),
        F.count(F.lit(1)).alias("total"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rates = counts.where(F.col("total") > 0).select(
        "tp", "tn", "fp", "fn", ratio(tp + tn, F.col("total")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"))
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def confusion_matrix(results: DataFrame, classes: int = 2) -> DataFrame:
    """(label, prediction, n) with zero cells kept and other values ignored."""
    cells = [(i, j) for i in range(classes) for j in range(classes)]
    counts = results.agg(*[
        F.count_if((F.col("label") == i) & (F.col("prediction") == j)).alias(f"c_{i}_{j}")
        for i, j in cells])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("label"), F.lit(j).alias("prediction"), F.col(f"c_{i}_{j}").alias("n"))
        for i, j in cells])).alias("_c")).select("_c.*")


def error_lists(results: DataFrame) -> DataFrame:
    """Misclassified samples by kind."""
    p, l = F.col("prediction"), F.col("label")
    kind = F.when((p == 1) & (l == 0), "false_positive").when(
        (p == 0) & (l == 1), "false_negative")
    return results.withColumn("error", kind).where(F.col("error").isNotNull())


def roc_auc(scores: DataFrame) -> DataFrame:
    """Exact rank AUC with ties counted half; 0 when a class is missing.

    Scores are first counted per distinct value, then one distributed running
    total gives the negatives below each value.
    """
    by_score = scores.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"),
                                           F.count_if(F.col("label") == 0).alias("neg"))
    below = running_total(by_score, ["score"], None, {"neg_below": F.col("neg")})
    facts = below.agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("area"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.coalesce(F.col("p"), F.lit(0)).cast("double") * F.coalesce(F.col("n"), F.lit(0))
    return facts.select(ratio(F.col("area"), pairs).alias("auc"))


def class_report(results: DataFrame, classes: int = 2) -> DataFrame:
    """Precision, recall, F1 and support per class (one aggregate)."""
    p, l = F.col("prediction"), F.col("label")
    counts = results.agg(*[c for k in range(classes) for c in (
        F.count_if((p == k) & (l == k)).alias(f"hit_{k}"), F.count_if(p == k).alias(f"said_{k}"),
        F.count_if(l == k).alias(f"true_{k}"))])
    rows = counts.select(F.explode(F.array(*[F.struct(
        F.lit(k).alias("label"), F.col(f"hit_{k}").alias("hit"), F.col(f"said_{k}").alias("said"),
        F.col(f"true_{k}").alias("support")) for k in range(classes)])).alias("_r")).select("_r.*")
    rated = rows.select("label", "support", ratio(F.col("hit"), F.col("said")).alias("precision"),
                        ratio(F.col("hit"), F.col("support")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def weighted_f1(results: DataFrame, classes: int = 2) -> DataFrame:
    report = class_report(results, classes)
    return report.agg(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
                      .alias("weighted_f1"))


def fit_classifier(samples: DataFrame, columns: list[str], max_iter: int = 20):
    """Weighted logistic regression on numeric file features; returns the model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    weights = class_weights(samples).select("label", "weight")
    weighted = samples.join(F.broadcast(weights), "label")  # one row per class
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
              LogisticRegression(maxIter=max_iter, weightCol="weight", regParam=0.01)]
    return Pipeline(stages=stages).fit(weighted)


def predict(model, samples: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(samples)
    # A training set of one class gives a model without a second probability.
    second = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    return scored.withColumn("score", second).select(
        *samples.columns, "score", F.col("prediction").cast("int").alias("prediction"))
