"""Detection quality: confusion counts, rates, exact AUC, precision-recall curve, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import prefix_by_value

EVENTS_PER_DAY = 50_000_000
MIN_PRECISION, MIN_RECALL = 0.75, 0.90


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row; a score at the threshold counts as flagged."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(F.count_if(hit & real).alias("tp"), F.count_if(~hit & ~real).alias("tn"),
                  F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    df = counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})
    return df.withColumn("passed", (F.col("precision") >= MIN_PRECISION) & (F.col("recall") >= MIN_RECALL))


def by_score(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score, combined before the shuffle."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def score_bin(score: Column) -> Column:
    return F.floor(score * 1000)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; exact."""
    cum = prefix_by_value(by_score(df, label, score), "score", ["neg"], score_bin(F.col("score")))
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    return cum.agg(ratio(F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def precision_recall_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score used as threshold."""
    counts = by_score(df, label, score)
    positives = df.agg(F.count_if(F.col(label) == 1)).scalar()
    cum = prefix_by_value(counts, "score", ["pos", "neg"], score_bin(F.col("score")), descending=True)
    return cum.select(F.col("score").alias("threshold"),
                      ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                      ratio(F.col("cum_pos"), positives).alias("recall"))


def choose_threshold(curve: DataFrame, min_precision: float = MIN_PRECISION, min_recall: float = MIN_RECALL) -> DataFrame:
    """The highest threshold that meets both targets; no row if none does."""
    return (curve.filter((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))
            .orderBy(F.desc("threshold")).limit(1))


def extrapolate(counts: DataFrame, per_day: int = EVENTS_PER_DAY, cost_per_1000: float = 0.18,
                cluster: int = 5) -> DataFrame:
    """Flagged alerts, model calls and cost per day at a given event volume."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    flagged = ratio(per_day * (F.col("tp") + F.col("fp")), total)
    return counts.select(F.floor(flagged).alias("flagged_per_day"),
                         F.floor(ratio(per_day * F.col("tp"), total) / cluster).alias("calls_per_day"),
                         (flagged / 1000 * cost_per_1000).alias("cost_per_day"))


def report(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row per metric."""
    row = rates(confusion(df, threshold, label, score)).withColumn(
        "roc_auc", roc_auc(df, label, score).scalar()).withColumn("passed", F.col("passed").cast("int"))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("m")).select("m.*")


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def percentiles(df: DataFrame, value: str, points: list[float], bin_width: float = 100.0) -> DataFrame:
    """Exact nearest-rank percentiles from counts per distinct value, without a global sort."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(value)).scalar()
    cum = prefix_by_value(counts, "v", ["n"], F.floor(F.col("v") / bin_width))
    return cum.agg(*[F.min(F.when(F.col("cum_n") >= p * total, F.col("v"))).alias(f"p{round(p * 100)}") for p in points])
