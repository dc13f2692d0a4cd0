"""Evaluation of scores: confusion, average precision, ROC-AUC and threshold choice.

Rows are added up by score before anything is ordered; running sums go range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running_sums


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return {"accuracy": _share(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": _share(2 * tp, 2 * tp + fp + fn)}


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: threshold, tn, fp, fn, tp, accuracy, precision, recall, f1 (0 where undefined)."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    one = df.agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    rates = _rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return one.select(F.lit(float(threshold)).alias("threshold"), "tn", "fp", "fn", "tp", *[F.round(v, 6).alias(k) for k, v in rates.items()])


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: sum of recall steps times precision, ties together; 0 without positives."""
    run = running_sums(by_score(df, score, label), "score", ["pos", "neg"])
    tp = F.col("before_pos") + F.col("pos")
    k = tp + F.col("before_neg") + F.col("neg")
    return run.agg(F.round(_share(F.sum(F.col("pos") * tp / k), F.sum("pos")), 6).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: exact, ties as halves; 0 where a class is missing."""
    run = running_sums(by_score(df, score, label), "score", ["pos"])
    won = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2))
    return run.agg(F.round(F.coalesce(_share(won, F.sum("pos") * F.sum("neg")), F.lit(0.0)), 6).alias("roc_auc"))


def threshold_scan(df: DataFrame, score: str, label: str, step: float = 0.01) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) for 0.01, 0.01 + step, ... below 1.

    Scores are counted by the number of thresholds they reach; thresholds then sum up from above.
    """
    n = round(0.99 / step + 1e-9)
    ts = [round(0.01 + i * step, 10) for i in range(n) if 0.01 + i * step < 1 - 1e-12]
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= F.col(score)))
    counts = df.groupBy(reached.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "i int, threshold double")
    total = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))
    # len(ts) + 1 rows on one side, len(ts) on the other
    hit = F.broadcast(grid).join(counts, F.col("k") >= F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    full = hit.crossJoin(F.broadcast(total)).select("threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    rates = _rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return full.select("*", *[F.round(rates[k], 6).alias(k) for k in ("precision", "recall", "f1")])


def best_threshold(scan: DataFrame) -> DataFrame:
    """One row: the lowest threshold of the highest F1; 0.5 if every F1 is 0."""
    f1 = _rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))["f1"]  # not rounded
    best = scan.agg(F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("t"), F.max(f1).alias("best_f1"))
    return best.select(F.when(F.col("best_f1") > 0, F.col("t")).otherwise(0.5).alias("threshold"), F.round(F.coalesce("best_f1", F.lit(0.0)), 6).alias("best_f1"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: balanced weights n / (2 n_c), and negatives over positives (1 without positives)."""
    one = df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) != 1).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    weight = lambda c: F.round(F.when(F.col(c) > 0, n / (2 * F.col(c))), 6)
    return one.select("n_pos", "n_neg", weight("n_pos").alias("w_pos"), weight("n_neg").alias("w_neg"), F.round(F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(1.0), 6).alias("pos_weight"))


def evaluate(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Confusion, average precision and ROC-AUC in one row."""
    return confusion(df, score, label, threshold).crossJoin(average_precision(df, score, label)).crossJoin(roc_auc(df, score, label))
