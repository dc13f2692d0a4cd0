"""Univariate feature ranking by the ROC-AUC of label-conditional histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite

BINS = 256
LEAST_VALUES = 50_000


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns without those excluded (all of them if none is left)."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    found = [c for c, t in df.dtypes if t in kinds or t.startswith("decimal")]
    return [c for c in found if c not in exclude] or found


def long_pairs(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, x, y): one row a feature and row, where both are finite."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("x")) for c in features])
    flat = df.select(finite(F.col(label)).alias("y"), F.explode(pairs).alias("p")).select("p.feature", "p.x", "y")
    return flat.filter("x IS NOT NULL AND y IS NOT NULL")


def label_histogram(df: DataFrame, features: Sequence[str], label: str, bins: int = BINS, least: int = LEAST_VALUES) -> DataFrame:
    """(feature, bin, pos, neg) over equal bins from least to greatest value.

    Features of fewer than ``least`` values, of one value or of one class are left out. The
    extremes of all features are one row each, and come from one pass.
    """
    pairs = long_pairs(df, features, label)
    stats = pairs.groupBy("feature").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("y") == 1).alias("p"))
    fit = stats.filter((F.col("n") >= least) & (F.col("lo") < F.col("hi")) & (F.col("p") > 0) & (F.col("p") < F.col("n"))).select("feature", "lo", "hi")
    place = F.least(F.expr(f"width_bucket(x, lo, hi, {bins})") - 1, F.lit(bins - 1)).cast("int")
    joined = pairs.join(F.broadcast(fit), "feature").withColumn("bin", place)  # a row a feature
    return joined.groupBy("feature", "bin").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))


def auc_of_bins(hist: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """AUC with ties as halves: each negative counts the positives above it and half of its bin's."""
    w = W.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    above = hist.withColumn("above", F.coalesce(F.sum("pos").over(w), F.lit(0)))
    p, n = F.sum("pos"), F.sum("neg")
    won = F.sum(F.col("neg") * (F.col("above") + F.col("pos") / 2))
    return above.groupBy(*by).agg(p.alias("n_pos"), n.alias("n_neg"), F.when((p > 0) & (n > 0), won / (p * n)).otherwise(0.5).alias("auc"))


def rank_features(df: DataFrame, features: Sequence[str], label: str, bins: int = BINS, least: int = LEAST_VALUES) -> DataFrame:
    """(rank, feature, auc, abs_auc_minus_0_5, n_pos, n_neg) by distance from one half, ties by name."""
    scored = auc_of_bins(label_histogram(df, features, label, bins, least), ["feature"], "bin")
    apart = F.abs(F.col("auc") - 0.5)
    rank = F.row_number().over(W.orderBy(F.desc("apart"), "feature"))  # a row a feature
    return scored.withColumn("apart", apart).select(rank.alias("rank"), "feature", F.round("auc", 6).alias("auc"), F.round("apart", 6).alias("abs_auc_minus_0_5"), "n_pos", "n_neg")
