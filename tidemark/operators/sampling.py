"""Deterministic caps and samples: the draw is an MD5 of key and seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 42


def draw(key: Sequence[str], seed: int = SEED) -> Column:
    return F.md5(F.encode(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key], F.lit(str(seed))), "UTF-8"))


def chronological_cap(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows in order."""
    return df.orderBy(*order).limit(most)


def partition_pool(df: DataFrame, parts: Sequence[str], most: int) -> DataFrame:
    """Whole partitions in order until ``most`` rows are reached: those before which fewer stand.

    Only the partitions' counts are summed up in order; the cut is a filter on partition columns.
    """
    counts = df.groupBy(*parts).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pool = counts.withColumn("__b", before).filter(F.col("__b") < most).select(*parts)
    return df.join(pool, list(parts), "left_semi")


def first_partitions(df: DataFrame, parts: Sequence[str], most: int) -> DataFrame:
    """The rows of the first ``most`` partitions in order."""
    return df.join(df.select(*parts).distinct().orderBy(*parts).limit(most), list(parts), "left_semi")


def least_draws(df: DataFrame, key: Sequence[str], most: int, seed: int) -> DataFrame:
    """``most`` rows of the least draws (ties by key).

    Rows are counted by the first digits of their draws; only those of the digits that the cut falls
    in are put in order, 1 in 65,536 of all.
    """
    drawn = df.withColumn("__d", draw(key, seed))
    digits = F.substring("__d", 1, 4)
    before = 0
    for first, n in sorted(map(tuple, drawn.groupBy(digits).agg(F.count("*")).collect())):  # 65,536 rows at most
        if before + n > most:
            break
        before += n
    else:
        return df
    edge = drawn.filter(digits == first).select("__d", *key).orderBy("__d", *key).limit(most - before)
    last = edge.agg(F.max(F.struct("__d", *key)).alias("__last"))
    inside = (digits < first) | F.coalesce((digits == first) & (F.struct("__d", *key) <= F.col("__last")), F.lit(False))
    return drawn.crossJoin(F.broadcast(last)).filter(inside).drop("__d", "__last")  # one row


def cap_keep_positives(df: DataFrame, label: str, key: Sequence[str], most: int, seed: int = SEED) -> DataFrame:
    """All positives and a draw of negatives, ``most`` rows in all; more positives than that: a draw of those.

    ``key`` identifies a row.
    """
    pos, neg = df.filter(F.col(label) == 1), df.filter(F.col(label) != 1)
    n_pos = pos.count()
    if n_pos >= most:
        return least_draws(pos, key, most, seed)
    return pos.unionByName(least_draws(neg, key, most - n_pos, seed))


def downsample_negatives(df: DataFrame, label: str, key: Sequence[str], ratio: int, seed: int = SEED) -> DataFrame:
    """``ratio`` negatives for each positive; unchanged without positives or with no more negatives."""
    if ratio < 1:
        raise ValueError("ratio must be at least 1")
    n_pos, n_neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)).first()
    if n_pos == 0 or n_neg <= ratio * n_pos:
        return df
    return df.filter(F.col(label) == 1).unionByName(least_draws(df.filter(F.col(label) != 1), key, ratio * n_pos, seed))
