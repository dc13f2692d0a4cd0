"""Exact order statistics and running totals that no single task has to sort or hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Ranges that a column is counted in at a time, and values that may come to the driver for a rank.
BINS, FEW = 4096, 4096


def known(c: str) -> Column:
    """The column as double, null where it isn't a number."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """The exact values at 0-based ranks of columns, nulls and NaN left out.

    Rows are counted by value ranges, BINS for each rank and pass; the range that holds the rank is
    cut again until it has one value or FEW of them. What comes to the driver is at most BINS counts
    or FEW distinct values for each rank.
    """
    if not ranks:
        return {}
    ends = df.agg(*[f(known(c)).alias(f"{n}{i}") for i, c in enumerate(ranks) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    # column, least and greatest value, how many rows stand below, how many are inside, ranks sought
    spans = [(c, ends[f"lo{i}"], ends[f"hi{i}"], 0, None, sorted(set(rs))) for i, (c, rs) in enumerate(ranks.items()) if rs and ends[f"lo{i}"] is not None]
    while spans:
        cuts = []
        for i, (c, lo, hi, _, n, _) in enumerate(spans):
            x, width = known(c), (hi - lo) / BINS
            if n is not None and n <= FEW or width == 0 or lo + width == lo or hi - lo == float("inf"):
                place = x  # each value by itself
            else:
                place = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1)).cast("double")
            cuts.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), place.alias("place"), x.alias("x"))))
        bins = df.select(F.explode(F.array_compact(F.array(*cuts))).alias("s")).groupBy("s.i", "s.place").agg(F.count("*").alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi"))
        by: dict[int, list] = {}
        for i, place, n, lo, hi in bins.collect():
            by.setdefault(i, []).append((place, n, lo, hi))
        left = []
        for i, (c, _, _, below, _, wanted) in enumerate(spans):
            for _, n, lo, hi in sorted(by.get(i, [])):
                inside = [r for r in wanted if below <= r < below + n]
                if lo == hi:
                    found[c] |= dict.fromkeys(inside, lo)
                elif inside:
                    left.append((c, lo, hi, below, n, inside))
                below += n
        spans = left
    return found


def percentiles(df: DataFrame, percents: dict[str, Sequence[float]], lower: bool = False) -> dict[str, dict[float, float | None]]:
    """Exact percentiles of columns: linear between neighbours, or with ``lower`` at rank int(p / 100 * (n - 1))."""
    sizes = df.agg(*[F.count(known(c)).alias(f"n{i}") for i, c in enumerate(percents)]).first()
    n = {c: sizes[i] for i, c in enumerate(percents)}
    at = {c: {p: p / 100 * (n[c] - 1) for p in ps} for c, ps in percents.items() if n[c]}
    values = order_statistics(df, {c: [r for x in ps.values() for r in ((int(x),) if lower else (int(x), min(int(x) + 1, n[c] - 1)))] for c, ps in at.items()})
    out: dict[str, dict[float, float | None]] = {c: dict.fromkeys(ps) for c, ps in percents.items()}
    for c, ps in at.items():
        for p, x in ps.items():
            a = values[c][int(x)]
            b = a if lower else values[c][min(int(x) + 1, n[c] - 1)]
            out[c][p] = a + (b - a) * (x - int(x))
    return out


def running_sums(df: DataFrame, order: str, sums: Sequence[str]) -> DataFrame:
    """``df`` with ``before_`` columns: the sums of the rows that come earlier in descending order.

    Rows are dealt to ranges of ``order``; sums run within a range, and only the ranges' totals, as
    many as partitions, run over all.
    """
    ranged = materialize(df.repartitionByRange(F.desc(order)).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__b_{c}") for c in sums])
    within = W.partitionBy("__part").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    run = ranged.withColumns({f"__w_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(F.broadcast(starts), "__part")
    return run.select(*df.columns, *[(F.col(f"__w_{c}") + F.col(f"__b_{c}")).alias(f"before_{c}") for c in sums])
