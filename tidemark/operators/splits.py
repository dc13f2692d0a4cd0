"""Chronological train, validation and test splits without entities in common."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name -> (first day, last day), both included.
Windows = Mapping[str, tuple[str, str]]


def in_window(df: DataFrame, day: str, first: str, last: str, year: str | None = None, month: str | None = None) -> DataFrame:
    """Days from first to last; with year and month partition columns also a predicate that prunes them."""
    out = df.filter((F.col(day) >= F.lit(first).cast("timestamp")) & (F.col(day) < F.date_add(F.lit(last).cast("date"), 1)))
    if year and month:
        label = F.concat(F.col(year).cast("string"), F.lpad(F.col(month).cast("string"), 2, "0"))
        out = out.filter(label.between(first[:7].replace("-", ""), last[:7].replace("-", "")))
    return out


def time_split(df: DataFrame, day: str, windows: Windows, into: str = "split") -> DataFrame:
    """Adds the name of the window that a row's day is in; rows in none go."""
    value = None
    for name, (first, last) in windows.items():
        inside = (F.col(day) >= F.lit(first).cast("timestamp")) & (F.col(day) < F.date_add(F.lit(last).cast("date"), 1))
        value = F.when(inside, name) if value is None else value.when(inside, name)
    return df.withColumn(into, value).filter(F.col(into).isNotNull())


def entities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys)).select(*keys).distinct()


def without_entities(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a null in the keys stay."""
    return df.join(gone, list(keys), "left_anti")


def disjoint_splits(df: DataFrame, day: str, windows: Windows, keys: Sequence[str], policy: str = "train_eval") -> dict[str, DataFrame]:
    """Frames by split. Policies: none; train_eval: train loses the entities of validation and test;
    all: validation also loses those of test."""
    if policy not in ("none", "train_eval", "all"):
        raise ValueError(f"unknown policy {policy}")
    parts = {n: in_window(df, day, *w) for n, w in windows.items()}
    if policy == "none":
        return parts
    names = list(windows)
    out = {names[-1]: parts[names[-1]]}
    later = entities(parts[names[-1]], keys)
    for n in reversed(names[1:-1]):
        out[n] = without_entities(parts[n], later, keys) if policy == "all" else parts[n]
        later = later.union(entities(parts[n], keys)).distinct()
    out[names[0]] = without_entities(parts[names[0]], later, keys)
    return {n: out[n] for n in names}


def split_accounting(df: DataFrame, day: str, windows: Windows, keys: Sequence[str], policy: str = "train_eval") -> DataFrame:
    """(split, rows_in_window, rows_out, entities_in_window, entities_out)."""
    before = time_split(df, day, windows)
    count = lambda f, a, b: f.groupBy("split").agg(F.count("*").alias(a), F.count_distinct(F.struct(*keys)).alias(b))
    after = reduce(DataFrame.unionByName, [f.withColumn("split", F.lit(n)) for n, f in disjoint_splits(df, day, windows, keys, policy).items()])
    joined = count(before, "rows_in_window", "entities_in_window").join(count(after, "rows_out", "entities_out"), "split", "left")
    return joined.select("split", "rows_in_window", F.coalesce("rows_out", F.lit(0)).alias("rows_out"), "entities_in_window", F.coalesce("entities_out", F.lit(0)).alias("entities_out"))


def split_labels(parts: Mapping[str, DataFrame], labels: Sequence[str], day: str) -> DataFrame:
    """(split, n_rows, first_day, last_day, <label>_pos ...)."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("split", F.lit(n)) for n, f in parts.items()])
    return tagged.groupBy("split").agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), *[F.count_if(F.col(y) == 1).alias(f"{y}_pos") for y in labels])
