"""Cleaning: canonical schema, types, deduplication, missingness and validity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import binary_label, to_number

LABELS = ("y_7", "y_14", "y_30")


def families(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by their prefix: n_ normalised, r_ raw, y_ labels."""
    return {p: sorted(c for c in columns if c.startswith(f"{p}_")) for p in "nry"}


def schema_union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def canonical_order(columns: Sequence[str], required: Sequence[str], labels: Sequence[str] = LABELS) -> list[str]:
    """Required, labels, n_, r_, then the rest, by name within each group."""
    kind, have = families(columns), set(columns)
    head = [*required, *(c for c in labels if c in have)]
    rest = sorted(have - set(head) - set(kind["n"]) - set(kind["r"]))
    return [*head, *kind["n"], *kind["r"], *rest]


def canonical(df: DataFrame, required: Sequence[str], expected: Sequence[str] = ()) -> DataFrame:
    """Missing columns as null doubles, all in canonical order."""
    lacking = [c for c in (*required, *expected) if c not in df.columns]
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in lacking]).select(*canonical_order([*df.columns, *lacking], required))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def select_columns(df: DataFrame, required: Sequence[str], keep_extra: bool = False) -> DataFrame:
    """The required columns that are there, then features (n_ and r_), then with ``keep_extra`` all others."""
    first = [c for c in required if c in df.columns]
    first += [c for c in df.columns if c.startswith(("n_", "r_")) and c not in first]
    return df.select(*first, *[c for c in df.columns if keep_extra and c not in first])


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Numbers or null; "label" clips to 0 and 1; a "date-number" that is text stays text."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        kind = types.get(c)
        if kind is None or (kind == "date-number" and kinds[c] == "string"):
            return F.col(c)
        if kind == "label":
            return binary_label(F.col(c)).alias(c)
        return to_number(F.col(c), "int" if kind == "date-number" else kind).alias(c)

    return df.select(*[one(c) for c in df.columns])


def coercion_stats(df: DataFrame, types: Mapping[str, str], most: int = 20) -> DataFrame:
    """(column, converted, to_null): values that a coercion kept and those it made null, the most first."""
    cols = [c for c in types if c in df.columns]
    new = lambda c: to_number(F.col(c), "double" if types[c] == "label" else types[c])
    one = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(new(c)).alias(f"k{i}"), F.count_if(F.col(c).isNotNull() & new(c).isNull()).alias(f"l{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("converted"), F.col(f"l{i}").alias("to_null")) for i, c in enumerate(cols)])
    return one.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.desc("to_null"), "column").limit(most)


def dedup_key(columns: Sequence[str], unknown: str | None = "model") -> list[Column]:
    """The key's columns; a null ``unknown`` column counts as UNKNOWN, in the key only."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) if c == unknown else F.col(c) for c in columns]


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str], within: Sequence[str] = (), unknown: str | None = "model") -> DataFrame:
    """The first row of each key in ``order``, within each partition of ``within``; null first keys go."""
    w = W.partitionBy(*within, *dedup_key(key, unknown)).orderBy(*order)
    return df.filter(F.col(key[0]).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def file_order(df: DataFrame) -> DataFrame:
    """Adds the physical order of a file source: src_file, src_row."""
    return df.select("*", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.row_index").alias("src_row"))


def duplicate_rows(df: DataFrame, key: Sequence[str], unknown: str | None = None) -> DataFrame:
    """All rows of keys that more than one row has, by a count joined back (keys can be hot)."""
    names = [f"__k{i}" for i in range(len(key))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(dedup_key(key, unknown), names, strict=True)])
    many = keyed.groupBy(*names).count().filter("count > 1").drop("count")
    on = reduce(lambda a, b: a & b, [keyed[n].eqNullSafe(many[n]) for n in names])
    return keyed.join(many, on, "left_semi").drop(*names)


def duplicate_key_samples(df: DataFrame, key: Sequence[str], by: Sequence[str], most: int = 20) -> DataFrame:
    """At most ``most`` repeated keys of each partition, with their counts."""
    many = df.groupBy(*by, *[k for k in key if k not in by]).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    w = W.partitionBy(*by).orderBy(*[k for k in key if k not in by])
    return many.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)


def column_decisions(df: DataFrame, features: Sequence[str], least: float = 0.01) -> DataFrame:
    """(feature, coverage, decision): keep, low_coverage (below ``least``) or constant."""
    one = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(features) for x in (F.count(c).alias(f"c{i}"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"k{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col("n") > 0, F.col(f"c{i}") / F.col("n")).otherwise(0.0).alias("coverage"), F.col(f"k{i}").alias("k")) for i, c in enumerate(features)])
    flat = one.select(F.explode(rows).alias("r")).select("r.*")
    decision = F.when(F.col("coverage") < least, "low_coverage").when(F.col("k"), "constant").otherwise("keep")
    return flat.select("feature", "coverage", decision.alias("decision"))


def drop_poor_columns(df: DataFrame, features: Sequence[str], least: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Without the features of low coverage or one value; a decision for each feature, on the driver."""
    gone = [r["feature"] for r in column_decisions(df, features, least).collect() if r["decision"] != "keep"]
    return df.drop(*gone), gone


def require_observed(df: DataFrame, features: Sequence[str], least: int = 5) -> DataFrame:
    observed = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in features])
    return df.filter(observed >= least)


def missing_indicators(df: DataFrame, features: Sequence[str], most: int) -> DataFrame:
    """miss_<c> for the features of the lowest coverage (ties by name)."""
    low = column_decisions(df, features, 0.0).filter("decision = 'keep'").orderBy("coverage", "feature").limit(most)
    return df.select("*", *[F.col(r["feature"]).isNull().cast("byte").alias(f"miss_{r['feature']}") for r in low.collect()])


def reject_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks (null: none)."""
    out = None
    for name, broken in rules:
        hit = F.coalesce(broken, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def validity_rules(entity: str, model: str, day: str, raw_day: str, labels: Sequence[str] = LABELS) -> list[tuple[str, Column]]:
    null = lambda c: F.col(c).isNull()
    rules = [(entity, null(entity)), (model, null(model) | (F.col(model) == "")), (day, null(day)), (raw_day, null(raw_day))]
    return rules + [(y, null(y) | ~F.col(y).isin(0, 1)) for y in labels]


def reject_counts(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.select(reject_reason(rules).alias("reason")).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n_rows"))


def reject_samples(df: DataFrame, rules: Sequence[tuple[str, Column]], by: Sequence[str], order: Sequence[str], most: int = 5) -> DataFrame:
    w = W.partitionBy("reason", *by).orderBy(*order)
    return df.withColumn("reason", reject_reason(rules)).filter("reason IS NOT NULL").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)


def keep_valid(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.filter(reject_reason(rules).isNull())


def null_out_of_domain(df: DataFrame, normalised: Sequence[str], raw: Sequence[str]) -> DataFrame:
    """Normalised values outside 0 to 100 and negative raw values become null; the rows stay."""
    fix = {c: F.when(F.col(c).between(0, 100), F.col(c)) for c in normalised} | {c: F.when(F.col(c) >= 0, F.col(c)) for c in raw}
    return df.select(*[fix[c].alias(c) if c in fix else F.col(c) for c in df.columns])


def domain_counts(df: DataFrame, normalised: Sequence[str], raw: Sequence[str]) -> DataFrame:
    """(column, nulled)."""
    cols = [*normalised, *raw]
    bad = [~F.col(c).between(0, 100) if c in normalised else F.col(c) < 0 for c in cols]
    one = df.agg(*[F.count_if(b).alias(f"c{i}") for i, b in enumerate(bad)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulled")) for i, c in enumerate(cols)])).alias("r")).select("r.*")
