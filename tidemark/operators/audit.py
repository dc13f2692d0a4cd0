"""Read-only profiles and acceptance checks: one aggregate pass each, long-form results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranks import percentiles


def long_form(df: DataFrame, columns: Sequence[str], measures: dict[str, object], name: str = "column") -> DataFrame:
    """One row a column, one value a measure (a function from Column to aggregate), in one pass."""
    one = df.agg(*[f(F.col(c)).alias(f"m{i}_{j}") for i, c in enumerate(columns) for j, f in enumerate(measures.values())])
    rows = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"m{i}_{j}").alias(m) for j, m in enumerate(measures)]) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def row_counts(df: DataFrame, by: Sequence[str], rollup: bool = False) -> DataFrame:
    """Rows of each partition; with ``rollup`` also of each prefix and of all."""
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return grouped.agg(F.count("*").alias("n_rows"))


def missing_pct(c: Column) -> Column:
    return F.round(F.when(F.count("*") > 0, 100 * F.count_if(c.isNull()) / F.count("*")).otherwise(0.0), 6)


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns, {"missing": lambda c: F.count_if(c.isNull()), "missing_pct": missing_pct})


def mean_missing_by_file(df: DataFrame, columns: Sequence[str], file: str, most: int = 10) -> DataFrame:
    """(column, mean_missing_pct): the plain mean of the files' percentages, the highest first."""
    per = df.groupBy(file).agg(*[(100 * F.count_if(F.col(c).isNull()) / F.count("*")).alias(c) for c in columns])
    return long_form(per, columns, {"mean_missing_pct": lambda c: F.round(F.avg(c), 6)}).orderBy(F.desc("mean_missing_pct"), "column").limit(most)


def cell_missing_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the share of missing cells over all the columns."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return df.agg(F.round(F.when(F.count("*") > 0, 100 * missing / (F.count("*") * len(columns))).otherwise(0.0), 6).alias("missing_pct"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    r = lambda f: lambda c: F.round(f(c), 6)
    return long_form(df, columns, {"n": F.count, "min_value": r(F.min), "max_value": r(F.max), "sum_value": lambda c: F.round(F.sum(c), 2), "mean_value": r(F.avg)})


def quantiles_linear(df: DataFrame, columns: Sequence[str], qs: Sequence[float] = (0.01, 0.5, 0.99)) -> DataFrame:
    """Exact, with linear interpolation; a row a column."""
    found = percentiles(df, {c: [100 * q for q in qs] for c in columns})
    rows = [(c, *(found[c][100 * q] for q in qs)) for c in columns]
    names = [f"q{int(q * 100)}" for q in qs]
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{n} double" for n in names)).select("column", *[F.round(n, 6).alias(n) for n in names])


def quantiles_lower(df: DataFrame, columns: Sequence[str], percents: Sequence[float] = (0.1, 1, 99, 99.9)) -> DataFrame:
    """(column, percent, value): the exact value at 0-based rank int(p / 100 * (n - 1))."""
    found = percentiles(df, dict.fromkeys(columns, percents), lower=True)
    rows = [(c, float(p), found[c][p]) for c in columns for p in percents]
    return df.sparkSession.createDataFrame(rows, "column string, percent double, value double").withColumn("value", F.round("value", 6))


def outlier_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population deviation, zeros, negatives, ends, percentiles, values beyond p99.9, flags and a score.

    Percentiles are values at rank int(p / 100 * (n - 1)). The score adds up the span over the least
    value (the greatest value where the least is 0; nothing where they are equal), p99.9 over p1 where
    that is positive, and the percentage of negatives. A column without values has none.
    """
    measures = {"n": F.count, "zeros": lambda c: F.count_if(c == 0), "negatives": lambda c: F.count_if(c < 0), "mean_value": F.avg, "std_value": F.stddev_pop, "min_value": F.min, "max_value": F.max}
    base = {r["column"]: r for r in long_form(df, columns, measures).collect()}  # a row a column
    cuts = percentiles(df, dict.fromkeys(columns, (1, 99, 99.9)), lower=True)
    beyond = df.agg(*[F.count_if(F.col(c) > F.lit(cuts[c][99.9])).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    rows = [(*base[c], beyond[i], *(cuts[c][p] for p in (1, 99, 99.9))) for i, c in enumerate(columns)]
    kinds = "column string, n long, zeros long, negatives long, mean_value double, std_value double, min_value double, max_value double, extremes long, p1 double, p99 double, p999 double"
    found = df.sparkSession.createDataFrame([tuple(float(x) if 4 <= i <= 7 and x is not None else x for i, x in enumerate(r)) for r in rows], kinds)
    lo, hi, c = F.col("min_value"), F.col("max_value"), F.col
    span = F.when(lo == hi, 0.0).when(lo != 0, (hi - lo) / F.abs(lo)).otherwise(F.abs(hi))
    score = span + F.when(c("p1") > 0, c("p999") / c("p1")).otherwise(0.0) + 100 * c("negatives") / c("n")
    return found.select(
        "column", "n", "zeros", "negatives", "extremes", *[F.round(x, 6).alias(x) for x in ("mean_value", "std_value", "min_value", "max_value", "p1", "p99", "p999")],
        (c("negatives") > 0).alias("flag_negative"), F.coalesce((c("p99") > 0) & (c("p999") / c("p99") > 10), F.lit(False)).alias("flag_skew"),
        F.coalesce((c("p999") > 0) & (hi / c("p999") > 10), F.lit(False)).alias("flag_tail"), F.round(F.when(c("n") > 0, score), 6).alias("score"),
    )


def most_extreme(profile: DataFrame, most: int = 30) -> DataFrame:
    """The columns of the highest scores; those without values have none."""
    return profile.filter("score IS NOT NULL").orderBy(F.desc("score"), "column").limit(most)


def duplicate_rate(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: keyed rows, distinct keys, duplicate_pct; rows with a null in the key are left out."""
    keyed = df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("c"))
    n, u = F.coalesce(F.sum("c"), F.lit(0)), F.count("*")
    return keyed.agg(n.alias("n_rows"), u.alias("n_keys"), F.round(F.when(n > 0, 100 * (n - u) / n).otherwise(0.0), 6).alias("duplicate_pct"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of their kind."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("__c")).agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("n_duplicates"))


def entity_counts(df: DataFrame, keys: Sequence[Sequence[str]], approximate: bool = False) -> DataFrame:
    """One row: distinct entities for each key; rows with a null in it are left out."""
    value = lambda k: F.when(~F.array_contains(F.array(*[F.col(c).isNull() for c in k]), True), F.struct(*k))
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(value(k)).alias("n_" + "_".join(k)) for k in keys])


def date_range(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(day).alias("n_days"))


def nesting_violations(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: how often a shorter horizon is 1 and the next longer one 0, all such pairs added."""
    pairs = [F.count_if((F.col(a) == 1) & (F.col(b) == 0)) for a, b in zip(labels, labels[1:], strict=False)]
    return df.agg(sum(pairs[1:], pairs[0]).alias("violations"))


def schema_drift(files: DataFrame, file: str = "file", columns: str = "columns") -> DataFrame:
    """(schema, n_files, is_mode): column sets of files, the commonest marked (ties: the first by text)."""
    by = files.groupBy(F.array_join(F.array_sort(columns), ",").alias("schema")).agg(F.count(file).alias("n_files"))
    top = by.agg(F.max_by("schema", F.struct(F.col("n_files"), F.lit(0))).alias("s"), F.max("n_files").alias("m"))
    mode = by.join(top, by["n_files"] == top["m"]).agg(F.min("schema").alias("mode"))
    return by.crossJoin(F.broadcast(mode)).select("schema", "n_files", (F.col("schema") == F.col("mode")).alias("is_mode"))


def dtype_drift(files: DataFrame, column: str = "column", dtype: str = "dtype") -> DataFrame:
    """Columns that have more than one type over the files, with the types."""
    return files.groupBy(column).agg(F.array_join(F.array_sort(F.collect_set(dtype)), ",").alias("dtypes"), F.count_distinct(dtype).alias("n_types")).filter("n_types > 1")


#: A column that isn't required may have so many per cent of its rows missing, and less.
MOST_MISSING = 95.0


def type_issues(df: DataFrame, entity: str, model: str, day: str, labels: Sequence[str]) -> list[str]:
    """Columns of another type than theirs: ids whole, models text, days dates, labels bytes, n_ and r_ columns fractions."""
    wanted = {entity: T.IntegralType, model: T.StringType, day: (T.DateType, T.TimestampType, T.TimestampNTZType), **dict.fromkeys(labels, T.ByteType)}
    wanted = dict.fromkeys([c for c in df.columns if c.startswith(("n_", "r_"))], T.FractionalType) | wanted
    return [f.name for f in df.schema if f.name in wanted and not isinstance(f.dataType, wanted[f.name])]


def acceptance(
    df: DataFrame, entity: str, model: str, day: str, labels: Sequence[str], required: Sequence[str] = (),
    first_day: str | None = None, last_day: str | None = None, schemas: Sequence[Sequence[str]] = (), expected_rows: int | None = None,
) -> DataFrame:
    """(criterion, n_bad, passed) for each of eight criteria, and "overall": all of them.

    schema_consistency: of ``schemas``, the partitions' columns, those unlike the first, and required
    columns that are missing. type_consistency: columns of another type. uniqueness: rows beyond the
    first of their entity, model and day. missingness: required columns with any value missing,
    others with MOST_MISSING per cent or more. label_distribution: labels without values or with
    others than 0 and 1. label_nesting: rows whose shorter horizon is 1 and the next one 0.
    date_coverage: ends of the dates outside the expected ones. row_reconciliation: rows more or less
    than expected, where a count is expected.
    """
    must = list(required) or [entity, model, day, *labels]
    have = [c for c in must if c in df.columns]
    n = F.count("*")
    share = lambda c: F.when(n > 0, 100 * F.count_if(F.col(c).isNull()) / n).otherwise(0.0)
    total = lambda xs: sum((x.cast("long") for x in xs), F.lit(0).cast("long"))
    missing = [share(c) > 0 for c in have] + [share(c) >= MOST_MISSING for c in df.columns if c not in must]
    binary = [(F.count(y) == 0) | (F.count_if(F.col(y).isin(0, 1)) != F.count(y)) for y in labels]
    nested = F.lit(False)
    for a, b in zip(labels, labels[1:], strict=False):
        nested = nested | ((F.col(a) == 1) & (F.col(b) == 0))
    early = F.coalesce(F.min(day) < F.lit(first_day).cast("date"), F.lit(False)) if first_day else F.lit(False)
    late = F.coalesce(F.max(day) > F.lit(last_day).cast("date"), F.lit(False)) if last_day else F.lit(False)
    one = df.agg(
        F.lit(sum(list(x) != list(schemas[0]) for x in schemas) + len(must) - len(have)).alias("schema_consistency"),
        F.lit(len(type_issues(df, entity, model, day, labels))).alias("type_consistency"), total(missing).alias("missingness"), total(binary).alias("label_distribution"),
        F.count_if(nested).alias("label_nesting"), total([early, late]).alias("date_coverage"),
        (F.abs(n - expected_rows) if expected_rows is not None else F.lit(0)).alias("row_reconciliation"),
    )
    unique = duplicate_rate(df, [entity, model, day]).select((F.col("n_rows") - F.col("n_keys")).alias("uniqueness"))
    names = [*one.columns, "uniqueness"]
    rows = [F.struct(F.lit(x).alias("criterion"), F.col(x).cast("long").alias("n_bad")) for x in names]
    overall = F.struct(F.lit("overall").alias("criterion"), total([F.col(x) for x in names]).alias("n_bad"))
    both = one.crossJoin(unique)  # one row each
    return both.select(F.explode(F.array(*rows, overall)).alias("r")).select("r.criterion", "r.n_bad", (F.col("r.n_bad") == 0).alias("passed"))


def integrity_checks(df: DataFrame, entity: Sequence[str], day: str, model: str, labels: Sequence[str], normalised: Sequence[str], raw: Sequence[str]) -> DataFrame:
    """(criterion, n_bad, passed) for each of eight checks of single rows and keys, and "overall"."""
    null_key = F.lit(False)
    for c in (*entity, day):
        null_key = null_key | F.col(c).isNull()
    low = sum((F.count_if(~F.col(c).between(0, 100)) for c in normalised), F.lit(0))
    negative = sum((F.count_if(F.col(c) < 0) for c in raw), F.lit(0))
    bad_label = sum((F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)) for y in labels), F.lit(0))
    nested = sum((F.count_if((F.col(a) == 1) & (F.col(b) == 0)) for a, b in zip(labels, labels[1:], strict=False)), F.lit(0))
    one = df.agg(
        F.when(F.count("*") > 0, 0).otherwise(1).alias("has_rows"), F.count_if(null_key).alias("keys_known"),
        F.count_if(F.col(model).isNull() | (F.col(model).cast("string") == "")).alias("model_known"), bad_label.alias("labels_binary"),
        nested.alias("labels_nested"), low.alias("normalised_range"), negative.alias("raw_not_negative"),
    )
    unique = duplicate_rate(df, [*entity, model, day]).select((F.col("n_rows") - F.col("n_keys")).alias("keys_unique"))
    names = [*one.columns, "keys_unique"]
    both = one.crossJoin(unique)  # one row each
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).cast("long").alias("n_bad")) for n in names], F.struct(F.lit("overall").alias("criterion"), sum((F.col(n).cast("long") for n in names), F.lit(0).cast("long")).alias("n_bad")))
    return both.select(F.explode(rows).alias("r")).select("r.criterion", "r.n_bad", (F.col("r.n_bad") == 0).alias("passed"))


def smoke_checks(df: DataFrame, before_rows: int, keys: Sequence[str], families: dict[str, str]) -> DataFrame:
    """(check, ok): rows kept, keys there, a column of each family, ages not negative, log1p finite where its base is."""
    have = {n: any(c.startswith(p) for c in df.columns) for n, p in families.items()}
    age = F.count_if(F.col("age_days") < 0) if "age_days" in df.columns else F.lit(1)
    logs = [c for c in df.columns if c.startswith("log1p_") and c[6:] in df.columns]
    lost = sum((F.count_if(F.col(c[6:]).isNotNull() & F.col(c).isNull()) for c in logs), F.lit(0))
    one = df.agg(F.count("*").alias("n"), age.alias("age"), lost.alias("lost"))
    checks = [("rows_kept", F.col("n") >= before_rows), ("keys_present", F.lit(all(k in df.columns for k in keys))), ("age_not_negative", F.col("age") == 0), ("log1p_finite", F.col("lost") == 0)]
    checks += [(f"family_{n}", F.lit(ok)) for n, ok in have.items()]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("ok")) for n, c in checks])).alias("r")).select("r.*")
