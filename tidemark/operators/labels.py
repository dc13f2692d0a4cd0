"""Failure labels: date-time format inference, deduplication and time-to-failure horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import DATETIME_FORMATS, days_between, epoch, horizon_label, parsed

HORIZONS = (7, 14, 30)
#: A format is taken as soon as it parses this share of the values.
ENOUGH = 0.95


def candidate_formats() -> dict[str, object]:
    """Name -> function from column to timestamp column, in the order in which they are tried."""
    found = {p: (lambda c, p=p, s=s: parsed(c, p, s)) for p, s in DATETIME_FORMATS}
    return found | {"epoch_seconds": lambda c: epoch(c, 10), "epoch_milliseconds": lambda c: epoch(c, 13)}


def format_rates(df: DataFrame, column: str) -> DataFrame:
    """(format, parsed, total): how many values each format parses, in one pass over the data."""
    formats = candidate_formats()
    one = df.agg(F.count(column).alias("total"), *[F.count(f(F.col(column))).alias(f"f{i}") for i, f in enumerate(formats.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("format"), F.lit(i).alias("nth"), F.col(f"f{i}").alias("parsed")) for i, n in enumerate(formats)])
    return one.select("total", F.explode(pairs).alias("p")).select("p.format", "p.nth", "p.parsed", "total")


def infer_format(df: DataFrame, column: str) -> str | None:
    """The one format of the column: the first that parses ENOUGH, else of the explicit patterns the
    best; epochs only where no pattern parses anything. None if nothing parses."""
    rates = {r["format"]: (r["nth"], r["parsed"], r["total"]) for r in format_rates(df, column).collect()}
    explicit = [n for n, _ in DATETIME_FORMATS]
    for name in explicit:
        if rates[name][2] and rates[name][1] >= ENOUGH * rates[name][2]:
            return name
    for pool in (explicit, ["epoch_seconds", "epoch_milliseconds"]):
        best = max(pool, key=lambda n: (rates[n][1], -rates[n][0]))
        if rates[best][1]:
            return best
    return None


def parse_datetime(df: DataFrame, column: str, into: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or infer_format(df, column)
    value = candidate_formats()[fmt](F.col(column)) if fmt else F.lit(None).cast("timestamp")
    return df.withColumn(into, value)


def parse_report(df: DataFrame, column: str, parsed_column: str) -> DataFrame:
    """One row: values, parsed, success_pct, earliest, latest."""
    n, ok = F.count(column), F.count(parsed_column)
    return df.agg(
        n.alias("n_values"), ok.alias("n_parsed"), F.round(F.when(n > 0, 100 * ok / n).otherwise(0.0), 6).alias("success_pct"),
        F.min(parsed_column).alias("earliest"), F.max(parsed_column).alias("latest"),
    )


def unparsed_examples(df: DataFrame, column: str, parsed_column: str, most: int = 20) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & F.col(parsed_column).isNull()).select(column).distinct().orderBy(column).limit(most)


# Parts of column names that tell what a column holds.
DATETIME_NAMES = ("time", "date", "timestamp", "failure_date", "fail_time", "fail_date", "event_time", "event_date")
ID_NAMES = ("disk_id", "diskid", "serial", "serial_number", "serialnumber", "device_id", "deviceid", "id")


def detect_id_column(columns: Sequence[str]) -> str | None:
    """The first column whose name, in lower case, has a part that says identifier."""
    return next((c for c in columns if any(w in c.lower() for w in ID_NAMES)), None)


def detect_datetime_column(df: DataFrame, rows: int = 100, rate: float = 0.5) -> str | None:
    """The column of failure days: "failure_time", else the first that is named as one and has values, else the first that parses.

    It parses if it is a date or more than ``rate`` of its first ``rows`` texts are in a known pattern.
    """
    if "failure_time" in df.columns:
        return "failure_time"
    known = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    held = [c for i, c in enumerate(df.columns) if known[i]]
    named = [c for c in held if any(w in c.lower() for w in DATETIME_NAMES)]
    if named:
        return named[0]
    kinds = dict(df.dtypes)
    for c in held:
        if kinds[c] in ("date", "timestamp", "timestamp_ntz"):
            return c
        if kinds[c] == "string":
            sample = df.select(F.col(c).alias("c")).dropna().limit(rows)
            share = sample.agg(F.avg(F.when(F.coalesce(*[f(F.col("c")) for f in candidate_formats().values()]).isNotNull(), 1.0).otherwise(0.0))).first()[0]
            if share > rate:
                return c
    return None


def first_failure(failures: DataFrame, entity: Sequence[str], when: str, order: Sequence[str] = ()) -> DataFrame:
    """One row for each entity: its earliest failure, nulls last, then ``order``."""
    w = W.partitionBy(*entity).orderBy(F.col(when).asc_nulls_last(), *order)
    return failures.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def label_conflicts(failures: DataFrame, entity: Sequence[str], when: str) -> DataFrame:
    """One row: rows in groups of several, such entities, and those with different known times."""
    by = failures.groupBy(*entity).agg(F.count("*").alias("c"), F.count_distinct(when).alias("times"))
    return by.agg(
        F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("dup_rows"),
        F.count_if(F.col("c") > 1).alias("dup_entities"), F.count_if(F.col("times") > 1).alias("conflict_entities"),
    )


def label_horizons(telemetry: DataFrame, failures: DataFrame, on: Sequence[str], day: str, failure_day: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Left join of the first failure; rows after it go, and y_<h> is 1 up to h days before it.

    Adds days_to_failure (null where none is known: kept, all labels 0). ``failures`` has a row an
    entity; Spark broadcasts it where its measured size allows.
    """
    joined = telemetry.join(failures.select(*on, failure_day), list(on), "left")
    gap = joined.withColumn("days_to_failure", days_between(F.col(failure_day), F.col(day)))
    kept = gap.filter(F.col("days_to_failure").isNull() | (F.col("days_to_failure") >= 0))
    return kept.select("*", *[horizon_label(F.col("days_to_failure"), h).alias(f"y_{h}") for h in horizons])


def label_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, pos, neg, total) in one pass."""
    one = df.agg(*[x for c in labels for x in (F.count_if(F.col(c) == 1).alias(f"{c}__p"), F.count_if(F.col(c) == 0).alias(f"{c}__n"), F.count(c).alias(f"{c}__t"))])
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"{c}__p").alias("pos"), F.col(f"{c}__n").alias("neg"), F.col(f"{c}__t").alias("total")) for c in labels])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def label_accounting(telemetry: DataFrame, failures: DataFrame, on: Sequence[str], day: str, failure_day: str) -> DataFrame:
    """One row: input, dropped for a missing key, for a missing day, after failure; output; with failure."""
    joined = telemetry.join(failures.select(*on, failure_day), list(on), "left")
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    no_day = ~no_key & F.col(day).isNull()
    late = ~no_key & ~no_day & (days_between(F.col(failure_day), F.col(day)) < 0)
    late = F.coalesce(late, F.lit(False))
    out = ~no_key & ~no_day & ~late
    return joined.agg(
        F.count("*").alias("rows_in"), F.count_if(no_key).alias("dropped_no_key"), F.count_if(no_day).alias("dropped_no_day"), F.count_if(late).alias("dropped_after_failure"),
        F.count_if(out).alias("rows_out"), F.count_if(out & F.col(failure_day).isNotNull()).alias("rows_with_failure"),
    )


def split_identifiers(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is a whole number, as long; rows to look at). Nulls are in neither."""
    number: Column = F.col(column).try_cast("long")
    return df.withColumn(column, number).filter(F.col(column).isNotNull()), df.filter(F.col(column).isNotNull() & number.isNull())
