"""Named queries over the driver tables, each beside the SQL that it is held against.

Stand-ins: events are telemetry (user = device, event type = model, value = sensor reading) and
their errors of 150 and more are failures; orders are entities of customer and priority over years;
line items are a wide numeric profile; documents with labels are scored rows. Nulls, which these
tables lack, are put in by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import audit, cleaning, labels, metrics, models, ranking, sampling, splits, temporal
from tidemark.session import scratch_path
from tidemark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error' AND value >= 150")
    return e.select("event_id", "user_id", F.to_date("ts").alias("failure_day"))


def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.first_failure(failures(spark, sf_dir), ["user_id"], "failure_day", ["event_id"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user and day."""
    return telemetry(spark, sf_dir).groupBy("user_id", "day").agg(F.max("value").alias("r_1"), F.count("*").cast("double").alias("r_2"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sensors, with nulls and values outside their domains."""
    nth = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 11
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), F.when(nth != 0, F.col("l_quantity")).alias("r_qty"),
        F.when(nth == 3, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("r_price"),
        F.when(nth == 5, F.col("l_discount") * 100 + 95).otherwise(F.col("l_discount") * 100).alias("n_disc"),
        F.when(F.col("l_orderkey") % 200 == 0, F.col("l_tax")).alias("n_tax"), F.lit(1.0).alias("n_const"),
    )


LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, CASE WHEN nth <> 0 THEN l_quantity END AS r_qty,
         CASE WHEN nth = 3 THEN -l_extendedprice ELSE l_extendedprice END AS r_price,
         CASE WHEN nth = 5 THEN l_discount * 100 + 95 ELSE l_discount * 100 END AS n_disc,
         CASE WHEN l_orderkey % 200 = 0 THEN l_tax END AS n_tax, 1.0::DOUBLE AS n_const
  FROM (SELECT *, (l_orderkey * 7 + l_linenumber) % 11 AS nth FROM lineitem))"""
TELEMETRY = "telemetry AS (SELECT event_id, user_id, ts::DATE AS day, event_type, value FROM events)"
FAILURES = "failures AS (SELECT event_id, user_id, ts::DATE AS failure_day FROM events WHERE event_type = 'error' AND value >= 150)"
FIRST = "first AS (SELECT user_id, min(failure_day) AS failure_day FROM failures GROUP BY user_id)"
LABELLED = """gap AS (SELECT t.*, f.failure_day, f.failure_day - t.day AS d FROM telemetry t LEFT JOIN first f USING (user_id)),
labelled AS (SELECT *, CASE WHEN d BETWEEN 0 AND 7 THEN 1 ELSE 0 END AS y_7, CASE WHEN d BETWEEN 0 AND 14 THEN 1 ELSE 0 END AS y_14,
             CASE WHEN d BETWEEN 0 AND 30 THEN 1 ELSE 0 END AS y_30 FROM gap WHERE d IS NULL OR d >= 0)"""
BASE = f"WITH {TELEMETRY}, {FAILURES}, {FIRST}, {LABELLED}"
DAILY = "daily AS (SELECT user_id, ts::DATE AS day, max(value) AS r_1, count(*)::DOUBLE AS r_2 FROM events GROUP BY 1, 2)"
SCORED = "scored AS (SELECT d.doc_id, (d.n_chars % 97) / 96.0::DOUBLE AS score, l.toxic, l.quality, d.n_chars FROM documents d JOIN labels l USING (doc_id))"
HORIZONS = ["y_7", "y_14", "y_30"]
_JANUARY = {"train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-16", "2024-01-22"), "test": ("2024-01-23", "2024-01-31")}
FEATURES = ["r_qty", "r_price", "n_disc", "n_tax", "n_const"]
WINDOWS = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-06-30"), "test": ("1999-07-01", "1999-12-31")}
ENTITY = ["o_custkey", "o_orderpriority"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_horizons(telemetry(spark, sf_dir), first_failures(spark, sf_dir), ["user_id"], "day", "failure_day")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", ((F.col("n_chars") % 97) / F.lit(96.0)).alias("score"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


def per_column(columns: list[str], select: str, source: str) -> str:
    """SQL that repeats a select for each column: {c} stands for it."""
    return " UNION ALL ".join(select.replace("{c}", c) + f" FROM {source}" for c in columns)


# ---- failure labels


@query(f"{BASE} SELECT event_id, user_id, day, d::INTEGER AS days_to_failure, y_7, y_14, y_30 FROM labelled")
def horizon_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("event_id", "user_id", "day", "days_to_failure", *[F.col(y).cast("int").alias(y) for y in HORIZONS])


@query(f"WITH {FAILURES} SELECT user_id, event_id, failure_day FROM failures QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY failure_day NULLS LAST, event_id) = 1")
def label_dedup_first(spark, sf_dir):
    return first_failures(spark, sf_dir).select("user_id", "event_id", "failure_day")


@query(f"""WITH {FAILURES}, g AS (SELECT user_id, count(*) AS c, count(DISTINCT failure_day) AS t FROM failures GROUP BY 1)
SELECT coalesce(sum(CASE WHEN c > 1 THEN c END), 0)::BIGINT AS dup_rows, count(*) FILTER (c > 1) AS dup_entities, count(*) FILTER (t > 1) AS conflict_entities FROM g""")
def label_conflicts(spark, sf_dir):
    return labels.label_conflicts(failures(spark, sf_dir), ["user_id"], "failure_day")


@query(BASE + " " + per_column(HORIZONS, "SELECT '{c}' AS label, count(*) FILTER ({c} = 1) AS pos, count(*) FILTER ({c} = 0) AS neg, count({c}) AS total", "labelled"))
def label_distribution(spark, sf_dir):
    return labels.label_distribution(labelled(spark, sf_dir), HORIZONS)


@query(f"""{BASE} SELECT count(*) AS rows_in, count(*) FILTER (user_id IS NULL) AS dropped_no_key, count(*) FILTER (user_id IS NOT NULL AND day IS NULL) AS dropped_no_day, count(*) FILTER (d < 0) AS dropped_after_failure,
count(*) FILTER (d IS NULL OR d >= 0) AS rows_out, count(*) FILTER (d >= 0) AS rows_with_failure FROM gap""")
def label_accounting(spark, sf_dir):
    return labels.label_accounting(telemetry(spark, sf_dir), first_failures(spark, sf_dir), ["user_id"], "day", "failure_day")


@query(f"{BASE} SELECT (count(*) FILTER (y_7 = 1 AND y_14 = 0) + count(*) FILTER (y_14 = 1 AND y_30 = 0))::BIGINT AS violations FROM labelled")
def label_nesting(spark, sf_dir):
    return audit.nesting_violations(labelled(spark, sf_dir), HORIZONS)


def rendered_dates(spark, sf_dir):
    """Ship dates as text: most in one pattern, some in another, some no dates."""
    k = F.col("l_orderkey") % 10
    text = F.when(k == 0, F.lit("n/a")).when(k == 1, F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "lineitem").select(text.alias("t"))


RENDERED = """t AS (SELECT CASE l_orderkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN strftime(l_shipdate, '%Y/%m/%d') ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS t FROM lineitem)"""


@query(f"""WITH {RENDERED}, n AS (SELECT count(*) AS total, count(*) FILTER (t LIKE '____-__-__ __:__:__') AS a, count(*) FILTER (t LIKE '____/__/__') AS b FROM t)
SELECT 'yyyy-MM-dd HH:mm:ss' AS format, a AS parsed, total FROM n UNION ALL SELECT 'yyyy-MM-dd', 0, total FROM n UNION ALL SELECT 'yyyy/MM/dd HH:mm:ss', 0, total FROM n
UNION ALL SELECT 'yyyy/MM/dd', b, total FROM n UNION ALL SELECT 'yyyyMMdd', 0, total FROM n UNION ALL SELECT 'epoch_seconds', 0, total FROM n UNION ALL SELECT 'epoch_milliseconds', 0, total FROM n""")
def datetime_format_inference(spark, sf_dir):
    return labels.format_rates(rendered_dates(spark, sf_dir), "t").select("format", "parsed", "total")


@query(f"""WITH {RENDERED}, p AS (SELECT t, try_strptime(t, '%Y-%m-%d %H:%M:%S') AS w FROM t)
SELECT count(t) AS n_values, count(w) AS n_parsed, round(100.0::DOUBLE * count(w) / count(t), 6) AS success_pct, min(w) AS earliest, max(w) AS latest FROM p""")
def datetime_parse_report(spark, sf_dir):
    df = labels.parse_datetime(rendered_dates(spark, sf_dir), "t", "w")
    return labels.parse_report(df, "t", "w")


@query(f"WITH {RENDERED} SELECT DISTINCT t FROM t WHERE try_strptime(t, '%Y-%m-%d %H:%M:%S') IS NULL ORDER BY t LIMIT 20")
def unparsed_examples(spark, sf_dir):
    return labels.unparsed_examples(labels.parse_datetime(rendered_dates(spark, sf_dir), "t", "w"), "t", "w")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS day, (o_orderkey % 5)::BIGINT AS kind FROM orders""")
def padded_day_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", scalars.padded_day(raw).alias("day"), (F.col("o_orderkey") % 5).alias("kind"))


# ---- cleaning


@query("""SELECT user_id AS id, NULL::DOUBLE AS n_x, value AS r_v, event_type AS model FROM events UNION ALL SELECT o_custkey, o_totalprice / 10000, NULL, NULL FROM orders""")
def schema_union_canonical(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("value").alias("r_v"), F.col("event_type").alias("model"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") / 10000).alias("n_x"))
    return cleaning.canonical(cleaning.schema_union(a, b), ["id"])


RAW_TYPES = {"a": "double", "b": "int", "y": "label"}


def raw_text(spark, sf_dir):
    k = F.col("l_orderkey") % 9
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k == 0, F.lit("bad")).when(k == 1, F.lit(None)).otherwise(F.col("l_quantity").cast("string")).alias("a"),
        F.when(k == 2, F.lit("x1")).otherwise(F.col("l_suppkey").cast("string")).alias("b"),
        F.when(k == 3, F.lit("0.5")).when(k == 4, F.lit("2")).when(k == 5, F.lit("-1")).when(k == 6, F.lit("q")).when(k == 7, F.lit(None)).otherwise(F.lit("1")).alias("y"),
    )


RAW = """raw AS (SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'bad' WHEN 1 THEN NULL ELSE l_quantity::VARCHAR END AS a, CASE k WHEN 2 THEN 'x1' ELSE l_suppkey::VARCHAR END AS b,
CASE k WHEN 3 THEN '0.5' WHEN 4 THEN '2' WHEN 5 THEN '-1' WHEN 6 THEN 'q' WHEN 7 THEN NULL ELSE '1' END AS y FROM (SELECT *, l_orderkey % 9 AS k FROM lineitem))"""


@query(f"""WITH {RAW} SELECT l_orderkey, l_linenumber, try_cast(a AS DOUBLE) AS a, try_cast(b AS INTEGER) AS b,
coalesce(trunc(least(greatest(try_cast(y AS DOUBLE), 0), 1)), 0)::INTEGER AS y FROM raw""")
def type_coercion(spark, sf_dir):
    return cleaning.coerce(raw_text(spark, sf_dir), RAW_TYPES).withColumn("y", F.col("y").cast("int"))


@query(f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(try_cast({c} AS {t})) AS converted, count(*) FILTER ({c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL) AS to_null FROM raw" for c, t in (("a", "DOUBLE"), ("b", "INTEGER"), ("y", "DOUBLE"))))
def type_coercion_stats(spark, sf_dir):
    return cleaning.coercion_stats(raw_text(spark, sf_dir), RAW_TYPES)


@query("""SELECT event_id, user_id, event_type, ts::DATE AS day FROM events QUALIFY row_number() OVER (PARTITION BY month(ts), user_id, event_type, ts::DATE ORDER BY ts, event_id) = 1""")
def dedup_first_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("month", F.month("ts"))
    return cleaning.keep_first(e, ["user_id", "event_type", "day"], ["ts", "event_id"], within=["month"], unknown="event_type").select("event_id", "user_id", "event_type", "day")


@query(f"WITH {TELEMETRY} SELECT event_id FROM telemetry QUALIFY count(*) OVER (PARTITION BY user_id, event_type, day) > 1")
def dup_key_report(spark, sf_dir):
    return cleaning.duplicate_rows(telemetry(spark, sf_dir), ["user_id", "event_type", "day"]).select("event_id")


@query(f"""WITH {TELEMETRY}, m AS (SELECT event_type, user_id, day, count(*) AS n_rows FROM telemetry GROUP BY ALL HAVING count(*) > 1)
SELECT event_type, user_id, day, n_rows, row_number() OVER (PARTITION BY event_type ORDER BY user_id, day)::INTEGER AS nth FROM m QUALIFY nth <= 20""")
def dup_key_samples(spark, sf_dir):
    return cleaning.duplicate_key_samples(telemetry(spark, sf_dir), ["event_type", "user_id", "day"], ["event_type"])


@query(f"WITH {LINES}, one AS ({per_column(FEATURES, 'SELECT ' + chr(39) + '{c}' + chr(39) + ' AS feature, count({c})::DOUBLE / count(*) AS coverage, coalesce(min({c}) = max({c}), true) AS k', 'lines')}) "
       "SELECT feature, round(coverage, 6) AS coverage, CASE WHEN coverage < 0.01 THEN 'low_coverage' WHEN k THEN 'constant' ELSE 'keep' END AS decision FROM one")
def feature_coverage(spark, sf_dir):
    return cleaning.column_decisions(lines(spark, sf_dir), FEATURES).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, r_qty, r_price, n_disc FROM lines WHERE (r_qty IS NOT NULL)::INT + (r_price IS NOT NULL)::INT + (n_disc IS NOT NULL)::INT >= 3")
def constant_columns(spark, sf_dir):
    kept, _ = cleaning.drop_poor_columns(lines(spark, sf_dir), FEATURES)
    return cleaning.require_observed(kept, [c for c in FEATURES if c in kept.columns], 3).drop("day")


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, (n_tax IS NULL)::INTEGER AS miss_n_tax, (r_qty IS NULL)::INTEGER AS miss_r_qty FROM lines")
def missing_indicators(spark, sf_dir):
    out = cleaning.missing_indicators(lines(spark, sf_dir), ["r_qty", "r_price", "n_disc", "n_tax"], 2)
    return out.select("l_orderkey", "l_linenumber", F.col("miss_n_tax").cast("int").alias("miss_n_tax"), F.col("miss_r_qty").cast("int").alias("miss_r_qty"))


def dirty_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.when(k % 10 != 0, F.col("o_custkey")).alias("disk"), F.when(k % 6 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("model"),
        F.when(k % 15 != 0, F.to_date("o_orderdate")).alias("day"), F.when(k % 14 != 0, k).alias("ds"), F.when(k % 21 == 0, 2).otherwise(F.lit(1)).alias("y_7"), F.lit(1).alias("y_14"), F.when(k % 33 != 0, 0).alias("y_30"),
    )


DIRTY = """dirty AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS disk, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS model,
CASE WHEN o_orderkey % 15 <> 0 THEN o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 14 <> 0 THEN o_orderkey END AS ds, CASE WHEN o_orderkey % 21 = 0 THEN 2 ELSE 1 END AS y_7, 1 AS y_14,
CASE WHEN o_orderkey % 33 <> 0 THEN 0 END AS y_30 FROM orders),
judged AS (SELECT *, CASE WHEN disk IS NULL THEN 'disk' WHEN model IS NULL OR model = '' THEN 'model' WHEN day IS NULL THEN 'day' WHEN ds IS NULL THEN 'ds'
WHEN y_7 IS NULL OR y_7 NOT IN (0, 1) THEN 'y_7' WHEN y_14 NOT IN (0, 1) THEN 'y_14' WHEN y_30 IS NULL OR y_30 NOT IN (0, 1) THEN 'y_30' END AS reason FROM dirty)"""


@query(f"WITH {DIRTY} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n_rows FROM judged GROUP BY 1")
def reject_first_rule(spark, sf_dir):
    return cleaning.reject_counts(dirty_orders(spark, sf_dir), cleaning.validity_rules("disk", "model", "day", "ds"))


@query(f"WITH {DIRTY} SELECT reason, o_orderkey, row_number() OVER (PARTITION BY reason ORDER BY o_orderkey)::INTEGER AS nth FROM judged WHERE reason IS NOT NULL QUALIFY nth <= 5")
def reject_samples(spark, sf_dir):
    rules = cleaning.validity_rules("disk", "model", "day", "ds")
    return cleaning.reject_samples(dirty_orders(spark, sf_dir), rules, [], ["o_orderkey"]).select("reason", "o_orderkey", "nth")


@query(f"WITH {DIRTY} SELECT o_orderkey, disk, model, day FROM judged WHERE reason IS NULL")
def valid_rows(spark, sf_dir):
    return cleaning.keep_valid(dirty_orders(spark, sf_dir), cleaning.validity_rules("disk", "model", "day", "ds")).select("o_orderkey", "disk", "model", "day")


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, CASE WHEN r_qty >= 0 THEN r_qty END AS r_qty, CASE WHEN r_price >= 0 THEN r_price END AS r_price, CASE WHEN n_disc BETWEEN 0 AND 100 THEN round(n_disc, 6) END AS n_disc FROM lines")
def domain_nulling(spark, sf_dir):
    out = cleaning.null_out_of_domain(lines(spark, sf_dir), ["n_disc"], ["r_qty", "r_price"])
    return out.select("l_orderkey", "l_linenumber", "r_qty", "r_price", F.round("n_disc", 6).alias("n_disc"))


@query(f"WITH {LINES} SELECT 'n_disc' AS \"column\", count(*) FILTER (NOT n_disc BETWEEN 0 AND 100) AS nulled FROM lines UNION ALL SELECT 'r_qty', count(*) FILTER (r_qty < 0) FROM lines UNION ALL SELECT 'r_price', count(*) FILTER (r_price < 0) FROM lines")
def domain_nulling_counts(spark, sf_dir):
    return cleaning.domain_counts(lines(spark, sf_dir), ["n_disc"], ["r_qty", "r_price"])


@query("SELECT o_custkey AS id FROM orders WHERE o_orderkey % 4 <> 0")
def identifier_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("S"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    return labels.split_identifiers(o.select(ids.alias("id")), "id")[0]


# ---- audits


@query(f"WITH {LINES} " + per_column(FEATURES, "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_pct", "lines"))
def missingness_pct(spark, sf_dir):
    return audit.missingness(lines(spark, sf_dir), FEATURES)


@query(f"WITH {LINES}, per AS (SELECT month(day) AS f, " + ", ".join(f"100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS {c}" for c in FEATURES) + " FROM lines GROUP BY 1), "
       "one AS (" + per_column(FEATURES, "SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean_missing_pct", "per") + ") SELECT * FROM one ORDER BY 2 DESC, 1 LIMIT 3")
def mean_missing_by_file(spark, sf_dir):
    return audit.mean_missing_by_file(lines(spark, sf_dir).withColumn("f", F.month("day")), FEATURES, "f", 3)


@query(f"WITH {LINES} SELECT round(100.0::DOUBLE * (" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in FEATURES) + ") / (count(*) * 5), 6) AS missing_pct FROM lines")
def cell_missingness(spark, sf_dir):
    return audit.cell_missing_pct(lines(spark, sf_dir), FEATURES)


@query(f"WITH {LINES} " + per_column(["r_qty", "r_price", "n_disc"], "SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6) AS min_value, round(max({c}), 6) AS max_value, round(sum({c}), 2) AS sum_value, round(avg({c}), 6) AS mean_value", "lines"))
def numeric_profile(spark, sf_dir):
    return audit.numeric_profile(lines(spark, sf_dir), ["r_qty", "r_price", "n_disc"])


@query(f"WITH {LINES} " + per_column(["r_qty", "r_price", "n_disc"], "SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.01), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.99), 6) AS q99", "lines"))
def quantiles_linear(spark, sf_dir):
    return audit.quantiles_linear(lines(spark, sf_dir), ["r_qty", "r_price", "n_disc"])


@query(f"""WITH {LINES}, p AS (SELECT unnest([0.1, 1.0, 99.0, 99.9])::DOUBLE AS percent),
v AS (SELECT 'r_qty' AS "column", r_qty AS x FROM lines UNION ALL SELECT 'r_price', r_price FROM lines),
o AS (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY "column") AS n FROM v WHERE x IS NOT NULL)
SELECT "column", percent, round(x, 6) AS value FROM o JOIN p ON r = floor(percent / 100 * (n - 1))""")
def quantiles_lower(spark, sf_dir):
    return audit.quantiles_lower(lines(spark, sf_dir), ["r_qty", "r_price"])


_OUTLIERS = ["r_qty", "r_price"]


@query(f"""WITH {LINES}, v AS (SELECT 'r_qty' AS "column", r_qty AS x FROM lines UNION ALL SELECT 'r_price', r_price FROM lines),
o AS (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY "column") AS n FROM v WHERE x IS NOT NULL),
p AS (SELECT "column", max(x) FILTER (r = floor(1.0::DOUBLE / 100 * (n - 1))) AS p1, max(x) FILTER (r = floor(99.0::DOUBLE / 100 * (n - 1))) AS p99, max(x) FILTER (r = floor(99.9::DOUBLE / 100 * (n - 1))) AS p999 FROM o GROUP BY 1),
b AS (SELECT "column", count(*) AS n, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x < 0) AS negatives, count(*) FILTER (x > p999) AS extremes, avg(x) AS mean_value, stddev_pop(x) AS std_value,
min(x) AS lo, max(x) AS hi, any_value(p1) AS p1, any_value(p99) AS p99, any_value(p999) AS p999 FROM v JOIN p USING ("column") WHERE x IS NOT NULL GROUP BY 1)
SELECT "column", n, zeros, negatives, extremes, round(mean_value, 6) AS mean_value, round(std_value, 6) AS std_value, round(lo, 6) AS min_value, round(hi, 6) AS max_value, round(p1, 6) AS p1, round(p99, 6) AS p99, round(p999, 6) AS p999,
negatives > 0 AS flag_negative, p99 > 0 AND p999 / p99 > 10 AS flag_skew, p999 > 0 AND hi / p999 > 10 AS flag_tail,
round(CASE WHEN lo = hi THEN 0 WHEN lo <> 0 THEN (hi - lo) / abs(lo) ELSE abs(hi) END + CASE WHEN p1 > 0 THEN p999 / p1 ELSE 0 END + 100.0::DOUBLE * negatives / n, 6) AS score FROM b""")
def outlier_profile(spark, sf_dir):
    return audit.outlier_profile(lines(spark, sf_dir), _OUTLIERS)


@query(f"WITH {TELEMETRY}, g AS (SELECT count(*) AS c FROM telemetry GROUP BY user_id, event_type, day) SELECT sum(c)::BIGINT AS n_rows, count(*) AS n_keys, round(100.0::DOUBLE * (sum(c) - count(*)) / sum(c), 6) AS duplicate_pct FROM g")
def duplicate_rate(spark, sf_dir):
    return audit.duplicate_rate(telemetry(spark, sf_dir), ["user_id", "event_type", "day"])


@query("SELECT (sum(c) - count(*))::BIGINT AS n_duplicates FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type)")
def exact_duplicates(spark, sf_dir):
    return audit.exact_duplicates(table(spark, sf_dir, "events").select("user_id", "event_type"))


@query("SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT (user_id, event_type)) AS n_user_id_event_type FROM events")
def entity_distinct(spark, sf_dir):
    return audit.entity_counts(table(spark, sf_dir, "events"), [["user_id"], ["user_id", "event_type"]])


@query("SELECT min(ts::DATE) AS first_day, max(ts::DATE) AS last_day, count(DISTINCT ts::DATE) AS n_days FROM events")
def date_range(spark, sf_dir):
    return audit.date_range(telemetry(spark, sf_dir), "day")


@query("SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n_rows FROM orders GROUP BY ROLLUP (1, 2)")
def partition_row_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return audit.row_counts(o, ["year", "month"], rollup=True)


@query(f"""{BASE}, k AS (SELECT count(*) AS c FROM labelled GROUP BY user_id, event_type, day), n AS (
SELECT 'has_rows' AS criterion, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END::BIGINT AS n_bad FROM labelled UNION ALL SELECT 'keys_known', count(*) FILTER (user_id IS NULL OR day IS NULL) FROM labelled
UNION ALL SELECT 'model_known', count(*) FILTER (event_type IS NULL OR event_type = '') FROM labelled UNION ALL SELECT 'labels_binary', count(*) FILTER (y_7 NOT IN (0, 1) OR y_14 NOT IN (0, 1) OR y_30 NOT IN (0, 1)) FROM labelled
UNION ALL SELECT 'labels_nested', count(*) FILTER (y_7 = 1 AND y_14 = 0) + count(*) FILTER (y_14 = 1 AND y_30 = 0) FROM labelled UNION ALL SELECT 'normalised_range', count(*) FILTER (NOT value BETWEEN 0 AND 100) FROM labelled
UNION ALL SELECT 'raw_not_negative', count(*) FILTER (value < 0) FROM labelled UNION ALL SELECT 'keys_unique', (sum(c) - count(*))::BIGINT FROM k)
SELECT criterion, n_bad, n_bad = 0 AS passed FROM n UNION ALL SELECT 'overall', sum(n_bad)::BIGINT, sum(n_bad) = 0 FROM n""")
def integrity_checks(spark, sf_dir):
    return audit.integrity_checks(labelled(spark, sf_dir), ["user_id"], "day", "event_type", HORIZONS, ["value"], ["value"])


def _with_faults(spark, sf_dir):
    """Labelled events with a fault against each criterion, by rules on event_id and user_id."""
    k = F.col("event_id") % 100
    return labelled(spark, sf_dir).select(
        "event_id", "user_id", F.when(k != 7, F.col("event_type")).alias("event_type"), F.when(F.col("user_id") % 97 != 0, F.col("day")).alias("day"),
        F.when(k == 8, F.lit(2)).otherwise(F.col("y_7")).cast("byte").alias("y_7"), F.when(k == 9, F.lit(0)).otherwise(F.col("y_14")).cast("byte").alias("y_14"), F.col("y_30").cast("int").alias("y_30"),
        F.when(k < 3, F.col("value")).alias("r_rare"), (F.col("value") * 10).cast("long").alias("n_whole"),
    )


_SCHEMAS = [["event_id", "user_id", "day"], ["event_id", "user_id", "day"], ["user_id", "event_id", "day"], ["event_id", "day"]]
_CRITERIA = "SELECT criterion, n_bad, n_bad = 0 AS passed FROM n UNION ALL SELECT 'overall', sum(n_bad)::BIGINT, sum(n_bad) = 0 FROM n"


@query(f"""{BASE}, f AS (SELECT event_id, user_id, CASE WHEN event_id % 100 <> 7 THEN event_type END AS event_type, CASE WHEN user_id % 97 <> 0 THEN day END AS day,
CASE WHEN event_id % 100 = 8 THEN 2 ELSE y_7 END AS y_7, CASE WHEN event_id % 100 = 9 THEN 0 ELSE y_14 END AS y_14, y_30, CASE WHEN event_id % 100 < 3 THEN value END AS r_rare, value AS n_whole FROM labelled),
k AS (SELECT count(*) AS c FROM f WHERE event_type IS NOT NULL AND day IS NOT NULL GROUP BY user_id, event_type, day),
s AS (SELECT count(*) AS n, {", ".join(f"count({c}) AS {c}" for c in ("user_id", "event_type", "day", "y_7", "y_14", "y_30", "event_id", "r_rare", "n_whole"))},
{", ".join(f"count(*) FILTER ({y} IN (0, 1)) AS b{y}" for y in HORIZONS)}, count(*) FILTER (y_7 = 1 AND y_14 = 0 OR y_14 = 1 AND y_30 = 0) AS nested, min(day) AS lo, max(day) AS hi FROM f),
n AS (SELECT 'schema_consistency' AS criterion, 2 + 1::BIGINT AS n_bad UNION ALL SELECT 'type_consistency', 2 UNION ALL SELECT 'uniqueness', (sum(c) - count(*))::BIGINT FROM k
UNION ALL SELECT 'missingness', {" + ".join(f"({c} < n)::BIGINT" for c in ("user_id", "event_type", "day", "y_7", "y_14", "y_30"))} + {" + ".join(f"(100.0::DOUBLE * (n - {c}) / n >= 95)::BIGINT" for c in ("event_id", "r_rare", "n_whole"))} FROM s
UNION ALL SELECT 'label_distribution', {" + ".join(f"({y} = 0 OR b{y} <> {y})::BIGINT" for y in HORIZONS)} FROM s UNION ALL SELECT 'label_nesting', nested FROM s
UNION ALL SELECT 'date_coverage', (lo < DATE '2024-01-05')::BIGINT + (hi > DATE '2024-12-31')::BIGINT FROM s UNION ALL SELECT 'row_reconciliation', (SELECT count(*) FROM events) - n FROM s) {_CRITERIA}""")
def qa_acceptance(spark, sf_dir):
    required = ["user_id", "event_type", "day", *HORIZONS, "failure_day"]
    return audit.acceptance(
        _with_faults(spark, sf_dir), "user_id", "event_type", "day", HORIZONS, required, "2024-01-05", "2024-12-31", _SCHEMAS, table(spark, sf_dir, "events").count()
    )


@query(f"""{BASE}, f AS (SELECT user_id, 'm' AS event_type, day, max(y_7) AS y_7, max(y_14) AS y_14, max(y_30) AS y_30, max(value) AS r_value FROM labelled GROUP BY 1, 3),
n AS (SELECT 'schema_consistency' AS criterion, 0::BIGINT AS n_bad UNION ALL SELECT 'type_consistency', 0 UNION ALL SELECT 'uniqueness', count(*) - count(DISTINCT (user_id, day)) FROM f UNION ALL SELECT 'missingness', count(*) FILTER (r_value IS NULL) FROM f
UNION ALL SELECT 'label_distribution', count(*) FILTER (y_7 NOT IN (0, 1)) FROM f UNION ALL SELECT 'label_nesting', count(*) FILTER (y_7 = 1 AND y_14 = 0 OR y_14 = 1 AND y_30 = 0) FROM f
UNION ALL SELECT 'date_coverage', count(*) FILTER (day < DATE '2000-01-01') FROM f UNION ALL SELECT 'row_reconciliation', 0) {_CRITERIA}""")
def qa_acceptance_clean(spark, sf_dir):
    clean = labelled(spark, sf_dir).groupBy("user_id", F.lit("m").alias("event_type"), "day").agg(*[F.max(y).cast("byte").alias(y) for y in HORIZONS], F.max("value").alias("r_value"))
    return audit.acceptance(clean, "user_id", "event_type", "day", HORIZONS, (), "2000-01-01", "2100-01-01")


def _files(spark, sf_dir):
    """Files with columns and types of their own, written from the events of each type."""
    e, root = telemetry(spark, sf_dir), scratch_path(spark, "files")
    for name, columns in (("click", ["user_id", "day", "value"]), ("error", ["user_id", "day"]), ("purchase", ["user_id", "day", "cast(value as string) AS value"]), ("view", ["user_id", "day", "value"])):
        e.filter(F.col("event_type") == name).selectExpr(*columns).coalesce(1).write.parquet(f"{root}/{name}")
    return tables.file_schemas(spark, f"{root}/*/*.parquet")


@query("SELECT * FROM (VALUES ('day,user_id,value', 3::BIGINT, true), ('day,user_id', 1::BIGINT, false)) t(schema, n_files, is_mode)")
def schema_drift(spark, sf_dir):
    return audit.schema_drift(_files(spark, sf_dir).groupBy("file").agg(F.collect_list("column").alias("columns")))


@query("""SELECT 'value' AS "column", 'double,string' AS dtypes, 2::BIGINT AS n_types""")
def dtype_drift(spark, sf_dir):
    return audit.dtype_drift(_files(spark, sf_dir))


# ---- splits

SPLIT = "split AS (SELECT *, CASE WHEN d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN d BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' THEN 'val' WHEN d BETWEEN DATE '1999-07-01' AND DATE '1999-12-31' THEN 'test' END AS split FROM (SELECT *, o_orderdate::DATE AS d FROM orders))"
_ANTI = "o_orderkey, split FROM split s WHERE split = {0} AND NOT EXISTS (SELECT 1 FROM split e WHERE e.split IN ({1}) AND e.o_custkey = s.o_custkey AND e.o_orderpriority = s.o_orderpriority)"


@query(f"WITH {SPLIT} SELECT o_orderkey, split FROM split WHERE split IS NOT NULL")
def time_split(spark, sf_dir):
    return splits.time_split(table(spark, sf_dir, "orders"), "o_orderdate", WINDOWS).select("o_orderkey", "split")


def _tagged(spark, sf_dir, policy):
    parts = splits.disjoint_splits(table(spark, sf_dir, "orders"), "o_orderdate", WINDOWS, ENTITY, policy)
    out = None
    for n, f in parts.items():
        f = f.select("o_orderkey", F.lit(n).alias("split"))
        out = f if out is None else out.unionByName(f)
    return out


@query(f"""WITH {SPLIT} SELECT {_ANTI.format("'train'", "'val', 'test'")} UNION ALL SELECT o_orderkey, split FROM split WHERE split IN ('val', 'test')""")
def split_anti_train_eval(spark, sf_dir):
    return _tagged(spark, sf_dir, "train_eval")


@query(f"""WITH {SPLIT} SELECT {_ANTI.format("'train'", "'val', 'test'")} UNION ALL SELECT {_ANTI.format("'val'", "'test'")} UNION ALL SELECT o_orderkey, split FROM split WHERE split = 'test'""")
def split_anti_all(spark, sf_dir):
    return _tagged(spark, sf_dir, "all")


@query(f"""WITH {SPLIT}, o AS (SELECT {_ANTI.format("'train'", "'val', 'test'")} UNION ALL SELECT o_orderkey, split FROM split WHERE split IN ('val', 'test'))
SELECT s.split, count(*) AS rows_in_window, count(o.o_orderkey) AS rows_out, count(DISTINCT (o_custkey, o_orderpriority)) AS entities_in_window, count(DISTINCT CASE WHEN o.o_orderkey IS NOT NULL THEN (o_custkey, o_orderpriority) END) AS entities_out
FROM split s LEFT JOIN o ON s.o_orderkey = o.o_orderkey AND s.split = o.split WHERE s.split IS NOT NULL GROUP BY 1""")
def split_accounting(spark, sf_dir):
    return splits.split_accounting(table(spark, sf_dir, "orders"), "o_orderdate", WINDOWS, ENTITY)


# ---- temporal features

_W = "OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL {0} DAY PRECEDING AND {1})"
_TEMPORAL = f"""t AS (SELECT user_id, day, r_1, ln(1 + greatest(r_1, 0)) AS l FROM daily), lagged AS (
SELECT t.user_id, t.day, t.l, a.l AS l1, b.l AS l7 FROM t LEFT JOIN t a ON a.user_id = t.user_id AND a.day = t.day - 1 LEFT JOIN t b ON b.user_id = t.user_id AND b.day = t.day - 7)"""


def _log_daily(spark, sf_dir):
    return daily(spark, sf_dir).select("user_id", "day", scalars.log1p_clamped(F.col("r_1")).alias("l"))


@query(f"WITH {DAILY}, {_TEMPORAL} SELECT user_id, day, round(l - l1, 6) AS delta1, round(l - l7, 6) AS delta7 FROM lagged")
def delta_calendar(spark, sf_dir):
    w = temporal.history(["user_id"], "day")
    return _log_daily(spark, sf_dir).select("user_id", "day", *[F.round(temporal.delta(F.col("l"), w, k), 6).alias(f"delta{k}") for k in (1, 7)])


def _roll_sql(name: str, fn: str) -> str:
    return f"WITH {DAILY}, {_TEMPORAL} SELECT user_id, day, round({fn}(l) {_W.format(6, 'CURRENT ROW')}, 6) AS {name} FROM t"


@query(_roll_sql("rollmean7", "avg"))
def rolling_mean7(spark, sf_dir):
    return _log_daily(spark, sf_dir).select("user_id", "day", F.round(temporal.rolling(F.col("l"), temporal.history(["user_id"], "day"), 7, "mean"), 6).alias("rollmean7"))


@query(_roll_sql("rollstd7", "stddev_samp"))
def rolling_std7(spark, sf_dir):
    return _log_daily(spark, sf_dir).select("user_id", "day", F.round(temporal.rolling(F.col("l"), temporal.history(["user_id"], "day"), 7, "std"), 6).alias("rollstd7"))


@query(_roll_sql("rollvar7", "var_samp"))
def rolling_var7(spark, sf_dir):
    return _log_daily(spark, sf_dir).select("user_id", "day", F.round(temporal.rolling(F.col("l"), temporal.history(["user_id"], "day"), 7, "var"), 6).alias("rollvar7"))


@query(f"WITH {DAILY}, {_TEMPORAL} SELECT user_id, day, round(abs(l - l1), 6) AS instab FROM lagged")
def instability(spark, sf_dir):
    return _log_daily(spark, sf_dir).select("user_id", "day", F.round(F.abs(temporal.delta(F.col("l"), temporal.history(["user_id"], "day"), 1)), 6).alias("instab"))


@query(f"""WITH {TELEMETRY}, last AS (SELECT user_id, day, arg_max(value, event_id) AS v FROM telemetry GROUP BY 1, 2)
SELECT t.event_id, round(t.value - any_value(a.v) + 1e-7, 4) AS delta1_value, round(avg(x) + 1e-7, 4) AS rollmean7_value, round(var_samp(x) + 1e-6, 3) AS rollvar7_value FROM (
  SELECT t.event_id, t.user_id, t.day, t.value, unnest(list_append(coalesce((SELECT list(p.v) FROM last p WHERE p.user_id = t.user_id AND p.day BETWEEN t.day - 6 AND t.day - 1), []), t.value)) AS x FROM telemetry t) t
LEFT JOIN last a ON a.user_id = t.user_id AND a.day = t.day - 1 GROUP BY t.event_id, t.value""")
def temporal_dupday(spark, sf_dir):
    out = temporal.temporal_features_repeated_days(telemetry(spark, sf_dir), ["user_id"], "day", "value", ["event_id"])
    return out.select("event_id", *[F.round(F.col(c) + e, d).alias(c) for c, e, d in (("delta1_value", 1e-7, 4), ("rollmean7_value", 1e-7, 4), ("rollvar7_value", 1e-6, 3))])  # a nudge off exact halves


@query("SELECT user_id, min(ts::DATE) AS first_seen FROM events GROUP BY 1")
def first_seen(spark, sf_dir):
    return temporal.first_seen(telemetry(spark, sf_dir), ["user_id"], "day")


@query("SELECT user_id, least(min(ts::DATE) FILTER (day(ts) <= 15), min(ts::DATE) FILTER (day(ts) > 15)) AS first_seen FROM events GROUP BY 1")
def first_seen_merge(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    early, late = (temporal.first_seen(t.filter(c), ["user_id"], "day") for c in (F.dayofmonth("day") <= 15, F.dayofmonth("day") > 15))
    return temporal.merge_first_seen(early, late, ["user_id"])


@query(f"WITH {TELEMETRY}, s AS (SELECT user_id, min(day) AS f FROM telemetry WHERE day(day) > 10 GROUP BY 1) SELECT event_id, greatest(day - f, 0)::DOUBLE AS age_days FROM telemetry LEFT JOIN s USING (user_id)")
def age_days(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    seen = temporal.first_seen(t.filter(F.dayofmonth("day") > 10), ["user_id"], "day")
    return temporal.add_age(t, seen, ["user_id"], "day").select("event_id", "age_days")


@query("""WITH m AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS c FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))
SELECT event_id, coalesce(c, -1)::INTEGER AS model_code FROM events LEFT JOIN m USING (event_type)""")
def model_code(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return temporal.add_model_code(e, temporal.model_codes(e.filter("event_type <> 'error'"), "event_type"), "event_type").select("event_id", "model_code")


_PAST = "OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL {0} DAYS PRECEDING AND {1})"
_EACH = ", ".join(
    f"round({x}, 6) AS {n}_log1p_{c}" for c in ("r_1", "r_2") for n, x in (
        ("delta1", f"l_{c} - first_value(l_{c}) {_PAST.format(1, 'INTERVAL 1 DAYS PRECEDING')}"), ("delta7", f"l_{c} - first_value(l_{c}) {_PAST.format(7, 'INTERVAL 7 DAYS PRECEDING')}"),
        ("instab", f"abs(l_{c} - first_value(l_{c}) {_PAST.format(1, 'INTERVAL 1 DAYS PRECEDING')})"), ("rollmean7", f"avg(l_{c}) {_PAST.format(6, 'CURRENT ROW')}"), ("rollstd7", f"stddev_samp(l_{c}) {_PAST.format(6, 'CURRENT ROW')}"),
    )
)


@query(f"""WITH {DAILY}, t AS (SELECT *, ln(1 + greatest(r_1, 0)) AS l_r_1, ln(1 + greatest(r_2, 0)) AS l_r_2, min(day) OVER (PARTITION BY user_id) AS seen FROM daily)
SELECT user_id, day, round(r_1, 6) AS r_1, r_2, 'm' AS model, (day - seen)::DOUBLE AS age_days, round(l_r_1, 6) AS log1p_r_1, round(l_r_2, 6) AS log1p_r_2, {_EACH}, 0::INTEGER AS model_code FROM t""")
def engineered(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("model", F.lit("m"))
    out = temporal.engineer(d, d, ["user_id"], "day", "model", ["r_1", "r_2"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(f"WITH {DAILY}, t AS (SELECT user_id % 3 AS part, (day - min(day) OVER (PARTITION BY user_id))::DOUBLE AS age FROM daily) SELECT part::INTEGER AS part, min(age) AS min_age, max(age) AS max_age, round(avg(age), 6) AS mean_age FROM t GROUP BY 1")
def age_summary(spark, sf_dir):
    d = daily(spark, sf_dir)
    aged = temporal.add_age(d, temporal.first_seen(d, ["user_id"], "day"), ["user_id"], "day")
    return temporal.age_summary(aged.withColumn("part", (F.col("user_id") % 3).cast("int")), ["part"])


@query("""SELECT * FROM (VALUES ('rows_kept', true), ('keys_present', true), ('age_not_negative', true), ('log1p_finite', true), ('family_delta', true), ('family_rollmean', true), ('family_rollvar', false)) t("check", ok)""")
def smoke_checks(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("model", F.lit("m"))
    out = temporal.engineer(d, d, ["user_id"], "day", "model", ["r_1", "r_2"])
    return audit.smoke_checks(out, d.count(), ["user_id", "day"], {"delta": "delta1_", "rollmean": "rollmean7_", "rollvar": "rollvar7_"})


@query(f"""WITH {TELEMETRY}, {FAILURES}, {FIRST}, {LABELLED}, s AS (SELECT *, CASE WHEN day <= DATE '2024-01-15' THEN 'train' WHEN day <= DATE '2024-01-22' THEN 'val' ELSE 'test' END AS split FROM labelled WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31')
SELECT split, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (y_7 = 1) AS y_7_pos, count(*) FILTER (y_14 = 1) AS y_14_pos, count(*) FILTER (y_30 = 1) AS y_30_pos FROM s GROUP BY 1""")
def split_label_stats(spark, sf_dir):
    return splits.split_labels(splits.disjoint_splits(labelled(spark, sf_dir), "day", _JANUARY, ["event_id"], "none"), HORIZONS, "day")


@query(f"WITH {LINES} SELECT l_orderkey, r_qty, r_price, n_disc, n_tax, n_const, l_linenumber, day FROM lines")
def select_columns(spark, sf_dir):
    return cleaning.select_columns(lines(spark, sf_dir), ["l_orderkey", "absent"], keep_extra=True)


# ---- ranking

_HIST = f"""{SCORED}, pairs AS (SELECT 'n_chars' AS feature, n_chars::DOUBLE AS x, toxic AS y FROM scored UNION ALL SELECT 'quality', quality::DOUBLE, toxic FROM scored UNION ALL SELECT 'score', score, toxic FROM scored),
lim AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM pairs GROUP BY 1 HAVING min(x) < max(x)),
hist AS (SELECT p.feature, least(floor((x - lo) * 256 / (hi - lo)), 255)::INTEGER AS bin, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM pairs p JOIN lim USING (feature) GROUP BY ALL)"""
_RANKED = ["n_chars", "quality", "score"]


@query(f"WITH {_HIST} SELECT * FROM hist")
def hist_label_conditional(spark, sf_dir):
    return ranking.label_histogram(scored(spark, sf_dir), _RANKED, "toxic", least=50)


@query(f"""WITH {_HIST}, a AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY feature ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM hist),
s AS (SELECT feature, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, sum(neg * (above + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM a GROUP BY 1),
r AS (SELECT *, abs(auc - 0.5) AS apart FROM s)
SELECT row_number() OVER (ORDER BY apart DESC, feature)::INTEGER AS rank, feature, round(auc, 6) AS auc, round(apart, 6) AS abs_auc_minus_0_5, n_pos, n_neg FROM r""")
def hist_auc_rank(spark, sf_dir):
    return ranking.rank_features(scored(spark, sf_dir), _RANKED, "toxic", least=50)


# ---- sampling

_DRAW = "md5(event_id || '|42')"
_Y = "(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)"


def flagged(spark, sf_dir):
    return telemetry(spark, sf_dir).withColumn("y", F.when(F.col("event_type") == "error", 1).otherwise(0))


@query("SELECT event_id, ts::DATE AS day FROM events ORDER BY ts::DATE, event_id LIMIT 1000")
def cap_chronological(spark, sf_dir):
    return sampling.chronological_cap(telemetry(spark, sf_dir), ["day", "event_id"], 1000).select("event_id", "day")


@query("""WITH c AS (SELECT ts::DATE AS day, count(*) AS c FROM events GROUP BY 1), b AS (SELECT day, coalesce(sum(c) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT event_id FROM events WHERE ts::DATE IN (SELECT day FROM b WHERE before < 1500)""")
def pool_prefix(spark, sf_dir):
    return sampling.partition_pool(telemetry(spark, sf_dir), ["day"], 1500).select("event_id")


@query(f"""WITH t AS (SELECT event_id, {_Y} AS y FROM events), n AS (SELECT greatest(4000 - sum(y), 0)::BIGINT AS room FROM t), neg AS (SELECT event_id, y, row_number() OVER (ORDER BY {_DRAW}, event_id) AS r FROM t WHERE y = 0)
SELECT event_id, y FROM t WHERE y = 1 AND (SELECT sum(y) FROM t) < 4000 UNION ALL SELECT event_id, y FROM neg, n WHERE r <= room
UNION ALL SELECT event_id, y FROM (SELECT event_id, y, row_number() OVER (ORDER BY {_DRAW}, event_id) AS r FROM t WHERE y = 1) WHERE r <= 4000 AND (SELECT sum(y) FROM t) >= 4000""")
def cap_keep_positives(spark, sf_dir):
    return sampling.cap_keep_positives(flagged(spark, sf_dir), "y", ["event_id"], 4000).select("event_id", "y")


@query(f"""WITH t AS (SELECT event_id, {_Y} AS y FROM events), neg AS (SELECT event_id, y, row_number() OVER (ORDER BY {_DRAW}, event_id) AS r FROM t WHERE y = 0)
SELECT event_id, y FROM t WHERE y = 1 UNION ALL SELECT event_id, y FROM neg WHERE r <= 2 * (SELECT sum(y) FROM t)""")
def neg_downsample(spark, sf_dir):
    return sampling.downsample_negatives(flagged(spark, sf_dir), "y", ["event_id"], 2).select("event_id", "y")


# ---- metrics

_M = f"WITH {SCORED}"
_CONF = "count(*) FILTER (NOT h AND NOT p) AS tn, count(*) FILTER (h AND NOT p) AS fp, count(*) FILTER (NOT h AND p) AS fn, count(*) FILTER (h AND p) AS tp"
_PRF = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query(f"{_M}, c AS (SELECT {_CONF} FROM (SELECT score >= 0.4 AS h, toxic = 1 AS p FROM scored)) SELECT 0.4::DOUBLE AS threshold, tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, {_PRF} FROM c")
def confusion_metrics(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), "score", "toxic", 0.4)


@query(f"""{_M}, s AS (SELECT score, count(*) FILTER (toxic = 1) AS pos, count(*) AS n FROM scored GROUP BY 1), r AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM s WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos::DOUBLE * tp / k) / sum(pos), 6) AS average_precision FROM r""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir), "score", "toxic")


@query(f"""{_M} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS roc_auc
FROM (SELECT score FROM scored WHERE toxic = 1) p, (SELECT score FROM scored WHERE toxic <> 1) n""")
def roc_auc_exact(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir), "score", "toxic")


_SCAN = f"g AS (SELECT round(0.01 + i * 0.01, 10)::DOUBLE AS threshold FROM range(99) t(i)), c AS (SELECT threshold, {_CONF} FROM (SELECT threshold, score >= threshold AS h, toxic = 1 AS p FROM scored, g) GROUP BY 1)"


@query(f"{_M}, {_SCAN} SELECT threshold, tp, fp, fn, tn, {_PRF} FROM c")
def threshold_scan(spark, sf_dir):
    return metrics.threshold_scan(scored(spark, sf_dir), "score", "toxic")


@query(f"{_M}, {_SCAN}, f AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c) SELECT threshold, round(f1, 6) AS best_f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(metrics.threshold_scan(scored(spark, sf_dir), "score", "toxic"))


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic <> 1) AS n_neg FROM documents JOIN labels USING (doc_id))
SELECT n_pos, n_neg, round((n_pos + n_neg)::DOUBLE / (2 * n_pos), 6) AS w_pos, round((n_pos + n_neg)::DOUBLE / (2 * n_neg), 6) AS w_neg, round(n_neg::DOUBLE / n_pos, 6) AS pos_weight FROM c""")
def class_weights(spark, sf_dir):
    return metrics.class_weights(scored(spark, sf_dir), "toxic")


@query(f"""WITH {LINES}, m AS (SELECT median(r_qty) AS q, median(n_disc) AS d FROM lines), f AS (SELECT l_orderkey, l_linenumber, coalesce(r_qty, q) AS q, coalesce(n_disc, d) AS d FROM lines, m),
s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(d) AS md, stddev_pop(d) AS sd FROM f)
SELECT l_orderkey, l_linenumber, round((q - mq) / sq, 6) AS r_qty, round((d - md) / sd, 6) AS n_disc FROM f, s""")
def median_impute_scale(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "r_qty", "n_disc")
    out = models.fit_preprocess(df, ["r_qty", "n_disc"]).apply(df)
    return out.select("l_orderkey", "l_linenumber", F.round("r_qty", 6).alias("r_qty"), F.round("n_disc", 6).alias("n_disc"))


# ---- models (no SQL can express them)


def _model_parts(spark, sf_dir):
    d = labelled(spark, sf_dir).select("event_id", "day", "value", F.dayofweek("day").cast("double").alias("dow"), F.length("event_type").cast("double").alias("kind"), "y_14")
    return splits.disjoint_splits(d, "day", _JANUARY, ["event_id"], "none")


def _run(spark, sf_dir, config):
    return models.train_and_evaluate(_model_parts(spark, sf_dir), ["value", "dow", "kind"], ["event_id"], config)


@query()
def lr_train_eval(spark, sf_dir):
    return _run(spark, sf_dir, models.Config("y_14", "lr", balanced=True))


@query()
def rf_train_eval(spark, sf_dir):
    return _run(spark, sf_dir, models.Config("y_14", "rf", negative_ratio=2))


@query()
def gbt_train_eval(spark, sf_dir):
    return _run(spark, sf_dir, models.Config("y_14", "gbt"))


@query(f"""{BASE}, s AS (SELECT CASE WHEN day <= DATE '2024-01-22' THEN 'val' ELSE 'test' END AS split, y_14 FROM labelled WHERE day BETWEEN DATE '2024-01-16' AND DATE '2024-01-31'),
c AS (SELECT split, count(*) FILTER (y_14 = 0) AS tn, count(*) FILTER (y_14 = 1) AS fn FROM s GROUP BY 1)
SELECT 'never_y_14' AS experiment, split, 0.5::DOUBLE AS threshold, tn, 0::BIGINT AS fp, fn, 0::BIGINT AS tp, round(tn::DOUBLE / (tn + fn), 6) AS accuracy, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1,
round(fn::DOUBLE / (tn + fn), 6) AS average_precision, CASE WHEN tn > 0 AND fn > 0 THEN 0.5 ELSE 0 END::DOUBLE AS roc_auc, 0.0::DOUBLE AS train_missing_pct FROM c""")
def never_train_eval(spark, sf_dir):
    return _run(spark, sf_dir, models.Config("y_14", "never"))
