"""One hand-written fixture for each case that is easy to get wrong."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import audit, cleaning, labels, metrics, ranking, ranks, sampling, splits, temporal
from tidemark.sources import tables

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def feature(spark, days, config):
    df = spark.createDataFrame([(1, DAY(d), v) for d, v in days], "disk long, day date, v double")
    return temporal.temporal_features(df, ["disk"], "day", ["v"], config)


def test_calendar_gap(spark):
    out = feature(spark, [(1, 1.0), (2, 2.0), (4, 4.0), (9, 9.0), (11, 11.0)], {"delta": (1, 7), "rollmean": 7})
    assert rows(out.select("v", "delta1_v", "delta7_v", "rollmean7_v"), "v") == [(1.0, None, None, 1.0), (2.0, 1.0, None, 1.5), (4.0, None, None, 7 / 3), (9.0, None, 7.0, 6.5), (11.0, None, 7.0, 10.0)]


def test_single_observation_and_nulls_in_window(spark):
    one = feature(spark, [(1, 5.0)], temporal.DEFAULT)
    assert rows(one.select("rollmean7_v", "rollstd7_v", "instab_v")) == [(5.0, None, None)]
    gap = feature(spark, [(1, 1.0), (2, None), (3, 3.0)], {"delta": (1,), "rollmean": 7, "rollstd": 7})
    assert rows(gap.select("delta1_v", "rollmean7_v"), F.col("day")) == [(None, 1.0), (None, 1.0), (None, 2.0)]


def test_log1p_of_odd_values(spark):
    df = spark.createDataFrame([(1, -3.0), (2, float("nan")), (3, float("inf")), (4, None)], "i int, v double")
    assert rows(df.select("i", scalars.log1p_clamped(F.col("v"))), "i") == [(1, 0.0), (2, None), (3, None), (4, None)]


def test_repeated_day_takes_last_write(spark):
    df = spark.createDataFrame([(1, "A", DAY(1), 1.0), (1, "B", DAY(1), 10.0), (1, "A", DAY(2), 12.0)], "disk long, model string, day date, v double")
    out = temporal.temporal_features_repeated_days(df, ["disk"], "day", "v", ["model"])
    assert rows(out.select("model", "day", "delta1_v", "rollmean7_v"), "day", "model")[-1] == ("A", DAY(2), 2.0, 11.0)


def test_label_edges(spark):
    gaps = [-1, 0, 7, 8, 14, 15, 30, 31]
    seen = spark.createDataFrame([(i, DAY(1)) for i in range(len(gaps) + 1)], "disk long, day date")
    fail = spark.createDataFrame([(i, DAY(1) + dt.timedelta(days=g)) for i, g in enumerate(gaps)], "disk long, failed date")
    out = labels.label_horizons(seen, fail, ["disk"], "day", "failed")
    assert rows(out.select("days_to_failure", "y_7", "y_14", "y_30"), "disk") == [(0, 1, 1, 1), (7, 1, 1, 1), (8, 0, 1, 1), (14, 0, 1, 1), (15, 0, 0, 1), (30, 0, 0, 1), (31, 0, 0, 0), (None, 0, 0, 0)]


def test_failure_duplicates(spark):
    df = spark.createDataFrame([(1, DAY(5)), (1, DAY(2)), (1, None), (2, DAY(3)), (2, DAY(3))], "disk long, failed date")
    assert rows(labels.first_failure(df, ["disk"], "failed"), "disk") == [(1, DAY(2)), (2, DAY(3))]
    assert rows(labels.label_conflicts(df, ["disk"], "failed")) == [(5, 2, 1)]


def test_days_as_text(spark):
    df = spark.createDataFrame([(1, "20180101"), (2, "2018011"), (3, "abc"), (4, None), (5, "201801011")], "i int, d string")
    assert rows(df.select(scalars.padded_day(F.col("d"))), "i") == [(dt.date(2018, 1, 1),), (None,), (None,), (None,), (None,)]


@pytest.mark.parametrize("text,fmt", [("2020-01-02 03:04:05", "yyyy-MM-dd HH:mm:ss"), ("2020-01-02", "yyyy-MM-dd"), ("2020/01/02", "yyyy/MM/dd"), ("20200102", "yyyyMMdd"), ("1577934245", "epoch_seconds"), ("1577934245000", "epoch_milliseconds")])
def test_one_format_for_a_column(spark, text, fmt):
    df = spark.createDataFrame([(text,)] * 19 + [("?",)], "t string")
    assert labels.infer_format(df, "t") == fmt


def test_label_coercion(spark):
    df = spark.createDataFrame([(1, "x"), (2, "-1"), (3, "0.5"), (4, "2"), (5, None)], "i int, y string")
    assert [r[1] for r in rows(cleaning.coerce(df, {"y": "label"}), "i")] == [0, 0, 0, 1, 0]


def test_domains(spark):
    df = spark.createDataFrame([(-1.0, -1.0), (0.0, 0.0), (100.0, None), (101.0, None)], "n_a double, r_a double")
    assert rows(cleaning.null_out_of_domain(df, ["n_a"], ["r_a"])) == [(None, None), (0.0, 0.0), (100.0, None), (None, None)]
    assert rows(cleaning.domain_counts(df, ["n_a"], ["r_a"])) == [("n_a", 2), ("r_a", 1)]


def test_first_rule_and_models(spark):
    df = spark.createDataFrame([(None, None, None, None, 5, 5, 5), (1, "", DAY(1), 1, 0, 0, 0), (1, "A", DAY(1), 1, 0, 0, 0)], "disk long, model string, day date, ds int, y_7 int, y_14 int, y_30 int")
    assert dict(rows(cleaning.reject_counts(df, cleaning.validity_rules("disk", "model", "day", "ds")))) == {"disk": 1, "model": 1, "ok": 1}


def test_dedup_order_and_unknown_model(spark):
    df = spark.createDataFrame([(1, None, DAY(1), "b", 0), (1, "UNKNOWN", DAY(1), "a", 1), (2, "m", DAY(1), "a", 0), (None, "m", DAY(1), "a", 2)], "disk long, model string, day date, file string, row int")
    out = cleaning.keep_first(df, ["disk", "model", "day"], ["file", "row"])
    assert rows(out.select("disk", "file"), "disk") == [(1, "a"), (2, "a")]
    assert cleaning.keep_first(out, ["disk", "model", "day"], ["file", "row"]).count() == 2


def test_coverage_edges(spark):
    df = spark.range(1000).select(*[F.when(F.col("id") < n, F.col("id").cast("double")).alias(c) for c, n in (("edge", 10), ("below", 9), ("full", 1000), ("none", 0))], F.lit(1.0).alias("flat"))
    assert dict(rows(cleaning.column_decisions(df, df.columns).select("feature", "decision"))) == {"edge": "keep", "below": "low_coverage", "full": "keep", "none": "low_coverage", "flat": "constant"}


def test_anti_join_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (1, "A")], "disk long, model string")
    assert rows(splits.without_entities(df, spark.createDataFrame([(1, "A")], df.schema), ["disk", "model"])) == [(1, None)]


def test_split_edges(spark):
    df = spark.createDataFrame([(d,) for d in ("2018-12-31 23:59:59", "2019-01-01 00:00:00", "2019-06-30 23:59:59", "2019-07-01 00:00:00", "2020-01-01 00:00:00")], "t string").select(F.col("t").cast("timestamp").alias("t"))
    win = {"train": ("2018-01-01", "2018-12-31"), "val": ("2019-01-01", "2019-06-30"), "test": ("2019-07-01", "2019-12-31")}
    assert [r[1] for r in rows(splits.time_split(df, "t", win), "t")] == ["train", "val", "val", "test"]


def test_unseen_models(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "m string")
    other = spark.createDataFrame([("a",), ("z",), (None,)], "m string")
    assert {r[0]: r[1] for r in rows(temporal.add_model_code(other, temporal.model_codes(train, "m"), "m"))} == {"a": 0, "z": -1, None: -1}


def test_metric_edges(spark):
    tie = spark.createDataFrame([(0.5, 1), (0.5, 0)], "s double, y int")
    assert rows(metrics.roc_auc(tie, "s", "y")) == [(0.5,)]
    zero = spark.createDataFrame([(0.0, 1), (0.0, 0)], "s double, y int")
    assert rows(metrics.best_threshold(metrics.threshold_scan(zero, "s", "y"))) == [(0.5, 0.0)]
    same = spark.createDataFrame([(0.9, 1), (0.001, 0)], "s double, y int")
    assert rows(metrics.best_threshold(metrics.threshold_scan(same, "s", "y"))) == [(0.01, 1.0)]
    one = ranking.auc_of_bins(spark.createDataFrame([(1, 1, 5, 0)], "g int, b int, pos int, neg int"), ["g"], "b")
    assert one.first()["auc"] == 0.5


def test_greatest_value_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(11)], "x double, y int")
    assert ranking.label_histogram(df, ["x"], "y", 5, 1).agg(F.max("bin")).first()[0] == 4


def test_pool_and_caps(spark):
    df = spark.createDataFrame([(p, i, int(i == 0)) for p, n in ((1, 3), (2, 4), (3, 5)) for i in range(n)], "p int, i int, y int")
    pool = sampling.partition_pool(df, ["p"], 6)
    assert pool.count() == 7
    capped = sampling.cap_keep_positives(pool, "y", ["p", "i"], 6)
    assert capped.count() == 6 and capped.filter("y = 1").count() == 2
    assert sampling.downsample_negatives(df.filter("y = 0"), "y", ["p", "i"], 1).count() == 9
    assert sampling.downsample_negatives(df, "y", ["p", "i"], 9).count() == 12
    assert sampling.downsample_negatives(df, "y", ["p", "i"], 2).count() == 9


def test_nesting(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (1, 0, 1)], "y_7 int, y_14 int, y_30 int")
    assert rows(audit.nesting_violations(df, ["y_7", "y_14", "y_30"])) == [(3,)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=2, max_size=25))
def test_auc_is_mann_whitney(spark, pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    got = metrics.roc_auc(spark.createDataFrame([(float(s), y) for s, y in pairs], "s double, y int"), "s", "y").first()[0]
    want = 0.0 if not pos or not neg else sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(got, want, abs_tol=1e-6)


def test_past_only(spark):
    days = [(d, float(d * d)) for d in (1, 2, 5, 8, 9)]
    before = rows(feature(spark, days[:-1], temporal.DEFAULT), "day")
    assert rows(feature(spark, days, temporal.DEFAULT), "day")[:-1] == before


def test_months_are_replaced_not_appended(spark, tmp_path):
    df = spark.createDataFrame([(1, DAY(1)), (2, DAY(40))], "i int, day date")
    for _ in range(2):
        tables.write_months(df, f"{tmp_path}/t", "day", overwrite=True)
    assert tables.read_months(spark, f"{tmp_path}/t").count() == 2
    assert tables.read_months(spark, f"{tmp_path}/t", 1).count() == 1
    with pytest.raises(FileExistsError):
        tables.write_months(df, f"{tmp_path}/t", "day")


def test_csv_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,r_1\n1,2\n")
    (tmp_path / "b.csv").write_text("r_2,id\nx,7\n")
    out = tables.read_csv_text(spark, f"{tmp_path}/*.csv")
    assert rows(out.select("id", "r_1", "r_2"), "id") == [("1", "2", None), ("7", None, "x")]


def test_config_and_maps(spark, tmp_path):
    text = "features:\n  - a\n  - b # note\ncaps:\n  train: 5\n  names: [x, y]\n"
    assert tables.load_config(text) == {"features": ["a", "b"], "caps": {"train": 5, "names": ["x", "y"]}}
    assert tables.known_features(tables.load_config(text), ["b", "z"]) == ["b"]
    tables.save_map(spark.createDataFrame([("a", 1)], "k string, v int"), f"{tmp_path}/m")
    assert rows(tables.load_map(spark, f"{tmp_path}/m")) == [("a", "1")]
    assert tables.load_map(spark, f"{tmp_path}/none").count() == 0
    assert "| a | 1 |" in tables.report_markdown("t", {"s": spark.createDataFrame([("a", 1)], "k string, v int")})


def test_ingest_reads_a_file_once(spark, tmp_path):
    from tidemark.streaming.ingest import ingest_files

    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.csv").write_text(f"id,day\n{n},2024-01-0{n}\n")
        ingest_files(spark, f"{tmp_path}/in", "id long, day date", f"{tmp_path}/out", f"{tmp_path}/cp", "day").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_outlier_profile_by_hand(spark):
    """1,000 values 1 to 1000, one of them -2: ranks 9, 989 and 998 of 0 to 999."""
    values = [float(i) for i in range(1, 1001)]
    values[499] = -2.0
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (float("nan"), None)], "x double, empty double")
    got = {r["column"]: r for r in audit.outlier_profile(df.filter("x IS NULL OR NOT isnan(x)"), ["x", "empty"]).collect()}
    x, empty = got["x"], got["empty"]
    assert (x["n"], x["negatives"], x["zeros"], x["min_value"], x["max_value"]) == (1000, 1, 0, -2.0, 1000.0)
    assert (x["p1"], x["p99"], x["p999"], x["extremes"]) == (9.0, 990.0, 999.0, 1)
    assert math.isclose(x["score"], 1002 / 2 + 999 / 9 + 0.1, abs_tol=1e-6)
    assert x["flag_negative"] and not x["flag_skew"] and not x["flag_tail"]
    assert empty["n"] == 0 and empty["score"] is None and [r["column"] for r in audit.most_extreme(audit.outlier_profile(df.na.drop("all"), ["x", "empty"])).collect()] == ["x"]


def test_acceptance_by_hand(spark):
    good = spark.createDataFrame([(1, "a", "2024-01-01", 0, 1.0), (1, "a", "2024-01-02", 1, None)], "id long, model string, day string, y int, r_1 double")
    good = good.select("id", "model", F.to_date("day").alias("day"), F.col("y").cast("byte").alias("y"), "r_1")
    verdict = lambda df, **more: {r["criterion"]: r["n_bad"] for r in audit.acceptance(df, "id", "model", "day", ["y"], **more).collect()}
    assert set(verdict(good).values()) == {0}
    bad = good.unionByName(good).withColumn("y", F.lit(None).cast("byte")).withColumn("r_1", F.lit(None).cast("int"))
    got = verdict(bad, required=["id", "y", "gone"], first_day="2024-01-02", last_day="2024-01-01", schemas=[["a"], ["b"], ["a"]], expected_rows=7)
    assert got == {"schema_consistency": 2, "type_consistency": 1, "uniqueness": 2, "missingness": 2, "label_distribution": 1, "label_nesting": 0, "date_coverage": 2, "row_reconciliation": 3, "overall": 13}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.integers(0, 3).map(float)), max_size=40))
def test_percentiles_are_exact(spark, values):
    known = sorted(v for v in values if v is not None)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = ranks.percentiles(df, {"x": [0, 33, 50, 100]})["x"]
    for p, v in got.items():
        if not known:
            assert v is None
        else:
            at = p / 100 * (len(known) - 1)
            a, b = known[int(at)], known[min(int(at) + 1, len(known) - 1)]
            assert math.isclose(v, a + (b - a) * (at - int(at)), rel_tol=1e-12, abs_tol=1e-9)


def test_order_statistics_in_few_bins(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", 3)
    monkeypatch.setattr(ranks, "FEW", 2)
    values = sorted([1e-9, 2e-9, 3e-9, 5.0, 5.0, 5.0, 5.0, 1e12, -1e12, 7.0, 7.5])
    got = ranks.order_statistics(spark.createDataFrame([(v,) for v in values], "x double"), {"x": range(len(values))})
    assert [got["x"][i] for i in range(len(values))] == values
