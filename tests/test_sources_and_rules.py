"""Sources, sinks, reports and small rules, on files written here."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import audit, cleaning, labels, models, ranking, sampling, temporal
from tidemark.sources import tables
from tidemark.streaming import ingest


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(i, f"m{i % 3}", dt.date(2024, 1 + i // 4, 1 + i), float(i)) for i in range(8)], "id long, model string, day date, r_1 double")


def test_files_lists_fallbacks_and_prefixes(spark, frame, tmp_path):
    for i in range(3):
        frame.filter(F.col("id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/t/p{i}")
    found = tables.list_files(spark, f"{tmp_path}/t/*/*.parquet")
    assert len(found) == 3 and found == sorted(found) and len(tables.list_files(spark, f"{tmp_path}/t/*/*.parquet", 2)) == 2
    assert tables.first_existing(spark, [f"{tmp_path}/{s}" for s in tables.STAGES] + [f"{tmp_path}/t"]) == f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [f"{tmp_path}/none"])
    df = spark.read.parquet(*found)
    assert {r["id"] for r in tables.read_file_prefix(df, 2).select("id").collect()} == {0, 3, 6, 1, 4, 7}
    assert tables.row_count_from_footers(spark, f"{tmp_path}/t/p0") == 3
    order = cleaning.file_order(df).select("src_file", "src_row").collect()
    assert len({tuple(r) for r in order}) == 8 and max(r["src_row"] for r in order) == 2


def test_schemas_as_files_tell_them(spark, frame, tmp_path):
    frame.select("id", "model").coalesce(1).write.csv(f"{tmp_path}/a", header=True)
    frame.select("id", F.col("r_1").alias("model"), "day").coalesce(1).write.csv(f"{tmp_path}/b", header=True)
    found = tables.file_schemas(spark, f"{tmp_path}/*/*.csv", "csv")
    assert [tuple(r)[1:] for r in found.orderBy("file", "place").collect()] == [(0, "id", "int"), (1, "model", "string"), (0, "id", "int"), (1, "model", "double"), (2, "day", "date")]
    assert [tuple(r) for r in audit.dtype_drift(found).collect()] == [("model", "double,string", 2)]
    with pytest.raises(FileNotFoundError):
        tables.file_schemas(spark, f"{tmp_path}/none/*")


def test_sinks_and_reports(spark, frame, tmp_path):
    tables.write_single(frame, f"{tmp_path}/one", "csv")
    assert len(tables.list_files(spark, f"{tmp_path}/one/part-*")) == 1 and spark.read.csv(f"{tmp_path}/one", header=True).count() == 8
    with pytest.raises(Exception, match="exist"):
        tables.write_single(frame, f"{tmp_path}/one", "csv", overwrite=False)
    rows = [json.loads(r["value"]) for r in tables.to_json_rows(spark.createDataFrame([(1, None)], "a int, b string")).collect()]
    assert rows == [{"a": 1, "b": None}]
    report = json.loads(tables.report_json({"counts": frame.groupBy("model").count().orderBy("model")}))
    assert report["counts"][0] == {"model": "m0", "count": 3}
    tables.save_text(spark, "# a\n\nb", f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text", wholetext=True).first()[0] == "# a\n\nb\n"


def test_columns_by_name_and_type(spark, frame):
    assert ranking.numeric_columns(frame, ["id"]) == ["r_1"] and ranking.numeric_columns(frame, ["id", "r_1"]) == ["id", "r_1"]
    assert cleaning.require_columns(frame, ["id"]) is frame
    with pytest.raises(ValueError, match="gone"):
        cleaning.require_columns(frame, ["id", "gone"])
    assert cleaning.select_columns(frame, ["day", "gone"]).columns == ["day", "r_1"]
    assert cleaning.select_columns(frame, ["day"], keep_extra=True).columns == ["day", "r_1", "id", "model"]
    assert labels.detect_id_column(["model", "Serial_Number", "id"]) == "Serial_Number" and labels.detect_id_column(["model"]) is None
    assert labels.detect_datetime_column(frame.withColumn("failure_time", F.lit(None).cast("string"))) == "failure_time"
    assert labels.detect_datetime_column(frame.withColumnRenamed("day", "fail_date")) == "fail_date"
    assert labels.detect_datetime_column(frame) == "day"  # not named as one, but a date
    texts = spark.createDataFrame([("x", "2024-01-02", None), ("y", "2024-01-03", None), ("z", "?", None)], "a string, b string, empty_date string")
    assert labels.detect_datetime_column(texts) == "b" and labels.detect_datetime_column(texts.select("a")) is None


def test_feature_families(spark):
    columns = ["id", "r_1", "log1p_r_1", "delta1_log1p_r_1", "delta7_log1p_r_1", "rollmean7_log1p_r_1", "rollstd7_log1p_r_1", "instab_log1p_r_1"]
    assert temporal.select_features(columns, "all", ["id"]) == sorted(columns[1:])
    assert temporal.select_features(columns, "baseline", ["id"]) == ["r_1"]
    assert temporal.select_features(columns, "delta", ["id"]) == ["delta1_log1p_r_1", "delta7_log1p_r_1", "r_1"]
    df = spark.createDataFrame([(i, float(i % 5), float(-i), i % 2) for i in range(40)], "id long, r_1 double, delta1_r_1 double, y int")
    parts = {n: df for n in ("train", "val", "test")}
    run = lambda kind: [tuple(r)[2:] for r in models.train_and_evaluate(parts, ["r_1", "delta1_r_1"], ["id"], models.Config("y", "lr", feature_set=kind)).collect()]
    alone = [tuple(r)[2:] for r in models.train_and_evaluate(parts, ["r_1"], ["id"], models.Config("y", "lr")).collect()]
    assert run("baseline") == alone


def test_prefixes_months_and_digests(spark, frame):
    months = frame.withColumn("month", scalars.month_text(F.col("day")))
    assert {r["month"] for r in sampling.first_partitions(months, ["month"], 1).collect()} == {"01"}
    got = frame.filter("id < 2").select(scalars.key_digest(F.col("id"), F.col("model")).alias("d"), scalars.key_digest(F.col("id"), F.lit(None)).alias("n")).collect()
    assert [r["d"] for r in got] == [hashlib.md5(f"{i}|m{i}".encode()).hexdigest() for i in range(2)] and got[0]["n"] is None


def test_daily_counts_of_a_stream(spark, tmp_path):
    schema = "ts timestamp, key string"
    rows = [(dt.datetime(2024, 1, d, h), "a") for d in (1, 2, 20) for h in range(d)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    counts = ingest.daily_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "key")
    counts.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["day"].day, r["n_rows"]) for r in spark.table("daily").collect()) == [(1, 1), (2, 2)]
