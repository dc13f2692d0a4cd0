"""Readers and writers: text CSV, month partitions, fallbacks, guards and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stages of the cleaning pipeline, the latest first: the first that exists is read.
STAGES = ("stage6", "stage4", "stage3", "stage2", "stage1", "labeled")


def list_files(spark: SparkSession, pattern: str, most: int | None = None) -> list[str]:
    """Paths that match a glob, in order; the first ``most``. Names only, through Hadoop's filesystem."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(s.getPath().toString() for s in found)[:most]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(list_files(spark, path, 1))


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    tried = list(paths)
    for path in tried:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {tried} exists")


def read_csv_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as text, named by each file's header: files are grouped by header, so a column
    that a file lacks is null there. Types are a later, explicit step."""
    files = list_files(spark, paths) if isinstance(paths, str) else list(paths)
    if not files:
        raise FileNotFoundError(f"no files: {paths}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in files:  # the header line of each file, not its rows
        groups.setdefault(tuple(spark.read.csv(f, header=True, inferSchema=False).columns), []).append(f)
    frames = [spark.read.csv(fs, header=True, schema=", ".join(f"`{c}` string" for c in cols), enforceSchema=True) for cols, fs in groups.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def file_schemas(spark: SparkSession, paths: str | Sequence[str], kind: str = "parquet") -> DataFrame:
    """(file, place, column, dtype) as each file says itself: from footers, or from a CSV file's header and rows."""
    files = list_files(spark, paths) if isinstance(paths, str) else list(paths)
    if not files:
        raise FileNotFoundError(f"no files: {paths}")
    reader = spark.read.option("header", "true").option("inferSchema", "true").format(kind)
    rows = [(f, i, c, t) for f in files for i, (c, t) in enumerate(reader.load(f).dtypes)]
    return spark.createDataFrame(rows, "file string, place int, column string, dtype string")


def read_months(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A year=/month= partitioned table; the first ``most`` partitions in order, by a pruning filter."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if most is None:
        return df
    label = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    names = sorted({"-".join(p.split("=")[1].zfill(2) for p in f.rstrip("/").split("/")[-2:]) for f in list_files(spark, f"{path}/year=*/month=*")})[:most]
    return df.filter(label.isin(names))


def read_file_prefix(df: DataFrame, most: int) -> DataFrame:
    """Rows of the first ``most`` files of a file source in order."""
    files = df.select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").limit(most)
    return df.withColumn("__f", F.col("_metadata.file_path")).join(F.broadcast(files), F.col("__f") == F.col("f"), "left_semi").drop("__f")


def write_months(df: DataFrame, path: str, day: str, overwrite: bool = False) -> None:
    """Partitioned by year and zero-padded month. Writing again replaces the months written, so a
    rerun never doubles rows; without ``overwrite`` an existing table is an error."""
    if not overwrite and exists(df.sparkSession, path):
        raise FileExistsError(path)
    out = df.withColumn("year", F.year(day)).withColumn("month", F.date_format(day, "MM"))
    (out.repartition("year", "month", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path))


def write_single(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = True) -> None:
    """One file, for small tables such as label lists and rankings."""
    writer = df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists")
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def report_json(sections: Mapping[str, DataFrame]) -> str:
    """A nested report from small summary tables."""
    return json.dumps({n: [r.asDict(recursive=True) for r in d.collect()] for n, d in sections.items()}, default=str, indent=2)


def report_markdown(title: str, sections: Mapping[str, DataFrame]) -> str:
    """A Markdown report with a table for each small summary."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.collect()]
    return "\n".join(lines) + "\n"


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file, which ends with a line break."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_map(df: DataFrame, path: str) -> None:
    """A two-column table as key and value text, one JSON object a line."""
    k, v = df.columns
    df.select(F.col(k).cast("string").alias("key"), F.col(v).cast("string").alias("value")).write.mode("overwrite").json(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value); empty if there is none or it can't be read."""
    try:
        return spark.read.schema("key string, value string").json(path).filter("key IS NOT NULL")
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], "key string, value string")


def load_config(text: str) -> dict:
    """A feature-set file: JSON, or the subset of YAML that is nested maps, lists and plain values."""
    text = text.strip()
    if text.startswith("{"):
        return json.loads(text)
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    lines = [x.split(" #")[0].rstrip() for x in text.splitlines()]
    lines = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    for i, line in enumerate(lines):
        indent, item = len(line) - len(line.lstrip()), line.strip()
        depth = indent + 1 if item.startswith("- ") else indent
        while stack[-1][0] >= depth:
            stack.pop()
        holder = stack[-1][1]
        if item.startswith("- "):
            holder.append(_plain(item[2:]))
            continue
        key, _, value = item.partition(":")
        if value.strip():
            holder[key.strip()] = _plain(value)
        else:
            follows = lines[i + 1].strip() if i + 1 < len(lines) else ""
            holder[key.strip()] = [] if follows.startswith("- ") else {}
            stack.append((indent, holder[key.strip()]))
    return root


def _plain(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_plain(x) for x in text[1:-1].split(",") if x.strip()]
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def known_features(config: Mapping, columns: Sequence[str], section: str = "features") -> list[str]:
    """The configured features that the table has."""
    return [c for c in config.get(section, []) if c in set(columns)]


def row_count_from_footers(spark: SparkSession, path: str) -> int:
    """Rows of a parquet table: no column is read, so footers are enough."""
    return spark.read.parquet(path).count()
