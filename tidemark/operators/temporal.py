"""Calendar-aware features for each entity: every expression shares one partitioning and one sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, log1p_clamped


def day_number(day: str) -> Column:
    return F.unix_date(F.to_date(F.col(day)))


def history(keys: Sequence[str], day: str) -> WindowSpec:
    """An entity's rows ordered by the number of their day, so that ranges count calendar days."""
    return W.partitionBy(*keys).orderBy(day_number(day))


def delta(value: Column, w: WindowSpec, days: int) -> Column:
    """Value less that of exactly ``days`` days before; null if either is missing."""
    return value - F.first(value).over(w.rangeBetween(-days, -days))


def rolling(value: Column, w: WindowSpec, days: int, how: str) -> Column:
    """mean, std or var (sample) of the known values of the last ``days`` days, today's included."""
    f = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}[how]
    return f(value).over(w.rangeBetween(-(days - 1), 0))


def first_seen(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    return df.dropna(subset=[*keys, day]).groupBy(*keys).agg(F.min(F.to_date(day)).alias("first_seen"))


def merge_first_seen(train: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge, the earlier day of the two."""
    return train.unionByName(other).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))


def add_age(df: DataFrame, seen: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """age_days since first seen, at least 0; null where that is unknown."""
    age = F.datediff(F.to_date(day), "first_seen")
    joined = df.join(seen, list(keys), "left")
    return joined.withColumn("age_days", F.when(age.isNotNull(), F.greatest(age, F.lit(0))).cast("double")).drop("first_seen")


def age_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.min("age_days").alias("min_age"), F.max("age_days").alias("max_age"), F.round(F.avg("age_days"), 6).alias("mean_age")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def model_codes(train: DataFrame, model: str) -> DataFrame:
    """(model, model_code): the place of each model in sorted order, from 0. A row a model, so few."""
    distinct = train.filter(F.col(model).isNotNull()).select(F.col(model).alias("model")).distinct()
    return distinct.withColumn("model_code", (F.dense_rank().over(W.orderBy("model")) - 1).cast("int"))


def add_model_code(df: DataFrame, codes: DataFrame, model: str) -> DataFrame:
    """-1 for models that the codes lack, null included."""
    side = codes.select(F.col("model").alias("__m"), "model_code")
    return df.join(side, F.col(model) == F.col("__m"), "left").withColumn("model_code", F.coalesce("model_code", F.lit(-1))).drop("__m")


def log_features(df: DataFrame, bases: Sequence[str]) -> DataFrame:
    return df.select("*", *[log1p_clamped(F.col(c)).alias(f"log1p_{c}") for c in bases])


#: Name -> days, of the features that are built for each base.
DEFAULT = {"delta": (1, 7), "rollmean": 7, "rollstd": 7, "rollvar": None, "instability": True}


def temporal_features(df: DataFrame, keys: Sequence[str], day: str, bases: Sequence[str], config: Mapping[str, object] = DEFAULT) -> DataFrame:
    """Deltas, rolling statistics and instability (|one-day delta|), named and sorted as columns.

    For one row an entity and day; see ``temporal_features_repeated_days`` for more.
    """
    w = history(keys, day)
    out: dict[str, Column] = {}
    for c in bases:
        v = finite(F.col(c))
        for k in config.get("delta") or ():
            out[f"delta{k}_{c}"] = delta(v, w, k)
        for how in ("mean", "std", "var"):
            if n := config.get(f"roll{how}"):
                out[f"roll{how}{n}_{c}"] = rolling(v, w, n, how)
        if config.get("instability"):
            out[f"instab_{c}"] = F.abs(delta(v, w, 1))
    return df.select("*", *[out[n].alias(n) for n in sorted(out)])


def temporal_features_repeated_days(df: DataFrame, keys: Sequence[str], day: str, base: str, order: Sequence[str]) -> DataFrame:
    """The same for one base where an entity has several rows a day.

    History is what the day's last row (by ``order``) wrote; a row's own value is added to it: the
    running mean and sum of squares take one more value.
    """
    last = df.withColumn("__d", day_number(day)).groupBy(*keys, "__d").agg(F.max_by(finite(F.col(base)), F.struct(*order)).alias("__v"))
    w = W.partitionBy(*keys).orderBy("__d")
    prior = w.rangeBetween(-6, -1)
    daily = last.select(
        *keys, "__d", F.first("__v").over(w.rangeBetween(-1, -1)).alias("__p1"), F.first("__v").over(w.rangeBetween(-7, -7)).alias("__p7"),
        F.count("__v").over(prior).alias("__n"), F.avg("__v").over(prior).alias("__m"), F.var_pop("__v").over(prior).alias("__q"),
    )
    v, n, m, q = finite(F.col(base)), F.col("__n"), F.coalesce("__m", F.lit(0.0)), F.coalesce("__q", F.lit(0.0))
    count = n + F.when(v.isNotNull(), 1).otherwise(0)
    mean = F.when(v.isNull(), F.col("__m")).otherwise(m + (v - m) / (n + 1))
    squares = n * q + F.when(v.isNotNull(), (v - m) * (v - m) * n / (n + 1)).otherwise(0.0)
    variance = F.when(count > 1, squares / (count - 1))
    joined = df.withColumn("__d", day_number(day)).join(daily, [*keys, "__d"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns], (v - F.col("__p1")).alias(f"delta1_{base}"), (v - F.col("__p7")).alias(f"delta7_{base}"), F.abs(v - F.col("__p1")).alias(f"instab_{base}"),
        mean.alias(f"rollmean7_{base}"), F.sqrt(variance).alias(f"rollstd7_{base}"), variance.alias(f"rollvar7_{base}"),
    )


def engineer(df: DataFrame, train: DataFrame, keys: Sequence[str], day: str, model: str, bases: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """Originals, age, log1p, temporal features of log1p, and the model's code last."""
    known = first_seen(train, keys, day) if seen is None else merge_first_seen(seen, first_seen(df, keys, day), keys)
    out = log_features(add_age(df, known, keys, day), bases)
    out = temporal_features(out, keys, day, [f"log1p_{c}" for c in bases])
    return add_model_code(out, model_codes(train, model), model)


#: Feature families by the prefixes of their columns.
FAMILIES = {
    "baseline": (), "delta": ("delta1_", "delta7_"), "rollmean": ("rollmean7_",), "rollvar": ("rollvar7_", "rollstd7_"), "instability": ("instab_",), "log1p": ("log1p_",),
}


def select_features(columns: Sequence[str], family: str, exclude: Sequence[str]) -> list[str]:
    """Feature columns of a family: the originals and those of its prefixes; "all" takes all."""
    pool = [c for c in columns if c not in exclude]
    if family == "all":
        return sorted(pool)
    built = tuple(p for ps in FAMILIES.values() for p in ps)
    return sorted(c for c in pool if not c.startswith(built) or c.startswith(FAMILIES[family] or ("\0",)))
