"""Preprocessing and classifiers: one parameterised run for every label, feature set and model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.audit import cell_missing_pct
from tidemark.operators.ranks import percentiles
from tidemark.operators.sampling import cap_keep_positives, downsample_negatives
from tidemark.operators.temporal import select_features


@dataclass(frozen=True)
class Prepared:
    """Median, mean and population deviation of each feature, after imputing; fitted on train only."""

    features: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """Features imputed and standardised, other columns as they are."""
        new = {c: ((F.coalesce(F.col(c), F.lit(md)) - mu) / sd).alias(c) for c, md, mu, sd in zip(self.features, self.median, self.mean, self.scale, strict=True)}
        return df.select(*[new.get(c, F.col(c)) for c in df.columns])


def fit_preprocess(df: DataFrame, features: Sequence[str]) -> Prepared:
    """Exact medians, then mean and deviation of the imputed values; all-null features become 0."""
    medians = percentiles(df, dict.fromkeys(features, (50,)))
    md = [medians[c][50] if medians[c][50] is not None else 0.0 for c in features]
    filled = [F.coalesce(F.col(c), F.lit(m)) for c, m in zip(features, md, strict=True)]
    row = df.agg(*[x for i, v in enumerate(filled) for x in (F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))]).first()
    mean = tuple(row[f"m{i}"] or 0.0 for i in range(len(features)))
    return Prepared(tuple(features), tuple(md), mean, tuple(row[f"s{i}"] or 1.0 for i in range(len(features))))


@dataclass(frozen=True)
class Config:
    """What distinguishes one training run from another."""

    label: str
    model: str = "lr"  # lr, rf, gbt or never
    balanced: bool = False
    feature_set: str = "all"
    negative_ratio: int | None = None
    train_cap: int = 5_000_000
    eval_cap: int = 2_000_000
    trees: int = 200
    depth: int | None = None
    iterations: int | None = None  # 200 for lr, 300 for gbt
    seed: int = 42

    @property
    def name(self) -> str:
        parts = [self.model, self.label]
        if self.feature_set != "all":
            parts.append(f"fe_{self.feature_set}")
        if self.negative_ratio:
            parts.append(f"tnr{self.negative_ratio}")
        kind = {"rf": ("cwbalanced", "cwnone"), "gbt": ("imauto", "imnone")}.get(self.model)
        if kind:
            parts.append(kind[0] if self.balanced else kind[1])
        elif self.balanced:
            parts.append("balanced")
        return "_".join(parts)


def _weights(df: DataFrame, config: Config) -> tuple[DataFrame, float]:
    row = metrics.class_weights(df, config.label).first()
    if config.model == "gbt":
        pos, neg = (row["pos_weight"] or 1.0, 1.0) if config.balanced else (1.0, 1.0)
    else:
        pos, neg = (row["w_pos"] or 1.0, row["w_neg"] or 1.0) if config.balanced else (1.0, 1.0)
    return df.withColumn("__w", F.when(F.col(config.label) == 1, pos).otherwise(neg)), pos * row["n_pos"] + neg * row["n_neg"]


def fit(train: DataFrame, features: Sequence[str], config: Config):
    """A pyspark.ml model on the vector of ``features``; None for the predictor that says never."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if config.model == "never":
        return None
    weighted, total = _weights(train, config)
    data = VectorAssembler(inputCols=list(features), outputCol="__x").transform(weighted.withColumn("__y", F.col(config.label).cast("double")))
    shared = {"featuresCol": "__x", "labelCol": "__y", "weightCol": "__w"}
    if config.model == "lr":  # C = 1 is a penalty of 1 / (sum of weights)
        learner = LogisticRegression(maxIter=config.iterations or 200, regParam=1 / max(total, 1.0), elasticNetParam=0.0, standardization=False, **shared)
    elif config.model == "rf":
        learner = RandomForestClassifier(numTrees=config.trees, maxDepth=min(config.depth or 30, 30), minInstancesPerNode=1, seed=config.seed, **shared)
    elif config.model == "gbt":
        learner = GBTClassifier(maxIter=config.iterations or 300, maxDepth=config.depth or 6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=config.seed, **shared)
    else:
        raise ValueError(f"unknown model {config.model}")
    return learner.fit(data)


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``score``, the probability of class 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return df.withColumn("score", F.lit(0.0))
    out = model.transform(VectorAssembler(inputCols=list(features), outputCol="__x").transform(df))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*[c for c in df.columns], "score")


def train_and_evaluate(parts: dict[str, DataFrame], features: Sequence[str], key: Sequence[str], config: Config) -> DataFrame:
    """Fit on train, choose the threshold on val, report val and test: a metrics row for each.

    Of ``features`` those of the configuration's feature set are used.
    """
    features = list(features) if config.feature_set == "all" else select_features(features, config.feature_set, ())
    train = cap_keep_positives(parts["train"], config.label, key, config.train_cap, config.seed)
    if config.negative_ratio:
        train = downsample_negatives(train, config.label, key, config.negative_ratio, config.seed)
    ready = fit_preprocess(train, features)
    model = fit(ready.apply(train), features, config)
    missing = cell_missing_pct(train, features).first()[0]
    scored = {n: predict(model, ready.apply(cap_keep_positives(parts[n], config.label, key, config.eval_cap, config.seed)), features) for n in ("val", "test")}
    threshold = metrics.best_threshold(metrics.threshold_scan(scored["val"], "score", config.label)).first()["threshold"]
    rows = [metrics.evaluate(scored[n], "score", config.label, threshold).select(F.lit(config.name).alias("experiment"), F.lit(n).alias("split"), "*", F.lit(missing).alias("train_missing_pct")) for n in ("val", "test")]
    return rows[0].unionByName(rows[1])
