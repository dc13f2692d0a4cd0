"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate, target rows / rows at hand. Each document's count is the
Poisson distribution of that mean, inverted at a uniform number hashed from seed and id; the
document is exploded that many times, by blocks in several tasks where they are many, and the copies are dealt out by a hash of seed, id and copy.

Defined cases: a null source is a source of its own; a null id hashes as the empty string; rows
that repeat an id get the same count; a source that ``weights`` lacks has weight 0; empty tables
give an empty result. Added columns are named by parameters, and a clash raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
#: Standard deviations on either side of the mean within which a distribution is inverted.
SPREAD = 13
#: Copies of a document that one row is exploded to; a document of more is first dealt out in blocks.
COPIES = 1_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.encode(F.concat_ws("|", *parts), "UTF-8")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_count(rate: str, u: str) -> Column:
    """The least k with P(X <= k) >= u, of a Poisson distribution of any mean: probabilities are added up in one run.

    Starts where less than 1e-30 lies below; log-factorials by Stirling's series, exact to 1e-12
    from 10 on.
    """
    first = f"if({rate} < 400, 0, cast(floor({rate} - {SPREAD} * sqrt({rate})) as int))"
    k = f"cast({first} as double)"
    log_factorial = f"({k} * ln({k}) - {k} + 0.5 * ln(2 * pi() * {k}) + 1 / (12 * {k}) - 1 / (360 * power({k}, 3)))"
    p0 = f"exp(if({first} = 0, -{rate}, {k} * ln({rate}) - {rate} - {log_factorial}))"
    last = f"cast(ceil({rate} + {SPREAD} * sqrt({rate}) + 20) as int)"
    return F.expr(f"""
        aggregate(
            sequence({first} + 1, {last}),
            named_struct('p', {p0}, 'cdf', {p0}, 'n', {first}),
            (a, k) -> named_struct('p', a.p * {rate} / k, 'cdf', a.cdf + a.p * {rate} / k, 'n', a.n + if(a.cdf < {u}, 1, 0)),
            a -> a.n + if(a.cdf < {u}, 1, 0))""")


def source_rates(docs: DataFrame, weights: DataFrame | None, total: int | None, source: str) -> DataFrame:
    """(src, rate): equal weights where none are given; ``total`` rows, as many as now by default."""
    sizes = docs.groupBy(F.col(source).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        target = sizes.select("src", F.lit(1.0).alias("w"))
    else:
        target = weights.select(F.col("source").alias("src"), F.col("weight").cast("double").alias("w"))
    sums = sizes.agg(F.sum("n").alias("n_all")).crossJoin(target.agg(F.sum("w").alias("w_all")))  # one row
    joined = sizes.alias("s").join(target.alias("t"), F.col("s.src").eqNullSafe(F.col("t.src"))).crossJoin(sums)
    goal = F.col("n_all") if total is None else F.lit(total)
    return joined.select("s.src", (F.col("w") / F.col("w_all") * goal / F.col("n")).alias("rate")).filter("rate > 0")


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = 7,
    id_col: str = "doc_id", source: str = "source", copy_col: str = "copy", key_col: str = "shuffle_key",
) -> DataFrame:
    """All columns of ``docs``, ``copy_col`` (from 1) and ``key_col``, in globally shuffled order.

    ``weights`` has (source, weight); every source's expected share of the result is its weight's.
    """
    if {copy_col, key_col} & set(docs.columns):
        raise ValueError(f"docs already has a column {copy_col} or {key_col}")
    rates = materialize(source_rates(docs, weights, total, source).select(F.col("src").alias("__src"), F.col("rate").alias("__rate")), "rates")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    seeded = F.lit(str(seed))
    counted = docs.join(rates, F.col(source).eqNullSafe(F.col("__src"))).withColumn("__u", uniform(seeded, ident)).withColumn("__n", poisson_count("__rate", "__u"))
    copied = counted.filter(F.col("__n").between(1, COPIES)).withColumn(copy_col, F.explode(F.sequence(F.lit(1), "__n")))
    rate = rates.agg(F.max("__rate")).first()[0] or 0.0
    if rate + SPREAD * rate**0.5 + 21 > COPIES:  # else no document can have more
        # a source with few documents for its weight: blocks of their copies go to many tasks
        dealt = counted.filter(F.col("__n") > COPIES).withColumn("__block", F.explode(F.sequence(F.lit(0), ((F.col("__n") - 1) / COPIES).cast("int"))))
        dealt = dealt.repartition(F.xxhash64("__u", "__block"))
        upto = F.least(F.col("__n"), (F.col("__block") + 1) * COPIES)
        copied = copied.unionByName(dealt.withColumn(copy_col, F.explode(F.sequence(F.col("__block") * COPIES + 1, upto))).drop("__block"))
    keyed = copied.select(
        *[F.col(f"`{c}`") for c in docs.columns], copy_col,
        F.md5(F.encode(F.concat_ws("|", seeded, ident, F.col(copy_col).cast("string")), "UTF-8")).alias(key_col),
    )
    return keyed.repartition(F.col(key_col)).sortWithinPartitions(key_col)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights for all sources, at the size of the input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return mix_sources(docs)


ORACLE = {
    "op3_mixing": """
    WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    rates AS (
      SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes) * (SELECT count(*) FROM documents) / n AS rate FROM sizes),
    pmf AS (
      SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
      UNION ALL
      SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM pmf WHERE k < rate + 13 * sqrt(rate) + 20),
    u AS (
      SELECT doc_id, source, lang, text,
             (CAST('0x' || substr(md5('7|' || doc_id), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM documents),
    counted AS (
      SELECT u.doc_id, u.source, u.lang, u.text, count(*) AS n
      FROM u JOIN pmf ON u.source IS NOT DISTINCT FROM pmf.source AND pmf.cdf < u.u GROUP BY ALL),
    copies AS (SELECT doc_id, source, lang, text, unnest(range(1, n + 1))::INTEGER AS copy FROM counted)
    SELECT *, md5('7|' || doc_id || '|' || copy) AS shuffle_key FROM copies
    """
}
