"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 hashes every text and counts how often each Bloom slot is hit; slots hit once are proof that
a hash is unique. Pass 2 probes the bitmap of repeated slots: rows that miss it pass straight
through; the others shuffle by digest, pre-aggregated, and are resolved exactly. All slots of a hash
lie in one 4 KB block, so a row is probed by one join with the broadcast blocks.

That filter grows with the rows up to MAX_BITS (64 MB) and then lets more digests through, never
fewer. Whole texts are not probed with it but with filters that grow with what repeats: one of the
hashes that do occur twice, and one of the rows among them that stay. So a text that has no copy
passes straight through, and copies that go are dropped where they are read; what moves are the
texts that stay of a group, and false positives.

Defined cases: a null text counts as empty (empty texts equal each other); a null id is smaller
than any other; of rows that repeat id and text one is kept; an empty table gives an empty result;
other columns are untouched, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import filters
from tidemark.llm.textops import fold_ascii
from tidemark.session import materialize

#: Most slots of a hash; fewer where the filter is so full that they would tell less apart.
PROBES = 3
#: Bits of a filter at most: 64 MB, the bound of what is broadcast.
MAX_BITS = 1 << 29
#: Bits of a bitmap's block.
BLOCK = 1 << 15


class Bloom(NamedTuple):
    """Bitmap rows, bits in all, and slots of a hash."""

    rows: DataFrame
    bits: int
    probes: int


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest, h): SHA-256 and a 64-bit hash of each normalised text."""
    folded = docs.select(F.col(id_col).alias("id"), fold_ascii(F.col(text)).alias("t"))
    return folded.select("id", F.sha2(F.encode("t", "UTF-8"), 256).alias("digest"), F.xxhash64("t").alias("h"))


def _shape(n: int) -> tuple[int, int]:
    """(bits, probes) of a filter of n hashes: the probes with the fewest false positives."""
    bits = filters.bits_for(n, 8 * PROBES, MAX_BITS)
    return bits, min(range(1, PROBES + 1), key=lambda k: (1 - math.exp(-k * n / bits)) ** k)


def _slots(h, bits: int, probes: int):
    """Slots of a hash: a block by the hash, places in the block by digits of another one."""
    start, places = F.pmod(h, F.lit(bits // BLOCK)) * BLOCK, F.xxhash64(h, F.lit(0))
    return [start + F.shiftrightunsigned(places, 15 * i).bitwiseAND(F.lit(BLOCK - 1)) + 1 for i in range(probes)]


def repeated_slots(hashed: DataFrame) -> Bloom:
    """Pass 1: the slots that more than one row hits."""
    bits, probes = _shape(hashed.count())
    hits = hashed.select(F.explode(F.array(*_slots(F.col("h"), bits, probes))).alias("slot"))
    rows = filters.bitmap_rows(hits.groupBy("slot").count().filter("count > 1").select("slot"))
    return Bloom(materialize(rows, "bloom"), bits, probes)


def hit_slots(hashed: DataFrame) -> Bloom:
    """A filter of all hashes of ``hashed``, a written table."""
    bits, probes = _shape(hashed.count())
    hits = hashed.select(F.explode(F.array(*_slots(F.col("h"), bits, probes))).alias("slot"))
    return Bloom(materialize(filters.bitmap_rows(hits), "bloom"), bits, probes)


def probed(rows: DataFrame, bloom: Bloom, h: str = "h", out: str = "__maybe") -> DataFrame:
    """Pass 2: ``rows`` and a column ``out``, false where the filter has not the hash ``h``.

    The broadcast is MAX_BITS / 8 bytes at most.
    """
    side = F.broadcast(bloom.rows.select(F.col("bucket").alias("__b"), F.col("bits").alias("__m")))
    at = _slots(F.col(h), bloom.bits, bloom.probes)
    hit = F.lit(True)
    for slot in at:
        hit = hit & filters.bit_set(F.col("__m"), slot)
    return rows.join(side, F.bitmap_bucket_number(at[0]) == F.col("__b"), "left").withColumn(out, hit).drop("__b", "__m")


def duplicate_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, keep_id, group_size, kept, digest), a row for each row of ``docs``."""
    hashed = materialize(digests(docs, text, id_col), "digests")
    flagged = probed(hashed, repeated_slots(hashed))
    once = flagged.filter(~F.col("__maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    by_row = flagged.filter("__maybe").groupBy("digest", "id").agg(F.count("*").alias("c"))
    # written, so that the join below has an exchange on either side and Spark can split a large group
    by_text = materialize(by_row.groupBy("digest").agg(F.max(F.struct("id")).alias("top"), F.sum("c").alias("group_size")), "groups")
    sized = by_row.join(by_text, "digest").select(
        "id", F.col("top.id").alias("keep_id"), "group_size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("nth")
    )
    return once.unionByName(
        sized.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "digest")
    )


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the largest id.

    Digests decide; whole rows shuffle only where they may be the one of a group that stays.
    """
    cols = docs.columns
    hashed = materialize(digests(docs, text, id_col), "digests")
    by_text = probed(hashed, repeated_slots(hashed)).filter("__maybe").groupBy("digest")
    groups = by_text.agg(F.max(F.struct("id")).alias("top"), F.first("h").alias("h"), F.count("*").alias("size")).filter("size > 1")
    # written, so that the joins below have an exchange on either side and Spark can split a large group
    groups = materialize(groups.drop("size"), "groups")
    repeated, top = hit_slots(groups.select("h")), groups.select("digest", "top")
    stays = F.col("top").isNull() | F.col("id").eqNullSafe(F.col("top.id"))
    staying = probed(hashed, repeated).filter("__maybe").join(top, "digest", "left").filter(stays)
    staying = hit_slots(materialize(staying.select(F.xxhash64("id", "h").alias("h")), "staying"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(id_col).alias("id"), fold_ascii(F.col(text)).alias("t"))
    rows = probed(whole.withColumn("h", F.xxhash64("t")), repeated)
    once = rows.filter(~F.col("__maybe")).select("row.*")
    may_stay = probed(rows.filter("__maybe").withColumn("own", F.xxhash64("id", "h")), staying, "own", "__stays").filter("__stays")
    kept = may_stay.select("row", "id", F.sha2(F.encode("t", "UTF-8"), 256).alias("digest")).join(top, "digest", "left").filter(stays)
    # repeats of an id and text are what is left to drop
    return once.unionByName(kept.groupBy("digest").agg(F.first("row").alias("row")).select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_groups(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


ORACLE = {
    "op1_exact_dedup": """
    WITH t AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """
}
