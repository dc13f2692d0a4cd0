"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams (1 to 3 letters, with word edges) in order, from
all rows with a language outside the held-out fold. A document's most frequent n-grams are compared
with each profile by the out-of-place distance: how far each n-gram's rank is off, or the most it
can be where the profile lacks it. The nearest profile wins; ties go to the name that sorts first.

Counts are added up for each partition before they shuffle; of each language only the top PROFILE
n-grams come to the driver.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any profile all
are; rows of null language teach nothing; a repeated row is predicted like the first; an empty
table gives an empty result.
"""

from __future__ import annotations

import regex
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out
from tidemark.llm.textops import blocks, small_batches

PROFILE = 300
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_ASCII_OTHERS = "".join(map(chr, range(128)))
#: Turns ASCII that is no letter into spaces at the speed of str.translate.
_CLEAN = {ord(c): " " for c in _ASCII_OTHERS if not c.isalpha()}


def codes(text: str) -> np.ndarray:
    """n-grams of 1 to 3 characters of each letter run, with an edge mark at both ends, as exact integers."""
    lowered = text.lower()
    if lowered.isascii():
        words = " ".join(lowered.translate(_CLEAN).split())
    else:
        words = " ".join(_LETTERS.findall(lowered))
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])  # no n-gram spans two words


def top_codes(found: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, in order; ties by code."""
    values, counts = np.unique(found, return_counts=True)
    return values[np.lexsort((values, -counts))[:most]]


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """For each language its top codes in order, from all rows of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for block in blocks(batches):
            by_lang: dict[str, list[str]] = {}
            for name, t in zip(block["lang"].to_pylist(), block["text"].to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(t or "")
            for name, texts in by_lang.items():
                values, counts = np.unique(codes(" ".join(texts)), return_counts=True)
                if name in sums:
                    both = np.concatenate([sums[name][0], values])
                    values, at = np.unique(both, return_inverse=True)
                    counts = np.bincount(at, np.concatenate([sums[name][1], counts])).astype(np.int64)
                sums[name] = (values, counts)
        for name, (values, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(counts)], names=["lang", "code", "c"])

    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")
    counted = known.mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("c"), "code"))
    out: dict[str, list[int]] = {}
    for name, code, _ in counted.withColumn("r", rank).filter(F.col("r") <= size).orderBy("lang", "r").select("lang", "code", "r").collect():
        out.setdefault(name, []).append(code)
    return out


def identify(docs: DataFrame, known: dict[str, list[int]], id_col: str = "doc_id", text: str = "text", size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score): the score is how much nearer the nearest profile is than the farthest possible."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        names = sorted(shared.value)
        vocabulary = np.unique(np.concatenate([np.array(shared.value[n], np.int64) for n in names] or [np.zeros(0, np.int64)]))
        ranks = np.full((len(names), len(vocabulary) + 1), -1)
        for i, n in enumerate(names):
            ranks[i, np.searchsorted(vocabulary, shared.value[n])] = np.arange(len(shared.value[n]))
        for block in blocks(batches):
            langs, scores = [], []
            for t in block["text"].to_pylist():
                top = top_codes(codes(t or ""), size)
                if not len(top) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(vocabulary, top), len(vocabulary) - 1)
                got = np.where(vocabulary[at] == top, ranks[:, at], -1)
                apart = np.where(got < 0, size, np.abs(got - np.arange(len(top)))).sum(axis=1)
                best = int(np.argmin(apart))
                langs.append(names[best])
                scores.append(1 - float(apart[best]) / (size * len(top)))
            yield pa.RecordBatch.from_arrays([block["doc_id"].combine_chunks(), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    found = identify(docs, profiles(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
