"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are its distinct words, word pairs and pairs with one word between, hashed
to 2**BITS coordinates. FTRL-proximal gives each coordinate a learning rate of its own and L1 keeps
few weights, which are broadcast as two short arrays. It is fitted on a sample of labelled rows of
bounded size (``max_rows``); scoring reads every whole text.

Defined cases: null and wordless texts get the score of the intercept; where no label is at hand
every score is 0.5, and reject_toxic raises ValueError; a repeated row is scored like the first; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, labelled_rows
from tidemark.llm.textops import FOLD_WORDS, WordCache, as_bytes, blocks, mix, ragged, small_batches

BITS = 20
MAX_ROWS = 12_000
THRESHOLD = 0.3


def features(texts: list[bytes | None], words_hash: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, owner) of all n-grams and skip-grams of the texts, repeats included."""
    found = [(t or b"").translate(FOLD_WORDS).split() for t in texts]
    h = np.concatenate([words_hash.hashes(w) for w in found] or [np.zeros(0, np.uint64)])
    _, owner = ragged(np.fromiter(map(len, found), np.int64, len(found)))
    mask, parts, owners = np.uint64((1 << BITS) - 1), [mix(h)], [owner]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        inside = owner[gap:] == owner[:-gap] if len(h) > gap else np.zeros(0, bool)
        pair = mix(h[:-gap] * np.uint64(salt) + h[gap:]) if len(h) > gap else h[:0]
        parts.append(pair[inside])
        owners.append(owner[gap:][inside] if len(h) > gap else owner[:0])
    return (np.concatenate(parts) & mask).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal for 0/1 features; the intercept is not penalised."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.z0 = self.n0 = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    @property
    def intercept(self) -> float:
        return -self.z0 / ((self.beta + np.sqrt(self.n0)) / self.alpha)

    def learn(self, at: np.ndarray, y: int) -> None:
        w, w0 = self.weights(at), self.intercept
        g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g
        self.z0 += g - (np.sqrt(self.n0 + g * g) - np.sqrt(self.n0)) / self.alpha * w0
        self.n0 += g * g


Model = tuple[np.ndarray, np.ndarray, float]


def learn(rows: list[tuple[np.ndarray, int]], epochs: int = 6) -> Model:
    """(coordinates, weights, intercept) from rows of distinct coordinates and a label: the weights that are not zero."""
    model = Ftrl()
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    at = np.flatnonzero(np.abs(model.z) > model.l1)
    return at, model.weights(at).astype(np.float32), float(model.intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text: str = "text") -> Model:
    """Learns in one task from the sample of ``max_rows`` rows; only the weights come to the driver."""
    small_batches(docs.sparkSession)

    def run(batches):
        words_hash, rows = WordCache(), []
        for batch in batches:
            for text, y in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows.append((np.unique(features([text], words_hash)[0].astype(np.int32)), y))
        at, weights, intercept = learn(rows)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.list_(pa.int64())), "weights": pa.array([weights], pa.list_(pa.float32())), "intercept": [intercept]})

    sample = labelled_rows(docs, labels, label, max_rows, id_col=id_col, text=text).repartition(1).sortWithinPartitions("id", "text")
    found = sample.mapInArrow(run, "at array<long>, weights array<float>, intercept double").collect()
    at, weights, intercept = found[0] if found else ([], [], 0.0)
    return np.array(at, np.int64), np.array(weights, np.float32), intercept


def _scorer(model: Model):
    """A function from texts to scores, with weights laid out once a task."""
    at, values, intercept = model
    dense = np.zeros(1 << BITS, np.float32)
    dense[at] = values
    words_hash = WordCache()

    def run(texts: list[bytes | None]) -> np.ndarray:
        where, owner = features(texts, words_hash)
        live = dense[where] != 0
        once = np.unique(owner[live] * (1 << BITS) + where[live])  # a feature counts once a document
        logit = np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], len(texts)) + intercept
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _scorer(shared.value)
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block["doc_id"].combine_chunks(), pa.array(scores(as_bytes(block["text"])))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns unchanged, that score below the threshold.

    Without a label of either class there is nothing to judge by: ValueError, unless ``docs`` is empty.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, max_rows=max_rows, id_col=id_col, text=text)
    if not len(model[0]) and model[2] == 0 and not docs.isEmpty():
        raise ValueError("no labelled document outside the held-out fold: toxicity can't be learned")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        scores = _scorer(shared.value)
        for block in blocks(batches, text):
            yield from block.filter(pa.array(scores(as_bytes(block.column(at))) < threshold)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
