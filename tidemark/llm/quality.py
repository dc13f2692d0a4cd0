"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing: each word (hashed to one of BUCKETS) has a fixed sparse random index vector, and
its word vector is the sum of the index vectors of the words near it, over all documents. The sums
are whole numbers added up by Spark, partition by partition, so they are exact and of a fixed size
(BUCKETS x DIM). A document is pooled to the mean and the spread of its words' vectors and the mean
product of neighbouring ones. A network of one hidden layer, in numpy, is fitted on a sample of
labelled rows of bounded size (``max_rows``); a temperature fitted on a fifth of it calibrates the
probabilities.

Defined cases: null and wordless texts are pooled to zeros and scored as such; where no label is at
hand every score is 0.5; a repeated row is scored like the first; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, labelled_rows
from tidemark.llm.textops import WordCache, as_bytes, blocks, mix, ragged, small_batches

BUCKETS, DIM = 1 << 13, 32
#: Words on either side that count as near.
REACH = 2
MAX_ROWS = 6_000
THRESHOLD = 0.7


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket its +1 and its -1 coordinate."""
    draw = mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(0x51ED270B))
    plus = (draw % np.uint64(DIM)).astype(np.int64)
    return plus, (plus + 1 + ((draw >> np.uint64(32)) % np.uint64(DIM - 1)).astype(np.int64)) % DIM


def buckets_of(texts: list[bytes | None], words_hash: WordCache) -> tuple[np.ndarray, np.ndarray]:
    found = [(t or b"").split() for t in texts]
    h = np.concatenate([words_hash.hashes(w) for w in found] or [np.zeros(0, np.uint64)])
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), np.fromiter(map(len, found), np.int64, len(found))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM unit vectors from all of ``docs``."""
    small_batches(docs.sparkSession)
    names = [f"v{i}" for i in range(DIM)]

    def run(batches):
        words_hash, sums = WordCache(), np.zeros(BUCKETS * DIM)
        plus, minus = index_vectors()
        for block in blocks(batches):
            at, lengths = buckets_of(as_bytes(block["text"]), words_hash)
            _, owner = ragged(lengths)
            for gap in range(1, min(REACH, len(at) - 1) + 1):
                near = owner[gap:] == owner[:-gap]
                left, right = at[:-gap][near], at[gap:][near]
                for word, other in ((left, right), (right, left)):
                    sums += np.bincount(word * DIM + plus[other], minlength=BUCKETS * DIM)
                    sums -= np.bincount(word * DIM + minus[other], minlength=BUCKETS * DIM)
        table = sums.reshape(BUCKETS, DIM)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(table[used, i].astype(np.int64)) for i in range(DIM)], names=["bucket", *names])

    local = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((BUCKETS, DIM))
    for row in local.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect():  # BUCKETS rows at most
        out[row[0]] = row[1:]
    out = np.sign(out) * np.log1p(np.abs(out))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: list[bytes | None], vectors: np.ndarray, words_hash: WordCache) -> np.ndarray:
    at, lengths = buckets_of(texts, words_hash)
    offsets, owner = ragged(lengths)
    n, out = np.maximum(lengths, 1)[:, None], np.zeros((len(texts), 3 * DIM + 1), np.float32)
    full = np.flatnonzero(lengths)
    if len(full):
        v = vectors[at]
        mean = np.zeros((len(texts), DIM), np.float32)
        mean[full] = np.add.reduceat(v, offsets[full], axis=0)
        mean /= n
        square = np.zeros_like(mean)
        square[full] = np.add.reduceat(v * v, offsets[full], axis=0)
        beside = np.zeros_like(v)
        beside[:-1] = v[:-1] * v[1:] * (owner[1:] == owner[:-1])[:, None]
        product = np.zeros_like(mean)
        product[full] = np.add.reduceat(beside, offsets[full], axis=0)
        out = np.hstack([mean, np.sqrt(np.maximum(square / n - mean**2, 0)), product / n, np.log1p(lengths)[:, None]]).astype(np.float32)
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh units, a logit divided by a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -35, 35)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 1500, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Adam on the log loss; the temperature is the best of a grid on the last fifth of the rows."""
    draw = np.random.default_rng(5)
    width = x.shape[1]
    net = Network(np.zeros(width), np.ones(width), draw.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if len(y) == 0:
        return net
    cut = len(y) - len(y) // 5
    net.shift, net.scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-3
    z, t = (x[:cut] - net.shift) / net.scale, y[:cut]
    params = [net.w1, net.b1, net.w2, np.array([0.0])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = draw.integers(0, len(t), min(256, len(t)))
        zb, tb = z[pick], t[pick]
        h = np.tanh(zb @ params[0] + params[1])
        g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -35, 35))) - tb) / len(tb)
        gh = np.outer(g, params[2]) * (1 - h * h)
        grads = [zb.T @ gh + decay * params[0], gh.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    if cut < len(y):
        raw, truth = net.logit(x[cut:]), y[cut:]
        loss = lambda temp: np.mean(np.logaddexp(0, raw / temp) - truth * raw / temp)
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def score(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        table, model = shared.value
        words_hash = WordCache()
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block["doc_id"].combine_chunks(), pa.array(model.probability(pool(as_bytes(block["text"]), table, words_hash)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, Network]:
    """Texts of the sample are pooled where they are; ``max_rows`` rows of numbers come to the driver."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        words_hash = WordCache()
        for batch in batches:
            if batch.num_rows:
                x = pool(as_bytes(batch.column(1)), shared.value, words_hash).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(2)], names=["id", "x", "y"])

    rows = sorted(map(tuple, labelled_rows(docs, labels, label, max_rows).mapInArrow(run, "id long, x array<double>, y int").collect()))
    x = np.array([r[1] for r in rows]).reshape(-1, 3 * DIM + 1)
    return vectors, fit_network(x, np.array([r[2] for r in rows], float))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, *train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
