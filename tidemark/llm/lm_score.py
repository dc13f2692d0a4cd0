"""Masked pseudo-likelihood: a bidirectional window network scores every word from both sides.

log p(word | REACH words on either side) is that of a path in a tree of words: a branch, a leaf of
that branch, the word within its leaf. Words are told apart by 64-bit hashes and counted over all
documents, in a table that grows with the corpus, and lie in the tree by frequency: leaves are of
about equal frequency, so a frequent word has one of its own and the network predicts it down to the
word; within the leaf of rarer words it is by the corpus counts. The network, in numpy, has
embeddings of the words around, one hidden layer and a softmax for each step of the path.

1. Texts are cut into words once, a block at a time, and written as places in the block's vocabulary.
2. Vocabularies are added up to the corpus counts. The words of the highest counts, FREQUENT at most,
   are broadcast; of the others a hash tells the leaf, and only those tokens meet their counts by a join.
3. Documents are written as embedding rows and leaves, in units of about UNIT words that a hash of
   id and text decides, whatever the partitions.
4. Training goes in ROUNDS rounds. Every word of the corpus is masked, and predicted, in one of them.
   In a round each unit goes on from the weights of the round before, and the units' weights are
   averaged by their words, as sums of whole numbers: the result depends on neither order nor split.

A document's score is the sum over all of its words, and its mean for a word. What is collected and
broadcast is the weights, of fixed size, FREQUENT words and a row for each of CELLS hashes and for
each level of counts.

Defined cases: null and wordless texts have no words, sum 0 and a null mean; a repeated row is
scored like the first; a word that the corpus lacks counts as one that occurs zero times; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textops import WordCache, as_bytes, blocks, ragged, signed, small_batches
from tidemark.session import materialize

#: Branches of the tree, and leaves of each.
BRANCHES = 32
LEAVES = BRANCHES * BRANCHES
REACH, WIDTH, HIDDEN = 2, 16, 32
#: Embeddings are shared by words whose hashes agree on these low bits.
SHARED = 1 << 13
FREQUENT, CELLS = 1 << 19, 1 << 12
ROUNDS, UNIT = 4, 1 << 20
BATCH, RATE = 1024, 0.7
#: The leaf that stands in the room between documents, REACH words before, between and after them.
NONE = 0xFFFF
#: Words whose hashes a task keeps.
WORDS_KEPT = 100_000
#: Weights travel as rows of so many whole numbers of 1 / SCALE.
ROW, SCALE = 32, 1 << 12

DOCS = "array<struct<doc_id:long,key:long,n:int>>"


def _cut(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each block: its documents, their words as places in its vocabulary, that vocabulary and its counts."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text)).alias("key"), F.col(text).alias("text"))

    def run(batches):
        words_hash = WordCache(most=WORDS_KEPT)
        for block in blocks(batches):
            found = [(t or b"").split() for t in as_bytes(block["text"])]
            h, at, c = np.unique(np.concatenate([words_hash.hashes(w) for w in found]), return_inverse=True, return_counts=True)
            rows = [block["doc_id"].combine_chunks(), block["key"].combine_chunks(), pa.array(list(map(len, found)), pa.int32())]
            listed = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.StructArray.from_arrays(rows, names=["doc_id", "key", "n"]))
            places = at.astype(np.uint16 if len(h) <= 1 << 16 else np.uint32)
            yield pa.RecordBatch.from_arrays([listed, *(pa.array([x.tobytes()], pa.binary()) for x in (places, h, c.astype(np.int32)))], names=["docs", "words", "hashes", "times"])

    return source.mapInArrow(run, f"docs {DOCS}, words binary, hashes binary, times binary")


def corpus_counts(cut: DataFrame) -> DataFrame:
    """(h, c) of every word of the corpus."""

    def run(batches):
        for batch in batches:
            for hashes, times in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                yield pa.RecordBatch.from_pydict({"h": np.frombuffer(hashes, np.int64), "c": np.frombuffer(times, np.int32).astype(np.int64)})

    return materialize(cut.select("hashes", "times").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Lexicon:
    """Where words lie in the tree: the frequent ones by hash, ascending, the others by the top bits of theirs."""

    h: np.ndarray
    c: np.ndarray
    leaf: np.ndarray
    first: int  # of the leaves that the others share
    tokens: np.ndarray
    mass: np.ndarray

    def leaves(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, count) of words; the count of one that isn't frequent is -1."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        known = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        shared = self.first + ((h >> np.uint64(52)).astype(np.int64) * (LEAVES - self.first)) // CELLS
        if not len(self.h):
            return shared, np.full(len(h), -1)
        return np.where(known, self.leaf[at], shared), np.where(known, self.c[at], -1)


def lexicon_of(counts: DataFrame) -> Lexicon:
    """Leaves of about equal frequency, with one added to every count."""
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((x, n) for x, n in counts.groupBy(level.alias("level")).agg(F.count("*")).collect()), reverse=True)  # 8 rows a power of two
    least, held = 1 << 30, 0
    for x, n in sizes:
        if held + n > FREQUENT:
            break
        least, held = x, held + n
    top = counts.filter(level >= least).select("h", "c").toArrow()  # FREQUENT rows at most
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    others = np.zeros((CELLS, 2), np.int64)
    cell = F.shiftrightunsigned("h", 52)
    for x, tokens, words in counts.filter(level < least).groupBy(cell.alias("cell")).agg(F.sum("c"), F.count("*")).collect():  # CELLS rows at most
        others[x] = tokens, words
    rest = others.sum() + CELLS  # one for a word that the corpus lacks, in each cell
    first = LEAVES - max(1, min(LEAVES - 1, round(LEAVES * rest / (rest + (c + 1).sum()))))
    order = np.lexsort((h, -c))
    before = np.cumsum(c[order] + 1) - (c[order] + 1)
    leaf = np.zeros(len(h), np.int64)
    leaf[order] = before * first // max(1, (c + 1).sum())
    order = np.argsort(h)
    h, c, leaf = h[order], c[order], leaf[order]
    of_cell = first + np.arange(CELLS) * (LEAVES - first) // CELLS
    tokens = np.bincount(leaf, c, LEAVES) + np.bincount(of_cell, others[:, 0], LEAVES)
    mass = np.bincount(leaf, c + 1, LEAVES) + np.bincount(of_cell, others.sum(axis=1) + 1, LEAVES)
    return Lexicon(h, c, leaf, first, tokens, mass)


UNITS = "unit long, part int, doc_id array<long>, n array<int>, inside array<double>, others array<int>, rows binary, leaves binary, other_words binary"


def _units(cut: DataFrame, lexicon: Lexicon, n_words: int) -> DataFrame:
    """Documents as embedding rows and leaves, packed into units.

    inside is the sum of log (count + 1) of a document's frequent words, others how many it has of the others.
    """
    shared = cut.sparkSession.sparkContext.broadcast(lexicon)

    def code(batches):
        for batch in batches:
            for docs, words, hashes in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                h, listed = np.frombuffer(hashes, np.uint64), docs.values
                n = listed.field("n").to_numpy()
                at = np.frombuffer(words, np.uint16 if len(h) <= 1 << 16 else np.uint32)
                leaf, c = shared.value.leaves(h)
                row, leaf, log = (h & np.uint64(SHARED - 1)).astype(np.uint16), leaf.astype(np.uint16), np.where(c < 0, 0, np.log(np.maximum(c, 0) + 1.0))
                ends = np.cumsum(n)
                spans = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
                found = [at[a:b] for a, b in spans]
                other = [h[x[c[x] < 0]] for x in found]
                for i in range(0, len(found), 256):
                    some = slice(i, i + 256)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": listed.field("doc_id")[some], "key": listed.field("key")[some], "n": n[some], "inside": [float(log[x].sum()) for x in found[some]], "others": pa.array([len(x) for x in other[some]], pa.int32()),
                            "rows": pa.array([row[x].tobytes() for x in found[some]], pa.binary()), "leaves": pa.array([leaf[x].tobytes() for x in found[some]], pa.binary()), "other_words": pa.array([x.tobytes() for x in other[some]], pa.binary()),
                        }
                    )

    cols = ["doc_id", "n", "inside", "others", "rows", "leaves", "other_words"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32())]

    def pack(batches):
        held, size, unit, part = [], 0, None, 0

        def packed():
            lists = [pa.array([pa.concat_arrays([b.column(i) for b in held]).to_pylist()], k) for i, k in zip((2, 3, 4, 5), kinds, strict=True)]
            room = {6: np.full(REACH, SHARED, np.uint16).tobytes(), 7: np.full(REACH, NONE, np.uint16).tobytes(), 8: b""}
            blobs = [pa.array([r + b"".join(x + r for b in held for x in b.column(i).to_pylist())], pa.binary()) for i, r in room.items()]
            return pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([part], pa.int32()), *lists, *blobs], names=["unit", "part", *cols])

        for batch in batches:
            units, words = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for i in range(batch.num_rows):
                if held and (units[i] != unit or size >= UNIT):
                    yield packed()
                    part = part + 1 if units[i] == unit else 0
                    held, size = [], 0
                unit = units[i]
                held.append(batch.slice(i, 1))
                size += int(words[i])
        if held:
            yield packed()

    coded = cut.select("docs", "words", "hashes").mapInArrow(code, "doc_id long, key long, n int, inside double, others int, rows binary, leaves binary, other_words binary")
    unit = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(max(1, n_words // UNIT))).alias("unit")
    return coded.select(unit, "key", *cols).repartition("unit").sortWithinPartitions("unit", "key", "doc_id").mapInArrow(pack, UNITS)


def around(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Embedding rows of the words on either side; SHARED stands for none."""
    return rows[at[:, None] + np.array([i for i in range(-REACH, REACH + 1) if i])]


def _add_rows(table: np.ndarray, at: np.ndarray, values: np.ndarray, rate: float) -> None:
    """table[at] -= rate * values, with rows that repeat."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    table[at[order][first]] -= rate * np.add.reduceat(values[order], first, axis=0)


class WindowNetwork:
    """Embeddings of the context, a hidden layer of tanh units, a softmax over branches and one over a branch's leaves.

    The second softmax has weights of its own and, for each branch, a bias for each leaf.
    """

    SHAPES = ((SHARED + 1, WIDTH), (2 * REACH * WIDTH, HIDDEN), (1, HIDDEN), (HIDDEN, BRANCHES), (1, BRANCHES), (HIDDEN, BRANCHES), (BRANCHES, BRANCHES))

    def __init__(self, p: list[np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, tokens: np.ndarray) -> WindowNetwork:
        """Random embeddings; biases as frequent as the leaves are."""
        draw = np.random.default_rng(3)
        p = [draw.normal(0, 0.5 if i == 0 else 1 / np.sqrt(s[0]), s).astype(np.float32) * (i in (0, 1)) for i, s in enumerate(cls.SHAPES)]
        by = tokens.reshape(BRANCHES, BRANCHES) + 1.0
        p[4] = np.log(by.sum(axis=1, keepdims=True).T / by.sum()).astype(np.float32)
        p[6] = np.log(by / by.sum(axis=1, keepdims=True)).astype(np.float32)
        return cls(p)

    @classmethod
    def of(cls, flat: np.ndarray) -> WindowNetwork:
        cuts = np.cumsum([a * b for a, b in cls.SHAPES])
        return cls([x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat[: cuts[-1]], cuts[:-1]), cls.SHAPES, strict=True)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs, a row a word, and hidden units, a column a word: sums over few units are faster down columns."""
        x = self.p[0][around].reshape(len(around), -1)
        return x, np.tanh(self.p[1].T @ x.T + self.p[2].T)

    def steps(self, h: np.ndarray, branch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the branches, and of the leaves of the branch that the word is in, a column a word."""
        return self.p[3].T @ h + self.p[4].T, self.p[5].T @ h + np.take(self.p[6].T, branch, axis=1)

    def log_prob(self, around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each leaf given the words around."""
        n, (branch, twig) = np.arange(len(leaf)), np.divmod(leaf, BRANCHES)
        total = np.zeros(len(leaf), np.float32)
        for out, at in zip(self.steps(self.hidden(around)[1], branch), (branch, twig), strict=True):
            out -= out.max(axis=0)
            total += out[at, n] - np.log(np.exp(out).sum(axis=0))
        return total

    def learn(self, around: np.ndarray, leaf: np.ndarray, rate: float) -> None:
        n, (branch, twig) = np.arange(len(leaf)), np.divmod(leaf, BRANCHES)
        x, h = self.hidden(around)
        g = []
        for out, at in zip(self.steps(h, branch), (branch, twig), strict=True):
            out -= out.max(axis=0)
            np.exp(out, out=out)
            out /= out.sum(axis=0) * np.float32(len(n))
            out[at, n] -= np.float32(1 / len(n))
            g.append(out)
        gh = (self.p[3] @ g[0] + self.p[5] @ g[1]) * (1 - h * h)
        gx = (gh.T @ self.p[1].T).reshape(-1, WIDTH)
        own = np.zeros((BRANCHES, len(n)), np.float32)
        own[branch, n] = 1
        for i, d in ((1, x.T @ gh.T), (2, gh.sum(axis=1)), (3, h @ g[0].T), (4, g[0].sum(axis=1)), (5, h @ g[1].T), (6, own @ g[1].T)):
            self.p[i] -= rate * d
        _add_rows(self.p[0], around.ravel(), gx, rate * 10)


def train(units: DataFrame, lexicon: Lexicon) -> WindowNetwork:
    """Every word of every unit is a target in one round."""
    names = [f"w{i}" for i in range(ROW)]
    net = WindowNetwork.start(lexicon.tokens)
    for number in range(ROUNDS):
        shared = units.sparkSession.sparkContext.broadcast(net.flat())

        def run(batches, shared=shared, number=number):
            sums, seen = np.zeros(-(-len(shared.value) // ROW) * ROW, np.int64), 0
            for batch in batches:
                for blobs in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                    rows, leaf = (np.frombuffer(x, np.uint16) for x in blobs)
                    own, turn = WindowNetwork.of(shared.value), np.arange(number, len(leaf), ROUNDS)
                    turn = turn[leaf[turn] != NONE]
                    for some in _slices(len(turn), BATCH):
                        own.learn(around(rows, turn[some]), leaf[turn[some]].astype(np.int64), RATE / (1 + number))
                    weight = int((leaf != NONE).sum())
                    sums[: len(shared.value)] += np.rint(own.flat() * float(SCALE) * weight).astype(np.int64)
                    seen += weight
            if seen:
                table = sums.reshape(-1, ROW)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), pa.array(np.full(len(table), seen)), *(pa.array(table[:, i]) for i in range(ROW))], names=["row", "n", *names])

        local = units.select("rows", "leaves").mapInArrow(run, "row long, n long, " + ", ".join(f"{n} long" for n in names))
        rows = local.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).collect()  # the network's size
        if not rows:
            break
        flat = np.zeros((len(rows), ROW))
        for row in rows:
            flat[row[0]] = np.array(row[2:], float) / (float(SCALE) * row[1])
        net = WindowNetwork.of(flat.ravel())
    return net


def _slices(n: int, size: int = 1 << 12) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


def _scored(units: DataFrame, lexicon: Lexicon, counts: DataFrame, net: WindowNetwork) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) for each document of the units."""
    shared = units.sparkSession.sparkContext.broadcast((net.flat(), np.log(np.maximum(lexicon.mass, 1))))

    def run(batches):
        net, among = WindowNetwork.of(shared.value[0]), shared.value[1]
        for batch in batches:
            for i in range(batch.num_rows):
                unit, part = (batch.column(k)[i].as_py() for k in (0, 1))
                ids, n, inside = (batch.column(k)[i].values for k in (2, 3, 4))
                lengths = n.to_numpy()
                rows, leaf = (np.frombuffer(batch.column(k)[i].as_py(), np.uint16) for k in (5, 6))
                score, words = np.zeros(len(leaf)), np.flatnonzero(leaf != NONE)
                for some in (words[x] for x in _slices(len(words))):
                    own = leaf[some].astype(np.int64)
                    score[some] = net.log_prob(around(rows, some), own) - among[own]
                # a document and the room after it
                total = np.add.reduceat(score, REACH + ragged(lengths + REACH)[0][:-1]) + inside.to_numpy()
                yield pa.RecordBatch.from_pydict({"unit": np.full(len(lengths), unit), "place": (part << 32) + np.arange(len(lengths)), "doc_id": ids, "n_words": lengths.astype(np.int64), "total": total})

    def others(batches):
        for batch in batches:
            for unit, part, n, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h, place = np.frombuffer(words, np.int64), np.repeat((part << 32) + np.arange(len(n)), n)
                for some in _slices(len(h), 1 << 14):
                    yield pa.RecordBatch.from_pydict({"unit": np.full(len(h[some]), unit), "place": place[some], "h": h[some]})

    place = "unit long, place long"
    scored = units.select("unit", "part", "doc_id", "n", "inside", "rows", "leaves").mapInArrow(run, f"{place}, doc_id long, n_words long, total double")
    rare = units.select("unit", "part", "others", "other_words").mapInArrow(others, f"{place}, h long").join(counts, "h", "left")
    more = rare.groupBy("unit", "place").agg(F.sum(F.log(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"))
    log_prob = F.col("total") + F.coalesce("more", F.lit(0.0))
    joined = scored.join(more, ["unit", "place"], "left").select("doc_id", "n_words", log_prob.alias("log_prob"))
    return joined.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


@dataclass
class LanguageModel:
    lexicon: Lexicon
    counts: DataFrame
    net: WindowNetwork

    def score(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_words, log_prob, mean_log_prob) for each row, of this corpus or another."""
        small_batches(docs.sparkSession)
        cut = materialize(_cut(docs, id_col, text), "words")
        return _scored(materialize(_units(cut, self.lexicon, _n_words(cut)), "units"), self.lexicon, self.counts, self.net)


def _n_words(cut: DataFrame) -> int:
    return cut.agg(F.coalesce(F.sum(F.aggregate("docs.n", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0]


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[LanguageModel, DataFrame]:
    """The model of a corpus, and that corpus in units."""
    small_batches(docs.sparkSession)
    cut = materialize(_cut(docs, id_col, text), "words")
    counts = corpus_counts(cut)
    lexicon = lexicon_of(counts)
    units = materialize(_units(cut, lexicon, _n_words(cut)), "units")
    return LanguageModel(lexicon, counts, train(units, lexicon)), units


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) for each row."""
    model, units = fit(docs, id_col, text)
    return _scored(units, model.lexicon, model.counts, model.net)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", F.round("log_prob", 4).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))
