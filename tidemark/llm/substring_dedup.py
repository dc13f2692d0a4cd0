"""Substring deduplication with prefix-partitioned suffix trees.

A suffix is a document read from one word on; two suffixes that agree on ``window`` words meet in a
node that deep in the suffix tree of the corpus, and the nodes of at least that depth are the
repeats sought. The tree is built in parts, each of a group of suffixes small enough for one task:

1. Prefixes. A suffix's prefix runs from its first word to the end of its anchor: of the word 8-grams
   among its first ``window`` words the one with the least hash. So prefixes have 8 to ``window``
   words, as the text decides, and suffixes that share ``window`` words share their prefix. Anchors
   are counted over the corpus, pre-aggregated; a suffix whose anchor occurs once is a leaf by itself
   and goes no further, as a bitmap of bounded size tells (one that is too full lets more through).
2. Groups. Suffixes whose prefixes end in the same anchor are a group. Neighbouring ones move as one
   run of words. Within a block of documents only the first suffix of each node goes on; later ones
   are known to repeat. A group of more than GROUP suffixes is split by longer prefixes, all of the
   ``window`` words: each of its nodes is then a group, of which only the least (id, position) is
   needed, and that is a pre-aggregated minimum, joined back so that Spark can split a hot passage.
3. Subtrees. A task takes the groups of its partition some at a time, sorts their suffixes by words
   (prefix doubling) and computes the longest common prefix of neighbours: a suffix and LCP array,
   whose intervals of common prefixes are the internal nodes. Runs of equal words are sorted once. Of
   the leaves of a node of depth ``window`` or more the first stays and the others are repeats.
4. The repeats of each document are joined with its text and their words removed.

Within a group words are compared themselves; nodes of whole windows are told apart by two 64-bit
hashes, of the anchor's words and of the window's.

Defined cases: null and wordless texts keep no words; documents shorter than a window stay whole;
a document without id takes no part (nothing of it is removed, and nothing on its account); rows
that repeat an id count as one document, none before the other, and only a row's own words are
removed; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import filters
from tidemark.llm.textops import WordCache, as_bytes, blocks, grams, ragged, signed, small_batches
from tidemark.session import materialize

WINDOW = 20
ANCHOR = 8
#: Suffixes of a group that one task takes at most; larger groups get longer prefixes.
GROUP = 20_000
#: Words of runs that are sorted at a time, and words whose hashes a task keeps: they bound its memory.
SORTED, WORDS_KEPT = 1 << 18, 100_000


def _runs(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x, done = pick(x[:-done], x[done:]), done * 2
    rest = width - done
    return pick(x[:-rest], x[rest:]) if rest else x


class Windows:
    """The windows of a block of documents: start positions, anchors' hashes and windows' hashes."""

    def __init__(self, texts: list[bytes | None], cache: WordCache, window: int):
        self.words = words = [(t or b"").split() for t in texts]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.offsets, owner = ragged(self.lengths)
        h = np.concatenate([cache.hashes(w) for w in words] or [np.zeros(0, np.uint64)])
        n = len(h) - window + 1
        self.anchor_size = min(ANCHOR, window)
        empty = np.zeros(0, np.uint64)
        self.valid = np.zeros(0, bool)
        self.gram = self.least = self.whole = empty
        if n > 0:
            self.gram, self.whole = grams(h, self.anchor_size, window) if self.anchor_size < window else [grams(h, window)[0]] * 2
            self.least = _runs(self.gram, window - self.anchor_size + 1, np.minimum)
            self.valid = owner[:n] == owner[window - 1 :]
        self.owner = owner[: max(0, n)]
        self.window = window

    def anchors(self) -> np.ndarray:
        """The hash of each position that is the anchor of some window."""
        if not self.valid.any():
            return self.gram[:0]
        span = self.window - self.anchor_size
        pad = np.zeros(span, np.uint64)
        most = _runs(np.concatenate([pad, np.where(self.valid, self.least, 0), pad]), span + 1, np.maximum)
        return self.gram[most == self.gram]


def _anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        cache = WordCache(most=WORDS_KEPT)
        for block in blocks(batches):
            found, counts = np.unique(Windows(as_bytes(block["text"]), cache, window).anchors(), return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": signed(found), "c": counts})

    return docs.mapInArrow(run, "anchor long, c long").groupBy("anchor").agg(F.sum("c").alias("c")).filter("c > 1")


RUN = "anchor long, doc long, key long, start int, n int, words binary, whole long"


def _runs_of_suffixes(docs: DataFrame, window: int, repeated: np.ndarray, large: np.ndarray, all_leaves: bool) -> DataFrame:
    """Neighbouring suffixes that may repeat: n of them from a start on.

    With words: of one group, for a subtree. With whole: one suffix of a large group. With neither:
    known to repeat; there are none of these with ``all_leaves``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((repeated, large))

    def run(batches):
        cache, (bits, split) = WordCache(most=WORDS_KEPT), shared.value
        for block in blocks(batches):
            w = Windows(as_bytes(block["text"]), cache, window)
            at = np.flatnonzero(w.valid)
            at = at[filters.probe(bits, w.least[at])] if len(at) else at
            if not len(at):
                continue
            row = w.owner[at]
            anchor, whole, start = w.least[at], w.whole[at], at - w.offsets[row]
            doc, key = (block[c].to_numpy()[row] for c in ("doc_id", "key"))
            kind = np.where(filters.probe(split, anchor), SOLO, TREE)
            if not all_leaves:
                rank = np.lexsort((key, start, doc, whole, anchor))
                same = lambda *cols: np.concatenate([[False], np.all([c[rank][1:] == c[rank][:-1] for c in cols], axis=0)])
                node = np.cumsum(~same(anchor, whole))
                first = rank[np.flatnonzero(np.diff(node, prepend=0))][node - 1]
                kind[rank] = np.where((doc[rank] != doc[first]) | (start[rank] != start[first]), KNOWN, kind[rank])
                kind[rank[same(anchor, whole, doc, start, key)]] = -1  # rows that repeat
                use = kind >= 0
                at, row, anchor, whole, start, doc, key, kind = (x[use] for x in (at, row, anchor, whole, start, doc, key, kind))
            joined = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]) & (kind[1:] == kind[:-1]) & (kind[1:] != SOLO)
            joined &= (kind[1:] == KNOWN) | (anchor[1:] == anchor[:-1])
            heads = np.flatnonzero(np.concatenate([[True], ~joined]))
            n, of = np.diff(np.append(heads, len(at))), kind[heads]
            spans = zip(row[heads].tolist(), start[heads].tolist(), (start[heads] + n + window - 1).tolist(), (of == TREE).tolist(), strict=True)
            words = [b" ".join(w.words[r][a:b]) if tree else None for r, a, b, tree in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor[heads]), mask=of == KNOWN), pa.array(doc[heads]), pa.array(key[heads]), pa.array(start[heads].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(words, pa.binary()), pa.array(signed(whole[heads]), mask=of != SOLO)],
                names=["anchor", "doc", "key", "start", "n", "words", "whole"],
            )

    return docs.mapInArrow(run, RUN)


TREE, KNOWN, SOLO = 0, 1, 2


class SuffixTree:
    """The subtrees of runs of words, as a suffix and LCP array of the suffixes of ``window`` words or more."""

    def __init__(self, runs: list[bytes], window: int):
        numbers = defaultdict(count(1).__next__)  # any order of words will do
        words = [r.split() for r in runs]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.offsets, owner = ragged(lengths)
        rank = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words])
        # ranks by 1, 2, 4, ... words; 0 stands for the end of a run
        step, self.ranks = 1, [rank]
        while step < lengths.max():
            beyond = np.zeros(len(rank), np.int64)
            beyond[:-step] = np.where(owner[step:] == owner[:-step], rank[step:], 0)
            rank = np.unique((rank << 32) | beyond, return_inverse=True)[1] + 1
            self.ranks.append(rank)
            step *= 2
        left = self.offsets[1:][owner] - np.arange(len(rank))
        suffixes = np.flatnonzero(left >= window)
        self.suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
        a, b = self.suffixes[:-1], self.suffixes[1:]
        most = np.minimum(left[a], left[b])
        self.lcp = np.zeros(len(a), np.int64)
        for power in range(len(self.ranks) - 1, -1, -1):
            fits = self.lcp + (1 << power) <= most
            x, y = np.where(fits, a + self.lcp, 0), np.where(fits, b + self.lcp, 0)
            self.lcp += (fits & (self.ranks[power][x] == self.ranks[power][y])) << power

    def nodes(self, depth: int) -> np.ndarray:
        """For each of ``suffixes`` the number of its ancestor that is the highest of at least ``depth`` words."""
        return np.concatenate([[0], np.cumsum(self.lcp < depth)])


LEAVES = "doc long, key long, start int, n int, first_doc long, first_start int"


def later_leaves(rows: pa.Table, window: int) -> pa.RecordBatch:
    """The repeats among runs of whole groups: n suffixes from a start on, and where their words start first."""
    code = rows["words"].combine_chunks().dictionary_encode()
    which, runs = code.indices.to_numpy(), code.dictionary.to_pylist()
    doc, key, start, n = (rows[c].to_numpy() for c in ("doc", "key", "start", "n"))
    tree = SuffixTree(runs, window)
    # the first place of each run of words, then of each node
    order = np.lexsort((start, doc, which))
    first = order[np.flatnonzero(np.diff(which[order], prepend=-1))]
    owner = np.searchsorted(tree.offsets, tree.suffixes, side="right") - 1
    deep, begun = tree.nodes(window), tree.suffixes - tree.offsets[owner]
    leaf_doc, leaf_start = doc[first][owner], start[first][owner] + begun
    order = np.lexsort((leaf_start, leaf_doc, deep))
    head = order[np.flatnonzero(np.diff(deep[order], prepend=-1))]
    node = np.zeros(tree.offsets[-1], np.int64)
    node[tree.suffixes] = deep
    ends, row = ragged(n)
    nth = np.arange(ends[-1]) - ends[row]
    own = node[tree.offsets[which[row]] + nth]
    first_doc, first_start, at = leaf_doc[head][own], leaf_start[head][own], start[row] + nth
    later = np.flatnonzero((doc[row] != first_doc) | (at != first_start))
    row, at, first_doc, first_start = row[later], at[later], first_doc[later], first_start[later]
    joined = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (first_doc[1:] == first_doc[:-1]) & (first_start[1:] == first_start[:-1] + 1)
    heads = np.flatnonzero(np.concatenate([[True], ~joined])[: len(row)])
    length = np.diff(np.append(heads, len(row)))
    r = row[heads]
    return pa.RecordBatch.from_pydict(
        {"doc": doc[r], "key": key[r], "start": at[heads].astype(np.int32), "n": length.astype(np.int32), "first_doc": first_doc[heads], "first_start": first_start[heads].astype(np.int32)}
    )


def _subtrees(runs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows * window
            if size < SORTED:
                continue
            table = pa.Table.from_batches(held)
            anchor = table["anchor"].to_numpy()
            cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if len(cuts):  # the last group may go on in the next batch
                yield later_leaves(table.slice(0, cuts[-1]), window)
                held = table.slice(cuts[-1]).to_batches()
            size = sum(b.num_rows for b in held) * window
        if held:
            yield later_leaves(pa.Table.from_batches(held), window)

    grouped = runs.select("anchor", "doc", "key", "start", "n", "words").repartition("anchor").sortWithinPartitions("anchor")
    return grouped.mapInArrow(run, LEAVES)


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, key, text): the key tells the rows of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", all_leaves: bool = False) -> DataFrame:
    """(doc, key, start, n, first_doc, first_start): runs of n windows whose words also start earlier, in (id, position) order.

    ``key`` is the hash of the row's text. first_doc and first_start, where the words start first, may
    be null, and are not with ``all_leaves``, which moves every suffix that may repeat.
    """
    small_batches(docs.sparkSession)
    source = _source(docs, id_col, text).filter("doc_id IS NOT NULL")
    anchors = materialize(_anchor_counts(source, window), "anchors")

    def bitmap(some: DataFrame) -> np.ndarray:
        bits = filters.bits_for(some.count())
        return filters.to_numpy(filters.bitmap_rows(some.select(filters.slot(F.col("anchor"), bits).alias("slot"))), bits)

    found = materialize(_runs_of_suffixes(source, window, bitmap(anchors), bitmap(anchors.filter(F.col("c") > GROUP)), all_leaves), "suffixes")
    solo = found.filter("whole IS NOT NULL")
    # written, so that the join has an exchange on either side and Spark can split a hot passage
    nodes = materialize(solo.groupBy("anchor", "whole").agg(F.min(F.struct("doc", "start")).alias("first")), "nodes")
    later = solo.join(nodes, ["anchor", "whole"]).filter("doc <> first.doc OR start <> first.start")
    known = found.filter("words IS NULL AND whole IS NULL")
    cols = ["doc", "key", "start", "n"]
    return (
        _subtrees(found.filter("words IS NOT NULL"), window)
        .unionByName(later.select(*cols, F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start")))
        .unionByName(known.select(*cols, F.lit(None).cast("long").alias("first_doc"), F.lit(None).cast("int").alias("first_start")))
    )


REST = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or with ``digest`` their SHA-256."""
    found = repeats(docs, window, id_col, text).groupBy(F.col("doc").alias("doc_id"), "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    joined = _source(docs, id_col, text).join(found, ["doc_id", "key"], "left").select("doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.n").alias("lengths"))

    def run(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept": []}
            for data, at, length in zip(as_bytes(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = (data or b"").split()
                n = len(words)
                if at.is_valid:
                    edge = np.zeros(n + 1, np.int32)
                    begin = at.values.to_numpy()
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + length.values.to_numpy() + window - 1, -1)
                    stay = np.cumsum(edge)[:n] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                left = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return joined.mapInArrow(run, REST)


def maximal_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, n_words, first_doc, first_start): repeats of at least ``window`` words, as long as they go.

    The words from start on stand at first_start of first_doc too, where each of their windows starts
    first; neighbouring windows that start first side by side are one repeat.
    """
    found = repeats(docs, window, id_col, text, all_leaves=True).distinct()
    before = W.partitionBy("doc", "key").orderBy("start")
    follows = (F.lag(F.col("start") + F.col("n")).over(before) == F.col("start")) & (F.lag("first_doc").over(before) == F.col("first_doc"))
    follows &= F.lag(F.col("first_start") + F.col("n")).over(before) == F.col("first_start")
    marked = found.withColumn("head", F.when(follows, 0).otherwise(1)).withColumn("nth", F.sum("head").over(before))
    glued = marked.groupBy("doc", "key", "nth").agg(F.min("start").alias("start"), (F.sum("n") + window - 1).alias("n_words"), F.min(F.struct("start", "first_doc", "first_start")).alias("f"))
    return glued.select("doc", "start", "n_words", "f.first_doc", "f.first_start").distinct()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = {
    "op4_substring_dedup": """
    WITH d AS (
      SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    g AS (
      SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    later AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS nth FROM g) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (
      SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
      FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """
}
