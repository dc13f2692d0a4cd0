"""Benchmark decontamination with a distributed positional inverted index.

1. Index. The corpus is cut into shards, blocks of whole documents of bounded size. Each shard's
   positional postings, for every term the ascending positions at which it stands, are written to
   the shared folder, or where a path says, with the shard's documents: one pass over the texts, and
   the only one. Terms are told apart by 64-bit hashes.
2. Queries. The distinct windows of the benchmark's items are phrases. The dictionary of the index
   tells in which shards and how often their terms stand; a phrase goes to the shards that have its
   rarest term, by a join, so a benchmark of any size takes one pass over the index.
3. Search. A shard meets its phrases with the postings of benchmark terms alone. A phrase's
   candidates are the postings of its rarest term there, less its offset; they are intersected
   with the offset-adjusted postings of its other terms, the rarer first. In-order matches with
   other words between come from the same lists.

Defined cases: null and wordless texts have no words and match nothing; items without words are no
queries; items without id count together as one item that is not named; item texts that repeat count
as items of their own; a repeated document row is judged as a row of its own, and a row without id
too; empty tables give an empty result or no hits; other columns are not read, and decontaminate
keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import filters
from tidemark.llm.textops import FOLD_WORDS, WordCache, as_bytes, blocks, ragged, signed, small_batches
from tidemark.session import materialize

WINDOW = 10
#: Phrases that a shard is searched for at a time, and words whose hashes a task keeps: they bound its memory.
PHRASES, WORDS_KEPT = 1 << 15, 100_000
DOCS = "array<struct<doc_id:long,key:long,n_words:long>>"
INDEX = f"shard long, docs {DOCS}, terms binary, ends binary, positions binary"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD_WORDS).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes and reads back a row for each shard, to ``path`` or else as a scratch table.

    docs: id, hash of the text and words of each row. terms: hashes, ascending; ends: where each
    term's postings end among positions, which count words from the shard's first on.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))

    def run(batches):
        words_hash, base = WordCache(most=WORDS_KEPT), TaskContext.get().partitionId() << 32
        for number, block in enumerate(blocks(batches)):
            found = [words_of(t) for t in as_bytes(block["text"])]
            h = np.concatenate([words_hash.hashes(w) for w in found])
            order = np.argsort(h, kind="stable").astype(np.int32)
            ends = np.flatnonzero(np.diff(h[order], append=~h[order[-1:]])) + 1
            rows = [block["doc_id"].combine_chunks(), block["key"].combine_chunks(), pa.array(list(map(len, found)), pa.int64())]
            listed = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.StructArray.from_arrays(rows, names=["doc_id", "key", "n_words"]))
            blobs = (h[order[ends - 1]].tobytes(), ends.astype(np.int32).tobytes(), order.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([base + number]), listed, *(pa.array([x], pa.binary()) for x in blobs)], names=["shard", "docs", "terms", "ends", "positions"])

    rows = source.mapInArrow(run, INDEX)
    if path is None:
        return materialize(rows, "index")
    rows.write.parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


class Postings:
    """Posting lists of a shard: ``terms`` ascending, ``ends`` of their lists among ``positions``."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        self.offsets, _ = ragged(lengths)
        self.terms, self.positions = terms, positions
        self.at = np.concatenate([[0], ends]).astype(np.int64)
        # every posting as one number, ascending: a list holds a position if its number is there
        self.keys = (np.repeat(np.arange(len(terms)), np.diff(self.at)) << 32) | positions

    def only(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """terms, ends and positions of some of the lists."""
        counts = np.diff(self.at)
        return self.terms[keep], np.cumsum(counts[keep], dtype=np.int32), self.positions[np.repeat(keep, counts)]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def lists_of(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list number of each term of each phrase, whether the phrase has all its terms here)."""
        if not len(self.terms):
            return np.zeros(phrases.shape, np.int64), np.zeros(len(phrases), bool)
        at = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        return at, (self.terms[at] == phrases).all(axis=1)

    def phrase_starts(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence within one document."""
        at, there = self.lists_of(phrases)
        live = np.flatnonzero(there)
        at, size, counts = at[live], phrases.shape[1], np.diff(self.at)
        order = np.argsort(counts[at], axis=1, kind="stable") if len(live) else at
        rarest = at[np.arange(len(live)), order[:, 0]]
        ends, owner = ragged(counts[rarest])
        nth = np.arange(ends[-1]) - ends[owner]
        start = self.positions[self.at[rarest][owner] + nth].astype(np.int64) - order[owner, 0]
        fits = (start >= 0) & (start + size <= self.offsets[-1])
        owner, start = owner[fits], start[fits]
        for nth in range(1, size):  # the rarer lists first: most candidates go at once
            offset = order[owner, nth]
            wanted = (at[owner, offset] << 32) | (start + offset)
            same = self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted
            owner, start = owner[same], start[same]
        inside = self.doc_of(start) == self.doc_of(start + size - 1)
        return live[owner[inside]], start[inside]

    def near(self, phrase: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """(start, end) of the shortest in-order matches of a phrase with at most ``slop`` other words between."""
        at, there = self.lists_of(phrase[None])
        if not there[0]:
            return []
        lists = [self.positions[self.at[t] : self.at[t + 1]] for t in at[0]]
        begin = end = lists[0]
        for other in lists[1:]:
            nth = np.searchsorted(other, end, side="right")
            ok = nth < len(other)
            begin, end = begin[ok], other[nth[ok]]
        ok = (self.doc_of(begin) == self.doc_of(end)) & (end - begin + 1 - len(phrase) <= slop)
        best = dict(zip(end[ok].tolist(), begin[ok].tolist(), strict=True))  # the latest begin for each end
        return sorted((b, e) for e, b in best.items())


def _windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(phrase, words) of the distinct windows, and (phrase, item, item_start) of each one."""

    def run(batches):
        words_hash = WordCache(most=WORDS_KEPT)
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                h = signed(words_hash.hashes(words_of(data)))
                size = min(window, len(h))
                at = np.arange(len(h) - size + 1 if size else 0)
                for some in (at[i : i + PHRASES] for i in range(0, len(at), PHRASES)):
                    words = h[some[:, None] + np.arange(size)]
                    cuts = pa.array(np.arange(len(some) + 1) * size, pa.int32())
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(some), pa.string()), "item_start": some.astype(np.int32), "words": pa.ListArray.from_arrays(cuts, pa.array(words.ravel()))})

    source = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    found = materialize(source.mapInArrow(run, "item string, item_start int, words array<long>"), "windows")
    phrases = materialize(found.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")  # numbered once, as written
    return phrases, materialize(found.join(phrases, "words").select("phrase", "item", "item_start"), "owners")


def _with_lists(index: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The index with the postings of some terms alone."""
    shared = index.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            for some in (batch.slice(i, 1) for i in range(batch.num_rows)):
                terms, ends, positions = (np.frombuffer(some.column(c)[0].as_py(), t) for c, t in ((2, np.uint64), (3, np.int32), (4, np.int32)))
                lists = Postings(np.zeros(0, np.int64), terms, ends, positions).only(filters.probe(shared.value, terms))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array([x.tobytes()], pa.binary()) for x in lists)], names=["shard", "docs", "terms", "ends", "positions"])

    return index.mapInArrow(run, INDEX)


def _dictionary(index: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(term, shard, c): how often some terms stand in each shard; positions are not read."""
    shared = index.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            for shard, terms, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms, counts = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(ends, np.int32), prepend=0)
                use = np.flatnonzero(filters.probe(shared.value, terms))
                yield pa.RecordBatch.from_pydict({"term": signed(terms[use]), "shard": np.full(len(use), shard), "c": counts[use].astype(np.int64)})

    return index.select("shard", "terms", "ends").mapInArrow(run, "term long, shard long, c long")


def _search(index: DataFrame, phrases: DataFrame, found, schema: str) -> DataFrame:
    """Shards and their phrases, gone through by ``found(docs, lists, blocks of phrases)``, which yields record batches."""
    used = phrases.select(F.explode("words").alias("term")).distinct()
    bits = filters.bits_for(used.count())
    bitmap = filters.to_numpy(filters.bitmap_rows(used.select(filters.slot(F.col("term"), bits).alias("slot"))), bits)
    places = materialize(_dictionary(index, bitmap), "terms")
    totals = places.groupBy("term").agg(F.sum("c").alias("c"))
    counted = phrases.select("phrase", "words", F.explode("words").alias("term")).join(totals, "term")
    rarest = counted.groupBy("phrase", "words").agg(F.count("*").alias("n"), F.min(F.struct("c", "term"))["term"].alias("term")).filter(F.col("n") == F.size("words"))
    sent = materialize(rarest.select("phrase", "words", "term"), "rarest").join(places.select("term", "shard"), "term")
    none = lambda kind: F.lit(None).cast(kind)
    heads = _with_lists(index, bitmap).withColumns({"phrase": none("long"), "words": none("array<long>")})
    asked = sent.select("shard", *(none(t).alias(c) for c, t in (("docs", DOCS), ("terms", "binary"), ("ends", "binary"), ("positions", "binary"))), "phrase", "words")

    def run(batches):
        for head, rest in _shards(batches):
            docs = head.column(1)[0].values
            n_words = docs.field("n_words").to_numpy()
            terms, ends, positions = (np.frombuffer(head.column(c)[0].as_py(), t) for c, t in ((2, np.uint64), (3, np.int32), (4, np.int32)))
            yield from found(head.column(0)[0].as_py(), docs, Postings(n_words, terms, ends, positions), rest)

    both = heads.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("phrase").asc_nulls_first())
    return both.mapInArrow(run, schema)


def _shards(batches) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """For each shard the row that holds its lists and its (numbers, words) of phrases of one length, some at a time."""
    rows = (batch.slice(a, b - a) for batch in batches for a, b in _cuts(batch))
    ahead = next(rows, None)

    def phrases():
        nonlocal ahead
        held = []
        while ahead is not None and ahead.column(5)[0].is_valid:
            held.append(ahead)
            ahead = next(rows, None)
            if sum(x.num_rows for x in held) >= PHRASES:
                yield from by_length(held)
                held = []
        yield from by_length(held)

    def by_length(held):
        if held:
            number = np.concatenate([x.column(5).to_numpy() for x in held])
            values = np.concatenate([x.column(6).flatten().to_numpy() for x in held]).view(np.uint64)
            size = np.concatenate([x.column(6).value_lengths().to_numpy() for x in held])
            offsets, _ = ragged(size)
            for n in np.unique(size):
                some = np.flatnonzero(size == n)
                yield number[some], values[offsets[some][:, None] + np.arange(n)]

    while ahead is not None:
        head, ahead = ahead, next(rows, None)
        rest = phrases()
        yield head, rest
        for _ in rest:  # whatever was not asked for
            pass


def _cuts(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """A batch in runs: a row with lists by itself, phrases of a shard together."""
    n = batch.num_rows
    if not n:
        return []
    shard, head = batch.column(0).to_numpy(), batch.column(5).is_null().to_numpy(zero_copy_only=False)
    new = np.flatnonzero((shard[1:] != shard[:-1]) | head[1:] | head[:-1]) + 1
    bounds = [0, *new.tolist(), n]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


FOUND = "shard long, place long, doc_id long, key long, n_words long, hits array<int>, phrases array<long>"


def occurrences(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """For each row of the corpus its words that any phrase covers (hits) and the phrases that occur."""

    def found(shard, docs, lists, asked):
        edge = np.zeros(lists.offsets[-1] + 1, np.int32)
        pairs = []
        for number, words in asked:
            which, at = lists.phrase_starts(words)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + words.shape[1], -1)
            pairs.append(np.stack([lists.doc_of(at), number[which]]))
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        cuts = np.searchsorted(hit, lists.offsets)
        place = np.repeat(np.arange(len(docs)), np.diff(cuts))
        doc, phrase = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(docs), shard)), pa.array(np.arange(len(docs))), docs.field("doc_id"), docs.field("key"), docs.field("n_words"),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((hit - lists.offsets[place]).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(docs) + 1)), pa.int32()), pa.array(phrase)),
            ],
            names=["shard", "place", "doc_id", "key", "n_words", "hits", "phrases"],
        )

    return _search(index, phrases, found, FOUND)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """For each document row: doc_id, n_words, hits (word positions), items (ids as sorted strings)."""
    phrases, owners = _windows(benchmark, window, item_id, item_text)
    found = materialize(occurrences(build_index(docs, id_col, text), phrases), "found")
    row = ["shard", "place"]
    pairs = found.select(*row, F.explode("phrases").alias("phrase")).join(owners.select("phrase", "item").distinct(), "phrase").select(*row, "item").distinct()
    items = pairs.groupBy(*row).agg(F.array_sort(F.transform(F.collect_list(F.struct("item")), lambda x: x["item"])).alias("items"))
    named = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return found.join(items, row, "left").select("doc_id", "n_words", "hits", named)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0,
    id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Where item windows stand: (doc_id, item_id, item_start, start, end, kind), by word position.

    kind is "exact"; with ``slop`` also "near": in order, with up to that many other words between.
    """
    phrases, owners = _windows(benchmark, window, item_id, item_text)

    def found(shard, docs, lists, asked):
        for number, words in asked:
            which, at = lists.phrase_starts(words)
            exact = set(zip(which.tolist(), at.tolist(), strict=True))
            spans = [(p, a, a + words.shape[1] - 1, "exact") for p, a in sorted(exact)]
            if slop:
                spans += [(p, a, e, "near") for p in range(len(words)) for a, e in lists.near(words[p], slop) if (p, a) not in exact]
            if spans:
                which, begin, end = (np.array(x, np.int64) for x in list(zip(*spans, strict=True))[:3])
                doc = lists.doc_of(begin)
                base = lists.offsets[doc]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": docs.field("doc_id").take(pa.array(doc)), "phrase": number[which], "start": (begin - base).astype(np.int32), "end": (end - base).astype(np.int32), "kind": [x[3] for x in spans]}
                )

    spans = _search(build_index(docs, id_col, text), phrases, found, "doc_id long, phrase long, start int, end int, kind string")
    return spans.join(owners, "phrase").select("doc_id", F.col("item").alias("item_id"), "item_start", "start", "end", "kind")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, unchanged, in which no item window occurs.

    Rows are told apart by id and hash of the text. Those that can't be contaminated, as a bitmap
    tells, pass straight through; only the others are moved.
    """
    phrases, _ = _windows(benchmark, window, item_id, item_text)
    found = occurrences(build_index(docs, id_col, text), phrases).filter(F.size("hits") > 0)
    hit = materialize(found.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).distinct(), "hits")
    bits = filters.bits_for(hit.count())
    slots = filters.bitmap_rows(hit.select(filters.slot(F.xxhash64("hit_id", "hit_key"), bits).alias("slot"))).select(F.col("bucket").alias("b"), "bits")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("key"))
    whole = whole.withColumn("slot", filters.slot(F.xxhash64("id", "key"), bits))
    marked = whole.join(F.broadcast(slots), F.bitmap_bucket_number("slot") == F.col("b"), "left")  # MAX_BITS / 8 bytes at most
    maybe = filters.bit_set(F.col("bits"), F.col("slot"))
    moved = marked.filter(maybe).join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left_anti")
    return marked.filter(~maybe).select("row.*").unionByName(moved.select("row.*"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_WORDS = (
    "list_filter(string_split(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
)
ORACLE = {
    "op6_decontamination": f"""
    WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
    q AS (
      SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM q),
    g AS (
      SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    m AS (SELECT doc_id, item_id, i, q.size FROM g JOIN q ON g.size = q.size AND g.phrase = q.phrase),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
    items AS (
      SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, '{EMPTY_SHA256}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """
}
