"""N-gram Jaccard join by parity sketches: components, or all links, of a rational threshold, exactly.

A document's set is its distinct word n-grams. Documents of equal sets are one node. A node's parity
sketch toggles, for each shingle, one bit of a very wide bit string (its hash), so the Hamming
distance of two sketches is at most the symmetric difference of the sets. Sets of sizes a and b
that reach the threshold differ in at most D = (a + b)(1 - t) / (1 + t) shingles. Size bands fix
D; the sketch of a band's sets is cut into P > D parts, so by the pigeonhole principle two linked
sets have at least P - D equal parts, and parts are kept as a hash of their toggled bits.

1. All parts of all sets are counted over the corpus, pre-aggregated. A set of more than D parts that
   no other set has links with none in that band and drops out; a passage that many documents share
   makes few parts common and so joins none of them.
2. The parts of a set are put in an order that depends on the part alone: those that one set has,
   as a bitmap of bounded size tells, then by the shingles they hold, the most first, then by hash.
   The first of the equal parts of two linked sets is among the first D + 1 of both, so a set with u
   parts of its own is joined on D + 1 - u others. A bitmap that is too full only makes u smaller.
   Parts that the same nodes have stand for each other: one of them stays.
3. Within each remaining part every node is paired with the least node and with the most central
   one, which has most parts in common with others. Pairs are checked by size and by dense parity
   sketches of at least DENSE bits a shingle, then verified on the sets, and linked nodes united
   into components.
4. Parts whose other nodes are still of several components are compared in blocks of bounded size,
   only between components, by short sketches, in rounds. In a round a node proposes its nearest
   few; they are verified and united, and where some block had more to propose a round of more
   follows, without the pairs already verified, until no block holds anything back.
Every pair of nodes that share a part is so either compared or already connected: no link that
matters to a component is lost, and a group of any size gives a round a few pairs a member.

That is for components. jaccard_links compares all nodes of each part after step 2, and so verifies
and returns every link between different sets.

Shingles are compared by 64-bit hashes and sets told apart by 128-bit digests.

Defined cases: null and wordless texts have empty sets and link with nothing; a text of fewer than n
words has one shingle, all its words; a row of null id links only where a row with an id has an equal
set, and names no component; rows that repeat are nodes of equal sets; rows that repeat an id with
other words are judged by their own words; other columns are not read; empty tables give an empty
result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import filters
from tidemark.llm.components import connected_components
from tidemark.llm.textops import FOLD, WordCache, as_bytes, blocks, grams, mix, ragged, signed, small_batches
from tidemark.session import materialize

#: Upper size of each band over its lower one.
BAND = 1.2
#: Bits of the dense sketch that checks pairs, for each shingle; and the fewest of a sketch.
DENSE, LEAST_DENSE = 4, 1024
#: The same of the short sketch that is moved with the members of a part.
SHORT, LEAST_SHORT = 1, 1024
#: Shingles that are cut into parts at a time (or one set), and words whose hashes a task keeps: they
#: bound the memory of a Python worker.
PARTED, WORDS_KEPT = 1 << 17, 100_000
#: A band's sketches are cut into D + 2 parts and one more for each SPARE of D.
SPARE = 6
BLOCK = 2 << 20
#: Nodes of a part that are compared within one task at a time are two blocks of about so many.
CELL = 1024
#: Pairs that a node proposes in the first round of a block, and by how much that grows.
FIRST, GROWTH = 2, 8


class Plan:
    """Size bands, and the parts of each band's sketches, for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def bounds(self, band: int) -> tuple[int, int]:
        while len(self.low) <= band + 1:
            self.low.append(max(self.low[-1] + 1, int(np.ceil(self.low[-1] * BAND))))
        return self.low[band], self.low[band + 1] - 1

    def difference(self, total: int) -> int:
        """The most shingles in which two linked sets of so many shingles together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    @cache  # noqa: B019  lives as long as the task
    def parts(self, band: int) -> tuple[int, int]:
        """(parts, D) of a band."""
        _, high = self.bounds(band)
        d = self.difference(high + high * self.den // self.num)
        return (d + 2 + d // SPARE, d) if d else (0, 0)

    @cache  # noqa: B019
    def bands_of(self, size: int) -> tuple[int, ...]:
        """The bands in which a set of this size looks for partners: its own, and smaller sets'."""
        band = 0
        while self.bounds(band)[1] < size:
            band += 1
        out = [band]
        while band and self.bounds(band - 1)[1] * self.den // self.num >= size:
            band -= 1
            out.append(band)
        return tuple(out)


def shingle_set(words: list[bytes], n: int, words_hash: WordCache) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    got = grams(words_hash.hashes(words), k)[0]
    return np.unique(got if k == n else mix(got + np.uint64(k)))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever the order of its shingles."""
    if not len(shingles):
        return 0, 0
    sums = [mix(shingles ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    both = signed(np.concatenate([mix(x + np.uint64(len(shingles))) for x in sums]))
    return int(both[0]), int(both[1])


def bit_sketch(shingles: np.ndarray, dense: int = DENSE, least: int = LEAST_DENSE) -> bytes:
    """A parity sketch of a power of two of bits; the low bits of a shingle's hash are its place."""
    size = max(least, 1 << int(dense * max(1, len(shingles)) - 1).bit_length())
    bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch as 64-bit words, folded by exclusive or to ``size`` bytes: a parity sketch again."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def may_link(na: int, nb: int, apart: int, num: int, den: int) -> bool:
    """Whether sizes and Hamming distance allow a similarity of num / den."""
    return apart * (den + num) <= (na + nb) * (den - num) and min(na, nb) * den >= max(na, nb) * num


def sets_of(block: pa.Table, n: int, words_hash: WordCache) -> list[np.ndarray]:
    return [shingle_set((t or b"").translate(FOLD).split(), n, words_hash) for t in as_bytes(block["text"])]


def part_keys(sets: list[np.ndarray], plan: Plan) -> list[bytes]:
    """Of each set the hashes of its parts, band after band, within a band the fullest first, then by hash."""
    jobs = [(i, band) for i, s in enumerate(sets) if len(s) for band in plan.bands_of(len(s)) if plan.parts(band)[0]]
    out: list[list[bytes]] = [[] for _ in sets]
    before = np.cumsum([0] + [len(sets[i]) for i, _ in jobs])
    cuts = np.searchsorted(before, np.arange(PARTED, before[-1], PARTED))
    bounds = np.unique(np.concatenate([[0], cuts, [len(jobs)]])).tolist()
    for lo, end in zip(bounds[:-1], bounds[1:], strict=True):
        some = jobs[lo:end]
        counts = np.array([plan.parts(band)[0] for _, band in some], np.int64)
        offsets, owner = ragged(counts)
        h = np.concatenate([sets[i] for i, _ in some])
        job = np.repeat(np.arange(len(some)), [len(sets[i]) for i, _ in some])
        at = offsets[job] + (((h >> np.uint64(32)) * counts[job].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        parity = np.zeros(offsets[-1], np.uint64)
        np.bitwise_xor.at(parity, at, mix(h ^ np.uint64(0x2545F4914F6CDD1D)))
        held = np.bincount(at, minlength=offsets[-1])
        band = np.array([b for _, b in some], np.uint64)[owner]
        place = band * np.uint64(1 << 32) + (np.arange(offsets[-1]) - offsets[owner]).astype(np.uint64)
        key = mix(parity + mix(place) + held.astype(np.uint64))
        key = key[np.lexsort((key, -held, owner))]
        for (i, _), x, y in zip(some, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            out[i].append(key[x:y].tobytes())
    return [b"".join(x) for x in out]


def _rows(source: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, d1, d2, parts): each row's set size and digest, and the parts of each set once a block."""

    def run(batches):
        words_hash, plan = WordCache(most=WORDS_KEPT), Plan(num, den)
        for block in blocks(batches, most=BLOCK):
            sets = sets_of(block, n, words_hash)
            digests = [set_digest(s) for s in sets]
            first = {d: i for i, d in reversed(list(enumerate(digests)))}
            parts: list[bytes | None] = [None] * len(sets)
            for i, x in zip(first.values(), part_keys([sets[i] for i in first.values()], plan), strict=True):
                parts[i] = x or None
            d1, d2 = zip(*digests, strict=True)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": block["doc_id"].combine_chunks(), "n": pa.array([len(s) for s in sets], pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "parts": pa.array(parts, pa.binary())}
            )

    return source.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, parts binary")


def first_common(sizes: list[int], keys: np.ndarray, common: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which key, which set, common parts of that set and band): of each set and band the first D + 1 parts that count.

    ``keys`` are those of ``part_keys``, one set after the other; ``common`` is false where no other set has the part.
    """
    jobs = [(i, *plan.parts(band)) for i, size in enumerate(sizes) for band in plan.bands_of(size) if plan.parts(band)[0]]
    if not jobs:
        return (np.zeros(0, np.int64),) * 3
    which, counts, most = (np.array(x, np.int64) for x in zip(*jobs, strict=True))
    offsets, owner = ragged(counts)
    before = np.concatenate([[0], np.cumsum(common)])
    shared = before[offsets[1:]] - before[offsets[:-1]]
    nth = before[:-1] - before[offsets[:-1]][owner]
    use = np.flatnonzero(common & (nth < (most + 1 - counts + shared)[owner]))
    return use, which[owner[use]], shared[owner[use]]


def _parts(rows: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, shared): the parts that nodes are joined on, of those of the same nodes one."""
    written = rows.filter("parts IS NOT NULL")

    def split(batches):
        for batch in batches:
            for some in range(0, batch.num_rows, 64):
                key, c = np.unique(np.frombuffer(b"".join(batch.column(0).slice(some, 64).to_pylist()), np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": key, "c": c})

    # a set is counted once for each block that has it: what more than one set may have, and no set fewer
    counts = written.select("parts").mapInArrow(split, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter("c > 1").select("key")
    repeated = materialize(counts, "keys")
    bits = filters.bits_for(repeated.count())
    bitmap = filters.to_numpy(filters.bitmap_rows(repeated.select(filters.slot(F.col("key"), bits).alias("slot"))), bits)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        plan = Plan(num, den)
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64)
                use, which, common = first_common(batch.column(0).to_pylist(), keys, filters.probe(shared.value, keys), plan)
                d1, d2 = (batch.column(i).to_numpy()[which] for i in (1, 2))
                yield pa.RecordBatch.from_pydict({"key": signed(keys[use]), "d1": d1, "d2": d2, "shared": pa.array(common, pa.int32())})

    found = written.select("n", "d1", "d2", "parts").mapInArrow(run, "key long, d1 long, d2 long, shared int").distinct()
    parts = materialize(found.join(nodes.select("node", "d1", "d2"), ["d1", "d2"]).select("key", "node", "shared"), "parts")
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
    groups = parts.groupBy("key").agg(F.count("*").alias("c"), *same).filter("c > 1")
    one = materialize(groups.groupBy("s1", "s2", "c").agg(F.min("key").alias("key")).select("key"), "keys")
    return materialize(parts.join(one, "key"), "parts")


def _alive(source: DataFrame, parts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, n, sketch, short, shingles) of the nodes that share a part. Only those move."""
    wanted = materialize(parts.select("node").distinct().join(nodes, "node").select("node", "doc", "d1", "d2"), "wanted")
    bits = filters.bits_for(wanted.count())
    hashed = filters.slot(F.xxhash64("doc"), bits)
    bitmap = filters.to_numpy(filters.bitmap_rows(wanted.select(hashed.alias("slot"))), bits)
    shared = source.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        words_hash = WordCache(most=WORDS_KEPT)
        few = (batch.filter(pa.array(filters.probe(shared.value, batch.column(1).to_numpy()))) for batch in batches)
        for block in blocks(few, most=BLOCK):
            sets = sets_of(block, n, words_hash)
            d1, d2 = zip(*map(set_digest, sets), strict=True)
            yield pa.RecordBatch.from_pydict(
                {"d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([bit_sketch(s) for s in sets], pa.binary()), "short": pa.array([bit_sketch(s, SHORT, LEAST_SHORT) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
            )

    likely = source.filter("doc_id IS NOT NULL").select("text", F.xxhash64("doc_id").alias("h"))
    sets = likely.mapInArrow(run, "d1 long, d2 long, n long, sketch binary, short binary, shingles binary")
    return materialize(wanted.select("node", "d1", "d2").join(sets, ["d1", "d2"]).drop("d1", "d2").dropDuplicates(["node"]), "sets")


def _close_enough(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link by size and sketch."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                size = min(len(sa), len(sb))
                keep.append(may_link(na, nb, int(np.bitwise_count(folded(sa, size) ^ folded(sb, size)).sum()), num, den))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("shingles").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _nearest(cell: pa.Table, num: int, den: int, most: int) -> list[np.ndarray]:
    """(a, b, more) for two blocks of a part: for each node of the first its ``most`` nearest of the second.

    more tells that the node had others to propose.
    """
    node, comp, size, mine = (cell[c].to_numpy() for c in ("node", "component", "n", "mine"))
    i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    if not len(left) or not len(right) or (comp == comp[0]).all():
        return []
    raw = cell["short"].to_pylist()
    width = min(map(len, raw))
    sketch = np.array([folded(x, width) for x in raw])  # sizes in a part are alike
    out = []
    for x in left:
        y = right[(comp[right] != comp[x]) & ((node[right] > node[x]) | (i != j))]
        y = y[np.minimum(size[y], size[x]) * den >= np.maximum(size[y], size[x]) * num]
        apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        ok = apart * (den + num) <= (size[y] + size[x]) * (den - num)
        y, apart = y[ok], apart[ok]
        if len(y):
            near = y[np.lexsort((node[y], apart))[:most]]
            out.append(np.stack([np.minimum(node[x], node[near]), np.maximum(node[x], node[near]), np.full(len(near), len(y) > most)]))
    return out


def _cells(rest: DataFrame, nodes: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Pairs (a, b, more) of nodes that share a key but no component and may link by size and short sketch.

    Large parts are compared block against block; a task holds one pair of blocks at a time.
    """
    sized = materialize(rest.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")), "sizes")
    placed = rest.join(sized, "key").join(nodes.select("node", "n", "short"), "node")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), F.col("cells")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    grouped = spread.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component", "n", "short", "mine")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            where = [table[c].to_numpy() for c in ("key", "i", "j")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in where], axis=0)) + 1
            bounds = [0, *cuts.tolist()]
            held = table.slice(bounds[-1])
            yield from pairs_of(table.slice(lo, hi - lo) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True))
        if held is not None and held.num_rows:
            yield from pairs_of([held])

    def pairs_of(cells):
        found = [x for cell in cells for x in _nearest(cell, num, den, most)]
        if found:
            a, b, more = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "more": more > 0})

    placed = grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def node_components(parts: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) for the nodes linked with another; ``nodes`` as of ``_alive``."""
    central = F.max(F.struct("shared", "node"))["node"].alias("hub")
    # written, so that the join has an exchange on either side and Spark can split a large part
    ends = materialize(parts.groupBy("key").agg(F.min("node").alias("lo"), central), "ends")
    spans = materialize(parts.select("key", "node").join(ends, "key"), "spans")
    star = spans.filter("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    star = star.unionByName(spans.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct()
    tried = materialize(_close_enough(star, nodes, num, den), "pairs")
    links = materialize(_verify(tried, nodes, num, den), "links")
    found, most = connected_components(links), FIRST
    # parts whose nodes, apart from the two that all were paired with, are of several components
    inner = spans.filter("node <> lo AND node <> hub").select("key", "node")
    while True:
        inner = inner.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = materialize(inner.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key"), "mixed")
        rest = materialize(inner.join(mixed, "key"), "rest")
        if rest.isEmpty():
            return found
        near = materialize(_cells(rest, nodes, num, den, most), "near")
        fresh = materialize(_close_enough(near.join(tried, ["a", "b"], "left_anti"), nodes, num, den), "pairs")
        more = materialize(_verify(fresh, nodes, num, den), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            found = connected_components(links)
        if near.filter("more").isEmpty():
            return found
        tried, most, inner = tried.unionByName(fresh), most * GROWTH, rest.select("key", "node")


def _sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, parts, alive): what each row's set is, the distinct sets that aren't empty, and what may link."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(_rows(source, n, num, den), "rows")
    distinct = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, as written
    parts = _parts(rows, nodes.filter("doc IS NOT NULL"), num, den)
    return rows, nodes, parts, _alive(source, parts, nodes, n)


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b), a <= b: every link between different sets, each by its least id (a = b where rows of one id differ).

    All pairs of nodes that share a part are compared, whatever links them already, so a group of k
    linked sets takes k^2 comparisons. Sets that only rows of null id have are left out.
    """
    _, nodes, parts, alive = _sets(docs, n, num, den, id_col, text)
    apart = parts.select("key", "node", F.col("node").alias("component"))  # each node on its own: none is skipped
    near = materialize(_cells(apart, alive, num, den, 1 << 62).select("a", "b"), "near")
    links = _verify(materialize(_close_enough(near, alive, num, den), "pairs"), alive, num, den)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("doc").alias(f"doc_{x}"))
    named = links.join(side("a"), "a").join(side("b"), "b")
    return named.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))


def _components(docs: DataFrame, n: int, num: int, den: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, d1, d2), a row for each row of ``docs``."""
    rows, nodes, parts, alive = _sets(docs, n, num, den, id_col, text)
    found = node_components(parts, alive, num, den)
    named = materialize(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    # written, like the sets below, so that Spark can split a large component or set in the join
    least = materialize(named.groupBy("component").agg(F.min("doc").alias("component_id")), "least")
    by_set = materialize(named.join(least, "component").select("d1", "d2", "component_id"), "named")
    linked = rows.filter("n > 0").select("doc_id", "n", "d1", "d2").join(by_set, ["d1", "d2"])
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "d1", "d2")
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "d1", "d2"]
    return linked.select(*cols).unionByName(empty.select(*cols))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    return _components(docs, n, num, den, id_col, text).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that have the least id of their component, and those in none.

    Of rows that repeat id and words all stay if one does: exact deduplication comes first. Rows that
    can't go pass straight through; only those of an id that goes are moved.
    """
    gone = _components(docs, n, num, den, id_col, text).filter("doc_id <> component_id").select("doc_id", "d1", "d2").distinct()
    gone = materialize(gone, "gone")
    bits = filters.bits_for(gone.count())
    bitmap = filters.to_numpy(filters.bitmap_rows(gone.select(filters.slot(F.xxhash64("doc_id"), bits).alias("slot"))), bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    ident = F.col(id_col).cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("doc_id"), F.col(text).alias("text"), F.xxhash64(ident).alias("h"))

    def rows(maybe: bool):
        """Rows whose id may go, with their set's digest, or all the others."""

        def run(batches):
            words_hash = WordCache(most=WORDS_KEPT)
            for batch in batches:
                hit = filters.probe(shared.value, batch.column(3).to_numpy())
                some = batch.filter(pa.array(hit == maybe))
                if some.num_rows and maybe:
                    d1, d2 = zip(*map(set_digest, sets_of(pa.Table.from_batches([some]), n, words_hash)), strict=True)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], names=["row", "doc_id", "d1", "d2"])
                elif some.num_rows:
                    yield some.select([0])

        kind = T.StructType([T.StructField("row", T.StructType(docs.schema.fields))])
        return whole.mapInArrow(run, T.StructType([*kind.fields, *(T.StructField(c, T.LongType()) for c in ("doc_id", "d1", "d2"))]) if maybe else kind)

    return rows(False).select("row.*").unionByName(rows(True).join(gone, ["doc_id", "d1", "d2"], "left_anti").select("row.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


ORACLE = {
    "op10_jaccard_join": """
    WITH RECURSIVE d AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n
    """
}
