"""Corpus operators against SQL or brute force, and their defined cases: nulls, empty and repeated rows, empty tables."""

import hashlib
import io
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import decontam, exact_dedup, jaccard_join, langid, lm_score, mixing, quality, queries, substring_dedup, toxicity, warc
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row struct<id:int>, digest string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, (1,), "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, ties, repeated rows, a very long text and clashing names."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return frame(spark, [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (6, long_text), (7, long_text), (8, "ÀB c")])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.execute(queries.ORACLES[name]))


def test_exact_dedup_cases(spark, odd):
    got = {(r["id"], r["kept"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(odd).collect()}
    assert got[2, True] == (2, 2) and got[1, False] == (2, 2)
    assert got[5, True] == (5, 4) and got[4, False] == (5, 4) and got[None, False] == (5, 4)
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7, 8]
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 29])
def test_exact_dedup_with_a_full_filter(spark, monkeypatch, bits):
    """20,000 texts against brute force, where a filter of one block is far too full and where it isn't."""
    monkeypatch.setattr(exact_dedup, "MAX_BITS", bits)
    texts = [(i, f"Text {i % 15_000 if i % 3 else 0}") for i in range(20_000)] + [(None, "text 0"), (None, "alone"), (19_999, "text 4999")]
    docs = frame(spark, texts).repartition(7)
    best = {}
    for i, t in texts:
        best[t.lower()] = max(best.get(t.lower(), -1), -1 if i is None else i)
    kept = [(r["text"].lower(), -1 if r["doc_id"] is None else r["doc_id"]) for r in exact_dedup.exact_dedup(docs).select("doc_id", "text").collect()]
    assert dict(kept) == best and len(kept) == len(best)
    hashed = exact_dedup.materialize(exact_dedup.digests(docs), "digests")
    maybe = exact_dedup.probed(hashed, exact_dedup.repeated_slots(hashed)).filter("__maybe").count()
    repeats = sum(n for n in Counter(t.lower() for _, t in texts).values() if n > 1)
    assert repeats <= maybe and (bits < 1 << 20 or maybe < 1.02 * repeats)


def test_mixing_rates_and_cases(spark):
    docs = frame(spark, [(i, "t") for i in range(2000)]).selectExpr("doc_id", "text", "if(doc_id < 1500, 'a', if(doc_id < 1990, 'b', null)) AS source")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    counts = dict(map(tuple, mixing.mix_sources(docs, weights, 4000).groupBy("source").count().collect()))
    assert set(counts) == {"a", "b"} and abs(counts["a"] - 1000) < 120 and abs(counts["b"] - 3000) < 200
    one = spark.createDataFrame([(None, 1.0)], "source string, weight double")  # a mean of 1000 a document
    assert abs(mixing.mix_sources(docs, one, 10_000).count() - 10_000) < 500
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs.withColumnRenamed("text", "copy"))


def test_mixing_rare_source_nulls_and_repeats(spark):
    """A mean of 400,000 for one document, a null id, and rows that repeat an id."""
    docs = spark.createDataFrame([(1, "rare"), (2, "a"), (2, "a"), (None, "a")], "doc_id long, source string")
    weights = spark.createDataFrame([("rare", 4.0), ("a", 0.00003)], "source string, weight double")
    got = mixing.mix_sources(docs, weights, 400_000).groupBy("doc_id").agg({"copy": "max", "*": "count", "shuffle_key": "count"}).collect()
    n = {r["doc_id"]: (r["count(1)"], r["max(copy)"]) for r in got}
    assert n[1][0] == n[1][1] and abs(n[1][0] - 400_000) < 5000
    assert 2 not in n or n[2][0] == 2 * n[2][1]  # both rows have the same count


def brute_repeats(texts, window):
    seen, out = set(), {}
    for i, t in sorted(texts):
        words = (t or "").encode().split()
        gone = set()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if key in seen:
                gone.update(range(at, at + window))
            seen.add(key)
        out[i] = " ".join(w.decode() for at, w in enumerate(words) if at not in gone)
    return out


@pytest.mark.parametrize("window", [3, 8, 12])
def test_substring_dedup_brute_force(spark, window):
    draw = random.Random(window)
    texts = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(60)))) for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(frame(spark, texts), window).collect()}
    assert got == brute_repeats(texts, window)


@pytest.mark.parametrize("window,group", [(3, 20_000), (8, 20_000), (12, 2)])
def test_maximal_repeats_brute_force(spark, monkeypatch, window, group):
    """Also where all groups but the smallest get longer prefixes."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    draw = random.Random(window)
    texts = [(i, " ".join(draw.choice("ab") for _ in range(draw.randrange(50)))) for i in range(30)]
    texts += [(30 + i, t) for i, t in texts[:4]]
    first, want = {}, []
    for i, t in texts:
        words, open_ = t.split(), None
        for at in range(len(words) - window + 1):
            there = first.setdefault(tuple(words[at : at + window]), (i, at))
            if there == (i, at):
                open_ = None
            elif open_ and there == (open_[3], open_[4] + at - open_[1]):
                open_[2] += 1
            else:
                open_ = [i, at, window, *there]
                want.append(open_)
    want = sorted(map(tuple, want))
    found = substring_dedup.maximal_repeats(frame(spark, texts), window)
    assert sorted(map(tuple, found.collect())) == want and want
    assert {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(frame(spark, texts), window).collect()} == brute_repeats(texts, window)


def test_suffix_tree_against_sorting():
    draw = random.Random(2)
    runs = [" ".join(draw.choice("ab") for _ in range(draw.randrange(4, 30))).encode() for _ in range(40)]
    tree = substring_dedup.SuffixTree(runs, 4)
    ends = np.repeat(tree.offsets[1:], np.diff(tree.offsets))
    words = [w for r in runs for w in r.split()]
    got = [words[i : ends[i]] for i in tree.suffixes]
    assert len(got) == sum(len(r.split()) - 3 for r in runs)
    for x, y, lcp in zip(got[:-1], got[1:], tree.lcp.tolist(), strict=True):
        assert x[:lcp] == y[:lcp] and x[lcp : lcp + 1] != y[lcp : lcp + 1] or lcp == min(len(x), len(y))
    node = tree.nodes(6)
    assert all((x[:6] == y[:6] and len(x) > 5 and len(y) > 5) == (a == b) for (x, a), (y, b) in zip(list(zip(got, node))[:-1], list(zip(got, node))[1:], strict=True))


def test_substring_dedup_removes_a_rows_own_words(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = sorted((r["doc_id"], r["kept"]) for r in substring_dedup.remove_repeats(frame(spark, [(1, a), (2, a), (2, b)])).collect())
    assert got == [(1, a), (2, ""), (2, b)]


def test_substring_dedup_cases(spark, odd):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(odd, 20).collect()}
    assert got[1] == (0, 0) and got[6] == (30_000, 0) and got[7] == (30_000, 30_000) and got[5] == (2, 0)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_warc_cases_and_zip64(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a", ""), (3, "http://b", "é"), (None, "http://c", "é"), (4, "u\nv", "é")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}")).collect()}
    assert got == {1: ("revisit", 2, 0), 2: ("response", None, 0), 3: ("revisit", 4, 2), None: ("revisit", 4, 2), 4: ("response", None, 2)}
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")).count() == 0
    out = io.BytesIO()
    packed = warc.ZipWriter(out)
    packed.begin("m")
    packed.write(b"0123456789")
    packed.end()
    packed.close(force64=True)
    assert zipfile.ZipFile(io.BytesIO(out.getvalue())).read("m") == b"0123456789"

    class Source:
        size = lambda self: len(out.getvalue())
        read_at = lambda self, n, at: out.getvalue()[at : at + n]

    reader = warc.ZipReader(Source())
    assert reader.range(reader.members["m"], 3, 4) == b"3456"


def test_decontamination_cases(spark, odd):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, "!!"), (4, "two one two")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["hits"], r["items"]) for r in decontam.contamination(odd, bench).collect()}
    assert got[5] == (2, [0, 1], ["1"]) and got[1] == (0, [], []) and got[8] == (2, [], [])
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 6
    assert decontam.contamination(odd, bench.limit(0)).count() == odd.count() and decontam.contamination(odd.limit(0), bench).count() == 0
    near = decontam.matches(frame(spark, [(1, "x one big two y")]), bench, slop=1).collect()
    assert [(r["item_id"], r["start"], r["end"], r["kind"]) for r in near] == [("1", 1, 3, "near")]


def test_decontamination_few_phrases_at_a_time(spark, monkeypatch, sf_dir, tmp_path):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(decontam.contamination(docs, bench).collect())
    monkeypatch.setattr(decontam, "PHRASES", 7)
    assert sorted(decontam.contamination(docs, bench).collect()) == whole
    decontam.build_index(docs, path=f"{tmp_path}/index")
    kept = decontam.open_index(spark, f"{tmp_path}/index")  # an index that was stored is searched without the texts
    phrases, _ = decontam._windows(bench, 10, "item_id", "text")
    got = decontam.occurrences(kept, phrases).select("doc_id", "n_words", "hits")
    assert sorted(got.collect()) == sorted((r["doc_id"], r["n_words"], r["hits"]) for r in whole)


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_matches_brute_force(spark, slop):
    draw = random.Random(slop)
    texts = [(i, " ".join(draw.choice("abcd") for _ in range(draw.randrange(25)))) for i in range(30)]
    items = [(str(i), " ".join(draw.choice("abcd") for _ in range(n))) for i, n in enumerate([1, 2, 3, 3, 4, 5])]
    want = []
    for i, t in texts:
        w = t.split()
        for name, item in items:
            q = item.split()
            for k in range(max(1, len(q) - 2)):
                p = q[k : k + 3]
                ends = {}
                for b in range(len(w)):  # the earliest end of a match from each begin, and the latest begin for each end
                    if w[b] != p[0]:
                        continue
                    e = b
                    for x in p[1:]:
                        e = next((j for j in range(e + 1, len(w)) if w[j] == x), len(w))
                        if e == len(w):
                            break
                    if e < len(w):
                        ends[e] = b
                exact = [b for b in range(len(w)) if w[b : b + len(p)] == p]
                want += [(i, name, k, b, b + len(p) - 1, "exact") for b in exact]
                want += [(i, name, k, b, e, "near") for e, b in ends.items() if slop and b not in exact and e - b + 1 - len(p) <= slop]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert sorted(map(tuple, decontam.matches(frame(spark, texts), bench, 3, slop).collect())) == sorted(want) and want


def test_decontamination_odd_items(spark, odd):
    bench = spark.createDataFrame([(None, "one two"), (None, "two"), ("b", "one"), ("a,b", None)], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in decontam.contamination(odd, bench).collect()}
    assert got[4] == ["b", None] and got[2] == []
    kept = decontam.decontaminate(odd.withColumnsRenamed({"row": "key", "digest": "bits"}), bench)
    assert kept.columns[-2:] == ["key", "bits"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6, 7, 8]
    assert decontam.decontaminate(odd, bench.limit(0)).count() == odd.count() and decontam.decontaminate(odd.limit(0), bench).count() == 0


def brute_components(texts, n, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))} if w else set()
    comp = {i: i for i in sets}
    find = lambda i: i if comp[i] == i else find(comp[i])
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            common = len(sets[x] & sets[y])
            if x < y and common and den * common >= num * (len(sets[x]) + len(sets[y]) - common):
                a, b = sorted((find(x), find(y)))
                comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_brute_force(spark, n, num):
    draw = random.Random(num)
    texts = []
    for _ in range(12):
        words = [f"w{draw.randrange(40)}" for _ in range(draw.choice([1, 2, 12, 40, 90, 200]))]
        for _ in range(draw.randrange(1, 8)):
            texts.append((len(texts), " ".join(words)))
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = f"z{draw.randrange(40)}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts), n, num, 100).collect()}
    assert got == brute_components(texts, n, num, 100)


def test_jaccard_in_small_blocks_and_rounds(spark, monkeypatch):
    """A large group of near copies, edited lightly to heavily, whose parts take several blocks and rounds."""
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    monkeypatch.setattr(jaccard_join, "FIRST", 1)
    monkeypatch.setattr(jaccard_join, "GROWTH", 3)
    draw = random.Random(4)
    base, texts = [f"w{i}" for i in range(60)], []
    for i in range(150):
        words = list(base)
        for _ in range(draw.randrange(1, 10)):
            words[draw.randrange(60)] = f"z{draw.randrange(4)}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts), 3, 80, 100).collect()}
    want = brute_components(texts, 3, 80, 100)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_jaccard_links_are_all_there(spark, monkeypatch):
    """Also within a group that is one component: its links aren't only those that hold it together."""
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    draw = random.Random(9)
    base, texts = [f"w{i}" for i in range(60)], []
    for i in range(60):
        words = list(base)
        for _ in range(draw.randrange(1, 5)):
            words[draw.randrange(60)] = f"z{draw.randrange(4)}"
        texts.append((i, " ".join(words)))
    texts += [(60 + i, t) for i, t in texts[:5]] + [(90, "one two"), (91, None)]
    sets = {}
    for i, t in texts:
        w = (t or "").split()
        s = frozenset(zip(*(w[k:] for k in range(min(3, len(w)))), strict=False))
        sets.setdefault(s, i)
    ids = [(i, s) for s, i in sets.items() if s]
    want = sorted((x, y) for x, p in ids for y, q in ids if x < y and 100 * len(p & q) >= 80 * len(p | q))
    got = sorted(map(tuple, jaccard_join.jaccard_links(frame(spark, texts), 3, 80, 100).collect()))
    assert got == want and len(want) > 300


def test_jaccard_large_group_without_links(spark):
    """5,000 copies of a template, each with words of its own: too far apart from each other by a little."""
    draw = random.Random(6)
    texts = []
    for i in range(5000):
        words = [f"w{k}" for k in range(80)]
        for at in draw.sample(range(2, 78, 3), 4):
            words[at] = f"own{i}x{at}"
        texts.append((i, " ".join(words)))
    near = list(texts[7][1].split())
    near[0] = "z"
    texts.append((5000, " ".join(near)))
    got = jaccard_join.jaccard_components(frame(spark, texts), 3, 80, 100).filter("doc_id <> component_id").collect()
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(5000, 7)]


def test_jaccard_keeps_other_texts_of_an_id(spark):
    """A row goes for its own words, not for those of another row with its id."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = frame(spark, [(1, a), (2, a + " more"), (2, b), (3, None), (None, a + " more")])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in jaccard_join.keep_one_of_each(docs).collect()) == sorted([(1, a), (2, b), (3, ""), (0, a + " more")])


def test_jaccard_cases(spark, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd).collect()}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[4] == got[5] == (1, 4) and got[7] == (29_996, 6)
    kept = jaccard_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and {4, 6} <= {r["doc_id"] for r in kept.collect()}
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def _held_out(spark, sf_dir, query, label):
    got = {r["doc_id"]: r for r in query(spark, sf_dir).collect()}
    pairs = [(got[d]["predicted"], y) for d, y in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label).collect() if got[d]["held_out"]]
    return np.mean([p == y for p, y in pairs])


def test_classifiers_on_held_out_rows(spark, sf_dir):
    bigger = sf_dir.replace("sf0.001", "sf0.01")
    assert _held_out(spark, bigger, quality.op2_quality, "quality") > 0.95
    assert _held_out(spark, bigger, toxicity.op9_toxicity, "toxic") > 0.9
    found = langid.op8_langid(spark, bigger).join(spark.read.parquet(f"{bigger}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97


def test_classifier_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {0.5}
    with pytest.raises(ValueError):  # rather than to keep or drop a whole corpus unjudged
        toxicity.reject_toxic(odd, none)
    assert toxicity.reject_toxic(odd.limit(0), none).count() == 0
    vectors, net = quality.train(odd, none)
    assert quality.score(odd, vectors, net).count() == odd.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, langid.profiles(odd)).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert langid.identify(odd, {}).filter("lang_pred = 'und'").count() == odd.count()


def test_classifiers_on_empty_tables(spark, odd):
    empty = odd.limit(0)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0
    vectors, net = quality.train(empty, none)
    assert quality.score(empty, vectors, net).count() == 0
    assert langid.identify(empty, langid.profiles(empty)).count() == 0


def test_langid_brute_force(spark):
    """Profiles and out-of-place distances by plain dictionaries."""
    draw = random.Random(3)
    words = {"en": ["the", "and", "house", "of"], "de": ["der", "und", "Häuser", "von"], "fr": ["les", "et", "maisons", "où"]}
    rows = [(i, " ".join(draw.choice(words[n]) + draw.choice([".", ",", ""]) for _ in range(draw.randrange(12))), n) for i in range(40) for n in ["en", "de", "fr"]]
    docs = spark.createDataFrame([(3 * i + k, t, n) for k, (i, t, n) in enumerate(rows)], "doc_id long, text string, lang string")

    def ranked(texts):
        counts = {}
        for text in texts:
            runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
            for w in runs:
                for g in [*w] + [a + b for a, b in zip(f" {w}", f"{w} ", strict=True)] + [f" {w} "[i : i + 3] for i in range(len(w))]:
                    counts[g] = counts.get(g, 0) + 1
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.PROFILE]

    profile = {n: ranked([" ".join(t for _, t, m in rows if m == n)]) for n in words}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.profiles(docs)).collect()}
    for k, (i, t, _) in enumerate(rows):
        top = ranked([t])
        apart = {n: sum(abs(p.index(g) - r) if g in p else langid.PROFILE for r, g in enumerate(top)) for n, p in sorted(profile.items())}
        best = min(apart, key=apart.get)
        name, score = got[3 * i + k]
        assert (name, round(score, 9)) == (("und", 0.0) if not top else (best, round(1 - apart[best] / (langid.PROFILE * len(top)), 9)))


def test_toxicity_brute_force(spark):
    """FTRL-proximal by a loop over single coordinates, in dictionaries."""
    draw = random.Random(5)
    texts = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 9)))) for i in range(60)]
    labels = [(i, int("a b" in t or "c" in t)) for i, t in texts]
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    learned = toxicity.labelled_rows(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", 100).orderBy("id").collect()
    alpha, beta, l1 = 2.0, 1.0, 4.0
    z, n, b, nb = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha)
    order, cache = np.random.default_rng(11), toxicity.WordCache()
    rows = [(sorted(set(toxicity.features([r["text"].encode()], cache)[0].tolist())), r["y"]) for r in learned]
    for _ in range(6):
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            w, w0 = {i: weight(i) for i in at}, -b / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-(sum(w.values()) + w0))) - y
            for i in at:
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
            s = ((nb + g * g) ** 0.5 - nb**0.5) / alpha
            b, nb = b + g - s * w0, nb + g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert set(model[0].tolist()) == set(want) and 0 < len(want) < len(z)
    assert all(abs(want[i] - w) < 1e-4 for i, w in zip(model[0].tolist(), model[1].tolist(), strict=True))
    assert abs(model[2] + b / ((beta + nb**0.5) / alpha)) < 1e-6
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, texts), model).collect()}
    for i, t in texts:
        logit = sum(want.get(k, 0.0) for k in set(toxicity.features([t.encode()], cache)[0].tolist())) + model[2]
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-4


def test_quality_brute_force(spark, odd):
    """Word vectors and pooling by loops over words; the network's gradient by finite differences of its loss."""
    texts = [(1, "a b c a d"), (2, "b b a"), (3, "c d e f a b"), (4, None), (5, "a")]
    docs = frame(spark, texts)
    plus, minus = quality.index_vectors()
    bucket = lambda w: xxhash.xxh64_intdigest(w) % quality.BUCKETS
    sums = {}
    for _, t in texts:
        w = [bucket(x) for x in (t or "").split()]
        for i in range(len(w)):
            for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                if i != j:
                    v = sums.setdefault(w[i], np.zeros(quality.DIM))
                    v[plus[w[j]]] += 1
                    v[minus[w[j]]] -= 1
    vectors = quality.word_vectors(docs)
    unit = {}
    for k, v in sums.items():
        v = np.sign(v) * np.log1p(np.abs(v))
        unit[k] = v / max(np.linalg.norm(v), 1e-9)
        assert np.allclose(vectors[k], unit[k], atol=1e-6)
    assert not np.delete(vectors, list(sums), axis=0).any()
    pooled = quality.pool([(t or "").encode() for _, t in texts], vectors, quality.WordCache())
    for (_, t), got in zip(texts, pooled, strict=True):
        v = [unit.get(bucket(w), np.zeros(quality.DIM)) for w in (t or "").split()]
        if not v:
            assert not got.any()
            continue
        mean = sum(v) / len(v)
        spread = np.sqrt(np.maximum(sum(x * x for x in v) / len(v) - mean**2, 0))
        beside = sum((x * y for x, y in zip(v[:-1], v[1:], strict=True)), np.zeros(quality.DIM)) / len(v)
        assert np.allclose(got, np.concatenate([mean, spread, beside, [np.log1p(len(v))]]), atol=2e-3)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no single plane parts the classes
    net = quality.fit_network(x, y)
    assert np.mean((net.probability(x) > 0.5) == (y > 0.5)) > 0.9 and 0.25 <= net.temperature <= 8
    loss = lambda t: np.mean(np.logaddexp(0, net.logit(x[240:]) / t) - y[240:] * net.logit(x[240:]) / t)
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 60))


def test_lm_beats_shuffled_words(spark):
    draw = random.Random(1)
    texts = [(i, " ".join(draw.choice(["a b c d", "e f g h"]) for _ in range(100))) for i in range(600)]
    mixed = [(1000 + i, " ".join(draw.sample(t.split(), len(t.split())))) for i, t in texts[:20]]
    got = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(frame(spark, texts + mixed + [(5000, None)])).collect()}
    mean = lambda ids: np.mean([got[i]["mean_log_prob"] for i, _ in ids])
    assert mean(texts) > mean(mixed) + 0.2
    assert got[5000]["n_words"] == 0 and got[5000]["log_prob"] == 0 and got[5000]["mean_log_prob"] is None


def test_lm_tells_words_of_like_hashes_apart(spark):
    """A word that occurs once isn't as likely as a frequent one whose hash ends in the same 16 bits."""
    end = lambda w: xxhash.xxh64_intdigest(w) & 0xFFFF
    rare = next(w for w in (f"w{i}" for i in range(1_000_000)) if end(w) == end("often"))
    texts = [(i, "often") for i in range(300)] + [(300 + i, f"x{i}") for i in range(300)] + [(1000, rare)]
    got = {r["doc_id"]: r["log_prob"] for r in lm_score.pseudo_likelihood(frame(spark, texts)).collect()}
    assert got[0] > got[1000] + 1 and abs(got[1000] - np.mean([got[300 + i] for i in range(300)])) < 1


def test_lm_learns_every_word(spark):
    """Copies of one short text are all targets, so half of the words being the same one is learnt."""
    texts = [(i, "often") for i in range(300)] + [(300 + i, f"x{i}") for i in range(300)]
    got = {r["doc_id"]: r["log_prob"] for r in lm_score.pseudo_likelihood(frame(spark, texts)).collect()}
    assert got[0] > -3


def test_lm_does_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm_score, "UNIT", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few, many = ({r["doc_id"]: r["log_prob"] for r in lm_score.pseudo_likelihood(docs.repartition(n)).collect()} for n in (4, 32))
    assert few.keys() == many.keys() and max(abs(few[i] - many[i]) for i in few) < 1e-6


def test_lm_brute_force_and_held_out(spark, sf_dir, monkeypatch):
    """Scores by plain loops over words, and a likelihood of unseen documents above that of word counts."""
    monkeypatch.setattr(lm_score, "FREQUENT", 500)  # so that many words are not frequent
    bigger = sf_dir.replace("sf0.001", "sf0.01")
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{bigger}/documents.parquet").dropDuplicates(["text"]).orderBy("doc_id").collect()]
    seen, unseen = [r for r in rows if r[0] % 5], [r for r in rows if r[0] % 5 == 0]
    model, units = lm_score.fit(frame(spark, seen))
    counts, lexicon, net = {}, model.lexicon, model.net
    for _, t in seen:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values()) + len(counts) + lm_score.CELLS
    h = lambda w: xxhash.xxh64_intdigest(w)
    leaf = lambda w: int(lexicon.leaves(np.array([h(w)], np.uint64))[0][0])
    mass = dict.fromkeys(range(lm_score.LEAVES), 0)
    for w, c in counts.items():
        mass[leaf(w)] += c + 1
    for cell in range(lm_score.CELLS):
        mass[int(lexicon.first + cell * (lm_score.LEAVES - lexicon.first) // lm_score.CELLS)] += 1
    assert [mass[i] for i in range(lm_score.LEAVES)] == lexicon.mass.tolist() and len(lexicon.h) <= 500 < len(counts)
    p = [x.astype(float) for x in net.p]
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def brute(words):
        out = 0.0
        for i, w in enumerate(words):
            x = np.concatenate([p[0][h(words[j]) % lm_score.SHARED if 0 <= j < len(words) else lm_score.SHARED] for j in (i - 2, i - 1, i + 1, i + 2)])
            hidden, (b, t) = np.tanh(x @ p[1] + p[2][0]), divmod(leaf(w), lm_score.BRANCHES)
            out += np.log(softmax(hidden @ p[3] + p[4][0])[b]) + np.log(softmax(hidden @ p[5] + p[6][b])[t]) + np.log((counts.get(w, 0) + 1) / mass[leaf(w)])
        return out

    got = {r["doc_id"]: r["log_prob"] for r in model.score(frame(spark, unseen)).collect()}
    for i, t in unseen[:10]:
        assert abs(got[i] - brute(t.split())) < 1e-3 * max(1, len(t.split()))
    by_count = sum(np.log((counts.get(w, 0) + 1) / total) for _, t in unseen for w in t.split())
    n = sum(len(t.split()) for _, t in unseen)
    print("held out, a word:", sum(got.values()) / n, by_count / n)
    assert sum(got.values()) / n > by_count / n + 0.02


def test_lm_on_an_empty_table(spark, odd):
    assert lm_score.pseudo_likelihood(odd.limit(0)).count() == 0
    got = {r["doc_id"]: (r["n_words"], r["mean_log_prob"]) for r in lm_score.pseudo_likelihood(odd).collect()}
    assert got[1] == (0, None) and got[6][0] == 30_000 and got[6] == got[7] and got[None][0] == 2


def test_pipeline_stages_on_empty_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()
    with pytest.raises(ValueError):
        corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_pipeline_rejects_toxic_documents(spark, sf_dir):
    import corpus_pipeline

    bigger = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{bigger}/documents.parquet")
    kept = {r[0] for r in corpus_pipeline.drop_toxic(spark, docs, bigger).select("doc_id").collect()}
    labels = [(d, y) for d, y in spark.read.parquet(f"{bigger}/labels.parquet").select("doc_id", "toxic").collect()]
    gone = np.mean([d not in kept for d, y in labels if y == 1])
    clean = np.mean([d in kept for d, y in labels if y == 0])
    assert gone > 0.8 and clean > 0.8


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0, name
        docs = corpus_pipeline.materialize(out, name)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(i == c for i, (_, c) in brute_components(texts, 5, 80, 100).items())
    assert len({hashlib.sha256(t.encode()).digest() for _, t in texts}) == len(texts)
    assert corpus_pipeline.mix(spark, docs, sf_dir).join(docs, "doc_id", "left_anti").count() == 0
