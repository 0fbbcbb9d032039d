"""Top-k search, spelling variants and collocations against brute force, with their defined edge cases."""

import math
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import collocations, impact_search, queries, spelling
from faultline.llm.shared import FREE_SHUFFLES, Scratch

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]


def nearest(rows, k, asks):
    """(query id, rank, id, score) by comparing every pair; rows are (id, list of numbers or None)."""
    fine = [(i, v, [math.floor(64 * c) for c in x]) for i, (v, x) in enumerate(rows) if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, q, x in fine:
        if q is not None and asks(q):
            scores = [(-sum(a * b for a, b in zip(x, y, strict=False)), v is None, v or 0, j, v) for j, v, y in fine if j != i]
            out += [(q, rank, s[4], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(spark, rows, k, every, scratch, *sizes):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, uid int, shard int, block int")
    vectors = frame.select("vec_id", impact_search.whole_numbers().alias("x"))
    return Counter(tuple(r) for r in impact_search.search(vectors, F.col("vec_id") % every == 0, k, scratch, *sizes).collect())


@pytest.mark.parametrize("sizes", [(16_384, 4_096), (40, 5)])
def test_search_finds_what_all_pairs_find(spark, scratch, sizes):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(scale=0.2, size=8)).tolist()) for i in range(200)]
    rows += [(500 + i, rows[0][1]) for i in range(100)]  # a third are one vector
    rows += [(None, rows[0][1]), (0, rows[0][1]), (700, None), (705, [1.0, None]), (710, [float("nan")]), (715, [float("inf")]), (720, []), (725, [0.5] * 3)]
    rows = [(v, x and [None if c is None else float(np.float32(c)) for c in x]) for v, x in rows]
    got = found(spark, [(*r, 1, 2, 3, 4) for r in rows], 7, 5, scratch, *sizes)
    assert got == nearest(rows, 7, lambda v: v % 5 == 0)


@pytest.mark.parametrize("rescored", [0, 4, 256])
def test_search_stops_only_on_proof(monkeypatch, rescored):
    monkeypatch.setattr(impact_search, "RESCORED", rescored)
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (300, 16))
    levels = np.abs(x) * impact_search.LEVELS // (np.abs(x).max() + 1)
    shard = impact_search.Shard.__new__(impact_search.Shard)
    shard.whole, shard.levels = x, []
    for impact in range(impact_search.LEVELS - 1, -1, -1):
        rest = np.where(levels < impact, x, 0)
        shard.levels.append((np.where(levels == impact, x, 0), np.sqrt((rest.astype(float) ** 2).sum(axis=1))))
    scores = x[:50] @ x.T
    for a, b, s in (top := impact_search.top_of(shard, x[:50], np.arange(50), 9)):
        assert a != b and scores[a, b] == s
    for i in range(50):
        order = [j for j in np.lexsort((np.arange(300), -scores[i])) if j != i][:9]
        assert [b for a, b, _ in top if a == i] == order


def test_search_of_few_and_no_rows(spark, scratch):
    rows = [(i, [1.0, 0.5], 1, 2, 3, 4) for i in range(3)]
    assert found(spark, rows, 20, 20, scratch) == Counter({(0, 1, 1, 5120): 1, (0, 2, 2, 5120): 1})
    assert not found(spark, [], 20, 20, Scratch(spark))
    assert not found(spark, rows[1:], 20, 20, Scratch(spark))


def variants(rows, shortest, least, times):
    counts = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    known = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    letters, near, form = sorted({c for w in known for c in w}), defaultdict(set), {}
    for w in known:
        for i in range(len(w) + 1):
            edits = [w[:i] + c + w[i:] for c in letters] + ([w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in letters] if i < len(w) else [])
            near[w] |= {x for x in edits if x != w and x in known}
        if near[w]:
            best = min(near[w], key=lambda x: (-known[x], x))
            if known[best] >= times * known[w]:
                form[w] = best
    out = []
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), known[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("crowded", [256, 1])
def test_near_words_against_all_edits(spark, scratch, texts, crowded, monkeypatch):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (crowded,))
    docs = spark.createDataFrame([(d, t) for d, t, _ in texts], "doc_id long, text string")
    got = sorted(tuple(r) for r in spelling.variants(docs, scratch).collect())
    assert got == variants([(d, t) for d, t, _ in texts], 7, 2, 10) and sum(r[4] > 0 for r in got) > 100


def test_chains_of_forms_lead_to_their_roots(spark, scratch):
    chain = [("abcdefgh", 1200), ("abcdefgx", 110), ("abcdefyx", 10), ("abcdezyx", 1), ("abcdefghi", 120), ("ähnliches", 3), ("ähnlichez", 40), ("aabbccdd", 5)]
    words = [w for w, n in chain for _ in range(n)]
    rows = [(i, w) for i, w in enumerate(words)]
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "doc_id long, text string, word string, n int, key string")
    got = sorted(tuple(r) for r in spelling.variants(docs, scratch, 7, 1).collect())
    assert got == variants(rows, 7, 1, 10)
    assert {r[0]: r[2] for r in got}["abcdezyx"] == "abcdefgh"


def test_signatures_meet_for_every_single_edit():
    rng = np.random.default_rng(1)
    for _ in range(300):
        word = "".join(rng.choice(list("aabcdeéz"), rng.integers(7, 12)))
        at, letter = int(rng.integers(len(word))), str(rng.choice(list("aqé")))
        keys = defaultdict(set)
        for key, role in spelling.signatures_of(word):
            keys[role].add(key)
        for other, mine, theirs in ((word[:at] + letter + word[at + 1 :], 0, 0), (word[:at] + word[at + 1 :], 2, 1), (word[:at] + letter + word[at:], 1, 2)):
            assert keys[mine] & {k for k, r in spelling.signatures_of(other) if r == theirs}


def test_words_on_edges(spark, scratch):
    rows = [(None, "SPELLING spelling"), (1, None), (2, ""), (2, "Spelling ÉCOLIERS écoliers"), (2, "Spelling ÉCOLIERS écoliers"), (3, "spellings " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in spelling.variants(docs, scratch).collect()) == variants(rows, 7, 2, 10)
    assert spelling.variants(docs.limit(0), Scratch(spark)).count() == 0


def phrases(rows, least, keep, share):
    totals, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(own)
            counts[lang].update(" ".join(own[i : i + m]) for m in range(1, 6) for i in range(len(own) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and " " in p}
        scored = []
        for p, a in candidates.items():
            if any(f" {p} " in f" {q} " and p != q and 100 * b >= share * a for q, b in candidates.items()):
                continue
            own = p.split(" ")
            cuts = [(f[" ".join(own[:k])], f[" ".join(own[k:])]) for k in range(1, len(own))]
            score, k = min((1000 * a * totals[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
            scored.append((-score, -a, p.encode(), *cuts[k]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("pairs", "least", "keep", "share"), [(1_000_000, 20, 2_000, 100), (0, 20, 2_000, 100), (1_000_000, 12, 25, 60)])
def test_phrases_against_all_ngrams(spark, scratch, texts, monkeypatch, pairs, least, keep, share):
    monkeypatch.setattr(collocations, "MOST_PAIRS", pairs)
    rows = [(t, lang) for _, t, lang in texts]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, scratch, least, keep, share).collect())
    assert got == phrases(rows, least, keep, share) and len(got) > 20


def test_phrases_on_edges(spark, scratch):
    rows = [("New York, New York!\nNEW YORK City", "en")] * 5 + [(None, "en"), ("", None), ("b c " * 40_000, None), ("a b", "und"), ("É é " * 9, "x"), ("a a a a", "en")]
    docs = spark.createDataFrame([(t, lang, "q", "r", 1) for t, lang in rows], "text string, lang string, w1 string, phrase string, n int")
    got = sorted(tuple(r) for r in collocations.collocations(docs, scratch, 3).collect())
    assert got == phrases(rows, 3, 2_000, 100)
    assert collocations.collocations(docs.limit(0), Scratch(spark)).count() == 0


def test_windows_are_cut_past_the_pairs_a_filter_is_made_for(spark, scratch, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_PAIRS", 2)
    rows = [(f"r{i} s{i} t{i} u{i} v{i}. one two three four five. one two q{i} two three p{i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = collocations.windows(collocations.pieces(docs), 100, scratch)
    # 2,100 rare words, few of which stand before or behind anything, and what begins at the five others
    assert found.count() < 2_300
    assert {r.phrase for r in found.where("n >= 300").collect()} >= {"one two three four five", "one two", "five"}


def test_filters_hold_all_their_phrases_and_few_others(spark):
    hashes = spark.range(20_000).selectExpr("xxhash64(id) AS hash")
    for blocks in (1, collocations.blocks_for(10_000)):
        kept = collocations.phrase_filter(hashes.where("pmod(hash, 2) = 0"), blocks)
        found = hashes.join(kept, collocations.block_of("hash", blocks) == kept.block, "left").withColumn("held", collocations.holds("bits", "hash"))
        assert found.where("pmod(hash, 2) = 0 AND NOT held").count() == 0
    assert found.where("pmod(hash, 2) = 1 AND held").count() < 500
    assert collocations.blocks_for(0) == 1 and collocations.blocks_for(10**12) == 1 << 16


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**15
    rows = [("en", "", 0, big), ("en", "a b", 2, big - 7), ("en", "a", 1, big - 3), ("en", "b", 1, big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, f long")).collect()
    assert [r.score for r in got] == [1000 * (big - 7) * big // ((big - 3) * (big - 1))]


def test_search_query_asks_every_twentieth_row(spark):
    got = queries.op11_impact_search(spark, FOLDER)
    ids = [r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert {r.query_id for r in got.collect()} == {v for v in ids if v % 20 == 0}


def test_shuffle_files_go_once_a_table_is_written(spark, scratch):
    def held():
        folder = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return {p.name for p in folder.rglob("shuffle_*.data")}

    frame = spark.range(50_000).groupBy((F.col("id") % 997).alias("k")).count()
    before, setting = held(), spark.conf.get(FREE_SHUFFLES)
    freed = scratch.table_freeing("freed", frame)
    assert held() <= before and freed.count() == 997 and spark.conf.get(FREE_SHUFFLES) == setting
    scratch.table("plain", frame)
    assert not held() <= before
