"""The operators for training text against brute force, round trips and held-out rows, and their defined edge cases."""

import json
import math
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as driver
import corpus_pipeline
import numpy as np
import oracle_check
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import chat_format, components, exact_dedup, language_id, line_dedup, mixing, packing
from faultline.llm import quality_rules, queries, simhash_dedup, token_orc, tokens, toxicity
from faultline.llm.oracles import ORACLES
from faultline.llm.shared import Scratch
from faultline.llm.tokens import WordEncoder

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns carry names that operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line_doc string, near_id int, mix_times int, uid int, place int, score int"
LONG = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, LONG, "en", "a"),
    (2, LONG.replace(" ", " \t"), "en", "b"),
    (3, LONG, None, None),
    (3, LONG, None, None),
    (None, LONG, "en", "a"),
    (None, None, None, None),
    (4, None, "en", "a"),
    (5, "", "de", "b"),
    (6, " \n ", "de", "b"),
    (7, "1234 !!", "de", None),
    (8, "über Maß <|endoftext|> it's a b ... İx ﬁn \U0001f600 " + "lang " * 9_000, "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "x", 1, 2, 3, 4, 5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert oracle_check.compare(driver.queries()[name](spark, FOLDER), oracle_check.connect(FOLDER), ORACLES[name]) is None


def test_encoder_equals_the_library_on_whole_texts(texts):
    tokenizer, own = Tokenizer.from_file(VOCABULARY), WordEncoder(VOCABULARY)
    given = [t or "" for t in texts.values()][:150] + [r[1] or "" for r in ROWS] + ["x" * 200, "é Σας don't we'll, 'S \x1c a", "\x00 a\x85b"]
    for _ in range(2):  # with an empty and a filled cache
        for text, ids in zip(given, own.encode([t.encode() for t in given]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("room", "step"), [(50, 4 << 20), (1_000_000, 4 << 20), (1_000_000, 40)])
def test_encoder_on_odd_texts(monkeypatch, room, step):
    monkeypatch.setattr(tokens, "CACHE_WORDS", room)
    monkeypatch.setattr(tokens, "LOOK_BYTES", step)
    tokenizer, own, rng = Tokenizer.from_file(VOCABULARY), WordEncoder(VOCABULARY), np.random.default_rng(4)
    letters = list("aabcdeE'.,!  \n\t\x00\x0b\x1c0é ß İ Σς ́中😀-'sS")
    for _ in range(30):
        given = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(30)] + ["", "\n", " a", "a\x00 a a\x00\x00", "x" * 25 + " " + "x" * 24]
        for text, ids in zip(given, own.encode([t.encode() for t in given]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    long_ = "hello wörld, it's " * 40 + "y" * 300 + " end"
    assert np.frombuffer(own.encode([long_.encode()])[0], "<u4").tolist() == tokenizer.encode(long_, add_special_tokens=False).ids
    assert own.encode([]) == [] and own.encode([b""]) == [b""] and own.encode([b"", b" "]) == [b"", b""]


def test_packing_is_gapless_whole_and_tight(spark, texts):
    rows = queries.op2_best_fit_packing(spark, FOLDER).collect()
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(VOCABULARY), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            own = ids[4096 * piece : 4096 * (piece + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (piece, 4096 * piece, len(own), zlib.crc32(own.tobytes()))
        assert sum(r.length for r in parts) == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_sequence) <= math.ceil(sum(r.length for r in rows) / 4096 * 1.02) + 1


def test_packing_matches_best_fit_of_a_round(spark, scratch):
    gaps, sizes = [7, 3, 5, 5], [5, 4, 4, 9, 2]
    bins = spark.createDataFrame(list(enumerate(gaps)), "bin_id long, gap long")
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    found = {r.uid: r.bin_id for r in packing.matched(items, bins, 10, 5).collect()}
    assert found[3] is None and found[4] == 1 and sorted(gaps[found[u]] for u in (0, 1, 2)) == [5, 5, 7]
    assert gaps[found[0]] == 5


def test_packed_sequences_hold_the_ids(docs, scratch):
    pieces = packing.token_pieces(docs, VOCABULARY, 64, 1, keep_ids=True)
    whole = packing.sequences(packing.pack(pieces, 64, scratch)).collect()
    assert all(len(r.ids) == 4 * r.length <= 256 for r in whole)
    assert sum(r.length for r in whole) == sum(r.length for r in pieces.collect())


def test_orc_round_trip(spark, texts):
    tokenizer, start = Tokenizer.from_file(VOCABULARY), 0
    found = {r.doc_id: r for r in queries.op6_token_orc(spark, FOLDER).collect()}
    for doc in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (found[doc].start, found[doc].n_tokens, found[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_orc_edges_and_lookup(spark, docs, none, scratch):
    token_orc.write(docs, f"{scratch.folder}/a", VOCABULARY, 2)
    assert token_orc.index(spark, f"{scratch.folder}/a").count() == len(ROWS)
    assert token_orc.lookup(spark, f"{scratch.folder}/a", [5]).select("ids").collect()[0].ids == [2]
    token_orc.write(none, f"{scratch.folder}/b", VOCABULARY, 2)
    assert token_orc.index(spark, f"{scratch.folder}/b").count() == 0


def test_orc_stripes_filters_and_skipping(spark, scratch):
    from pyarrow import orc

    path, texts = f"{scratch.folder}/striped", [(2 * i, "word " * 300 + str(i)) for i in range(12_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    token_orc.write(docs.coalesce(1), path, VOCABULARY, 2, stripe_bytes=1 << 16)
    files = sorted(pathlib.Path(path).glob("part-*.orc"))
    opened = [orc.ORCFile(f) for f in files]
    assert max(f.nstripes for f in opened) > 1 and all(f.row_index_stride == 1_000 for f in opened)

    def rows_read(doc_id):
        found = token_orc.lookup(spark, path, [doc_id])
        assert [r.doc_id for r in found.collect()] == [doc_id] * (doc_id % 2 == 0)
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return sum(m._2().value() for m in iterated(scan.metrics()) if m._1() == "numOutputRows")

    assert 0 < rows_read(4_002) <= 1_000  # the row index leaves one group
    assert rows_read(24_001) == 0
    assert sum(rows_read(i) for i in (4_003, 9_001, 15_555)) <= 1_000  # ids between others: only Bloom filters tell


def iterated(found):
    steps = found.iterator()
    while steps.hasNext():
        yield steps.next()


def test_orc_spreads_rows_of_one_id(spark, scratch):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "same text") for i in range(9_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join such small shards
    try:
        token_orc.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{scratch.folder}/hot", VOCABULARY, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = token_orc.read(spark, f"{scratch.folder}/hot").groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == 9_000 and max(r["count"] for r in shards) < 4_500
    starts = sorted((r.start, r.doc_id is not None, r.doc_id or 0) for r in token_orc.index(spark, f"{scratch.folder}/hot").collect())
    assert [s[1:] for s in starts] == sorted(s[1:] for s in starts) and len({s[0] for s in starts}) == 9_000


def simhash(text):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [b" ".join(own)] * bool(own)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def reachable(prints):
    """Smallest key in reach of each, from pairs at three or fewer differing bits."""
    keys, root = sorted(prints), {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_simhash_against_all_pairs(spark, texts):
    found = {r.doc_id: r for r in queries.op10_simhash_dedup(spark, FOLDER).collect()}
    prints = {d: simhash(t) for d, t in texts.items()}
    assert {d: int(r.fingerprint, 16) for d, r in found.items()} == prints
    assert {d: r.component_id for d, r in found.items()} == reachable(prints)


@pytest.mark.parametrize(("crowded", "dense"), [(256, 650), (3, 650), (1, 1)])
def test_links_connect_what_all_pairs_connect(spark, scratch, crowded, dense):
    rng = np.random.default_rng(7)
    prints = {0}
    for base in rng.integers(0, 2**63, 12).tolist():
        prints |= {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(12)}
    signed = {p: simhash_dedup.signed(p) for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = simhash_dedup.links(frame, scratch, crowded, dense)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links.collect())
    roots = {r.node: r.root for r in components.components(links, scratch).collect()}
    want, groups = reachable({p: p for p in prints}), defaultdict(set)
    for p in prints:
        groups[want[p]].add(roots.get(signed[p], signed[p]))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_chain_and_a_star(spark, scratch):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_near_dedup_keeps_one_of_each_group(docs, scratch):
    kept = simhash_dedup.dedup(docs, scratch)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 4: 1, 7: 1, 8: 1}


def test_near_dedup_goes_back_to_rows_by_id_and_text(spark, scratch):
    other, third, lone = (" ".join(f"{name}{i}" for i in range(30)) for name in ("other", "third", "lone"))
    rows = [(None, lone), (None, lone.upper()), (None, LONG), (1, LONG), (2, other), (2, third), (2, third), (5, third), (0, other + " "), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text.strip().lower()) for r in simhash_dedup.dedup(docs, scratch).collect()]
    assert sorted(kept, key=str) == sorted([(None, lone), (1, LONG), (0, other), (2, third)], key=str)


def test_exact_dedup_edges(docs, none, scratch):
    rows = exact_dedup.groups(docs, scratch).collect()
    long_ = [r for r in rows if r.group_size == 5]
    assert len(rows) == len(ROWS) and len(long_) == 5 and {r.keep_id for r in long_} == {1}
    assert [r.doc_id for r in rows if r.kept and r.keep_id in (1, 4, 6)] in ([1, 4, 6], [1, 6, 4], [4, 1, 6], [4, 6, 1], [6, 1, 4], [6, 4, 1])
    assert {r.doc_id for r in rows if r.keep_id == 4} == {4, 5, None}  # null texts count as empty
    assert exact_dedup.groups(none, Scratch(none.sparkSession)).count() == 0


def test_repeated_rows_keep_one(spark, scratch):
    rows = spark.createDataFrame([(1, "a b"), (1, "a  b"), (1, "a\nb"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sum(r.kept for r in exact_dedup.groups(rows, scratch).collect()) == 2


def test_mixing_edges(docs, none, spark):
    rows, cutoffs = mixing.plan(docs, (5, 2, 1), 1.5, 2.0, Scratch(spark))
    found = mixing.times(cutoffs, rows, F.col("place"), F.col("tie")).collect()
    sizes = Counter()
    for r, own in zip(sorted(found, key=str), sorted(ROWS, key=str), strict=False):
        sizes[r.source] += r.size
        assert r.mix_times <= 2
    assert sum(sizes.values()) == sum(len(words(r[1])) for r in ROWS)
    mixed = mixing.mix(docs, (5, 2, 1), 1.5, 2.0, Scratch(spark))
    assert mixed.columns == docs.columns and mixed.count() == sum(r.mix_times for r in found)
    assert mixing.mix(none, (5, 2, 1), 1.5, 2.0, Scratch(spark)).count() == 0


def test_line_dedup_keeps_the_first_and_counts_sites(spark, none, scratch):
    nav, rare = "menu home", "only twice"
    rows = [(i, f"{nav} \nbody {i}\n\n{rare if i < 2 else i}", f"s{i}") for i in range(6)] + [(9, None, None), (10, "", "s1"), (None, f"{nav}\nz", None)]
    docs = spark.createDataFrame([(*r, None, "x") for r in rows], "doc_id long, text string, source string, n_chars long, line_gone string")
    found = line_dedup.remove(docs, F.col("source"), 4, scratch)
    out = {r.doc_id: r for r in found.collect()}
    assert out[0].text == rows[0][1] and out[1].text == f"body 1\n\n{rare}" and out[None].text == "z" and out[9].text is None
    assert out[3].n_chars == len(out[3].text) and out[3].n_removed == 1 and out[10].text == "" and found.columns[:5] == docs.columns
    assert line_dedup.remove(none, F.col("source"), 4, Scratch(spark)).count() == 0


@pytest.mark.parametrize("hot", [None, 0, 4_000])
def test_line_dedup_of_rows_that_share_an_id(spark, scratch, hot):
    pool = [f"shared line {i}" for i in range(300)]
    rows = [(hot if i % 3 == 0 else i, "\n".join([pool[(7 * i + k) % 300] for k in range(20)] + ["menu", f"own {i}"]), f"s{i % 40}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.remove(docs, F.col("source"), 5, scratch).collect()
    left = Counter(line for r in out for line in r.text.split("\n"))
    assert len(out) == len(rows) and all(left[line] == 1 for line in pool) and left["menu"] == 1
    assert sum(1 for line in left if line.startswith("own ")) == 3_000
    least = 0 if hot == 0 else 1
    assert [r.doc_id for r in out if "menu" in r.text.split("\n")] == [least]


@pytest.mark.parametrize("hot", [None, 7])
def test_mixing_meets_targets_with_shared_ids(spark, scratch, hot):
    rows = [(hot if i % 10 < 7 else i + 100, " ".join(["w"] * (1 + i % 9)), f"s{i % 4}") for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, cutoffs = mixing.plan(docs, (5, 2, 1), 1.5, 2.0, scratch)
    found = mixing.times(cutoffs, sizes, F.col("place"), F.col("tie")).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.size * r.mix_times
        target[r.source] = r.mix_target
    assert len(found) == 1_000 and all(abs(taken[s] - t) <= 9 for s, t in target.items())
    mixed = mixing.mix(docs, (5, 2, 1), 1.5, 2.0, Scratch(spark))
    assert {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()} == dict(taken)
    assert mixed.columns == docs.columns


def test_exact_dedup_spreads_rows_without_ids(spark, scratch):
    docs = spark.createDataFrame([(None, f"text {i % 900}") for i in range(3_000)] + [(5, "text 1")] * 1_000, "doc_id long, text string")
    rows = exact_dedup.groups(docs, scratch).collect()
    assert sum(r.kept for r in rows) == 900 and len(rows) == 4_000
    runs = scratch.spark.read.parquet(f"{scratch.folder}/digests").withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(64))).groupBy("run").count()
    assert runs.agg(F.max("count")).first()[0] < 200


def test_sketches_agree_with_exact_counts_beyond_the_margin(spark, scratch):
    rows = [(i, f"wide\n{'narrow' if i < 80 else i}\n{'edge' if i < 100 else -i}", f"s{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_dedup.remove(docs, F.col("source"), 100, scratch).collect()
    assert all("wide" not in r.text for r in found if r.doc_id) and all("narrow" in r.text for r in found if r.doc_id < 80)
    assert [r.doc_id for r in found if "edge" in r.text.split("\n")] == [0]


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect())


def test_language_edges(docs, none):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 4)]
    known = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(known, F.lit(True))
    found = language_id.predict(docs, model)
    assert [c for c in found.columns if c not in ("lang_pred", "score")] == [c for c in docs.columns if c != "score"]
    for r in found.collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert {r.lang_pred for r in language_id.predict(known, model).where("lang = lang_pred").collect()} == {"en", "de", "fr"}
    empty = language_id.train(none, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_toxic_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op7_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    hits, toxic, called = sum(r.predicted and r.toxic for r in found), sum(r.toxic for r in found), sum(r.predicted for r in found)
    assert hits >= 0.9 * toxic and hits >= 0.9 * called


def test_toxicity_edges(docs, none):
    weights, bias = toxicity.fit([], [b"a"], 0.1)
    assert weights == {} and all(not r.predicted for r in toxicity.score(docs, weights, bias).collect())
    weights, bias = toxicity.fit([b"you idiot %d" % i for i in range(40)], [b"good day %d" % i for i in range(90)] + [b"you idiot"] * 10, 0.1)
    rows = docs.sparkSession.createDataFrame([(1, "IDIOT!"), (2, "day"), (3, None)], "doc_id long, text string")
    assert [r.predicted for r in sorted(toxicity.score(rows, weights, bias).collect())] == [1, 0, 0]
    assert toxicity.score(none, weights, bias).count() == 0


@pytest.mark.parametrize(("toxic_share", "hot_rows"), [(0.4, 0), (0.6, 0), (0.1, 500)])
def test_toxicity_learns_from_many_toxic_rows_and_from_copies(spark, toxic_share, hot_rows):
    def text(i, toxic):
        own = [f"vile{chr(97 + (i * k) % 13)}" for k in (3, 5, 7)] if toxic else []
        return " ".join([f"plain{chr(97 + (i * k) % 23)}" for k in range(2, 12)] + own + [f"row{i}"])

    rows = [(i, text(i, i % 10 < 10 * toxic_share), int(i % 10 < 10 * toxic_share)) for i in range(1_000)]
    rows += [(1_000 + i, text(-10, True), 1) for i in range(hot_rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = docs.where("doc_id % 7 < 3").select("doc_id", "toxic")
    weights, bias = toxicity.train(docs.select("doc_id", "text"), known, F.lit(True))
    found = toxicity.score(docs, weights, bias).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    assert weights and len(found) == len(rows) and sum(r.predicted != r.toxic for r in found) <= 0.02 * len(rows)


def test_toxicity_samples_are_whole(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior: sides.append((len(positive), len(unlabelled))))
    docs = spark.range(7_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CAST(id < 2500 AS int) AS toxic")
    toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    assert sides == [(2_000, 6_000)]


def base_counts(text):
    text, own = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = defaultdict(list)
    for i in range(len(own) - 4):
        windows[tuple(own[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_brute_force(spark, docs, texts, scratch):
    given = {**texts}
    for r in queries.op9_quality_rules(spark, FOLDER).collect():
        want = base_counts(given[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    rows = quality_rules.judge(docs, scratch).collect()
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words) for r in rows) == Counter((x[0], base_counts(x[1])[0], base_counts(x[1])[4]) for x in ROWS)


def test_quality_keeps_good_rows_and_drops_symbols(spark, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = queries.op9_quality_rules(spark, folder).join(labels, "doc_id").where("quality = 1 AND n_words >= 10")
    assert good.where("kept").count() >= 0.97 * good.count()
    noise = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("ab### cd$$$ ef&&& " * 4 + "gh%%% " * 2).alias("text"), "lang", "source", "n_chars")
    judged = quality_rules.judge(docs.unionByName(noise), Scratch(spark)).where("doc_id = -1").collect()
    assert not judged[0].kept
    assert quality_rules.judge(none, Scratch(spark)).count() == 0


def test_quantiles_are_right_to_the_stated_error(spark):
    rows = spark.createDataFrame([("x", "s", 1.0 + i / 100) for i in range(500)], "lang string, source string, chars_a_word double")
    for name in [*quality_rules.MEASURES, *quality_rules.MEASURES.values()]:
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(40.0))
    found = quality_rules.quantiles(quality_rules.sketches(rows), "lang", "source", "measure").where("measure = 'chars_a_word'").first()
    exact = [1.0 + i / 100 for i in (49, 249, 449)]
    assert [found.low, found.middle, found.high] == pytest.approx(exact, rel=0.021) and found.docs == 500


def quantile(values, share):
    return sorted(values)[math.ceil(share * len(values)) - 1]


def test_verdicts_against_exact_quantiles(spark):
    """The rules restated over exact quantiles; rows so near a limit that the sketch's error decides are left out."""
    folder, rules = "/root/testdata/sf0.01", quality_rules
    rows = [r.asDict() for r in rules.judge(spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark)).collect()]
    cells, langs = defaultdict(list), defaultdict(list)
    for r in rows:
        if not r["base_failed"]:
            cells[r["lang"], r["source"]].append(r)
            langs[r["lang"]].append(r)

    def of(docs, name):
        low, middle, high = (quantile([d[name] for d in docs], q) for q in (rules.LOW, 0.5, rules.AT))
        return low, middle, high, min(high, middle + rules.SPREAD * (middle - low))

    checked = decided = 0
    for (lang, _), docs in cells.items():
        for name, size in rules.MEASURES.items():
            wide, own = of(langs[lang], name), of(docs, name)
            few = len(docs) < rules.LEAST_DOCS
            low, usual = (wide[0], wide[3]) if few else (own[0], min(own[2], max(wide[3], own[0])))
            typical = max(of(langs[lang] if few else docs, size)[1], rules.FEW_LINES if size == "n_lines" else 1)
            chance = usual / 2 / math.sqrt(typical) if name in rules.TWO_SIDED else 0
            beyond = rules.SPREADS * max(chance, (usual - low) / 2) + rules.OCCURRENCES[name] / typical
            for d in docs:
                wider = math.sqrt(max(1, typical / max(1, d[size])))
                most, least = usual + wider * beyond, low - wider * beyond if name in rules.TWO_SIDED else 0.0
                margin = 0.15 * max(most, 1e-3)
                if abs(d[name] - most) > margin and (least == 0.0 or abs(d[name] - least) > margin):
                    assert d[f"passes_{name}"] == (least <= d[name] <= most), (name, d)
                    checked, decided = checked + 1, decided + (not d[f"passes_{name}"])
    assert checked > 0.95 * 5 * sum(map(len, cells.values())) and decided > 20


def test_limits_differ_between_cells_and_drop_bad_rows(spark):
    folder = "/root/testdata/sf0.1"
    judged = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark))
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    dropped = {name: [sum(not r[f"passes_{name}"] for r in side) for side in (good, bad)] for name in quality_rules.MEASURES}
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad), dropped
    assert dropped["symbols_a_word"][1] > 200 and dropped["chars_a_word"][1] > 100, dropped
    for name in ("symbols_a_word", "chars_a_word", "capitals_a_char"):
        assert len({round(r[f"most_{name}"], 4) for r in rows}) >= 4, name


def test_two_ways_of_writing_have_their_own_limits(spark):
    rows = [("en", "long", " ".join(f"considerable{i}x{j}" for j in range(40))) for i in range(150)]
    rows += [("en", "short", " ".join(f"a{(i + j) % 90}" for j in range(40))) for i in range(150)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, ("en", "short", rows[3][2])])], "doc_id long, lang string, source string, text string")
    found = {r.doc_id: r for r in quality_rules.judge(docs, Scratch(spark)).collect()}
    assert found[0].most_chars_a_word > 15 and found[200].most_chars_a_word < 15
    assert found[0].kept and found[200].kept and not found[300].passes_chars_a_word


@pytest.mark.parametrize("size", [60, 300])
def test_quality_drops_junk_that_is_a_tenth_and_more_of_a_source(spark, size):
    clean = lambda i: " ".join(f"word{i}x{j}" + ("!" if j % 9 == 0 else "") for j in range(30))
    junk = [
        lambda i: " ".join(f"bad{i}x{j}" + ("#" if j % 10 < 5 + i % 5 else "") for j in range(30)),
        lambda i: " ".join(f"BAD{i}X{j}" for j in range(30)),
        lambda i: "\n".join([f"menu home {i}"] * 2 + [f"own{i}x{j} text" for j in range(2)] + [f"foot{i} end"] * 2),
    ]
    rows = []
    for kind, make in enumerate(junk):
        for share in (10, 20, 40, 70):  # the language alone tells that 70 % of a source are junk
            rows += [(f"{kind}-{share}", "hot", make(i) if 100 * i < share * size else clean(i), 100 * i >= share * size) for i in range(size)]
            rows += [(f"{kind}-{share}", "calm", clean(-i), True) for i in range(size if share > 40 else 0)]
    code = " ".join(f"a{j} #b" for j in range(15))
    rows += [("en", "prose", clean(i), True) for i in range(400)] + [("en", "code", f"{code} {i}", True) for i in range(120)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, good boolean")
    found = quality_rules.judge(docs, Scratch(spark)).join(docs.select("doc_id", "good"), "doc_id").collect()
    assert len(found) == len(rows) and not [(r.lang, r.source) for r in found if r.kept != r.good]


def call(id_, name="f", arguments=None, after=None):
    return {"id": id_, "name": name, "arguments": {"n": 1} if arguments is None else arguments, **({"after": after} if after else {})}


def test_chat_links_orders_and_validates(spark, scratch):
    say = lambda *calls: json.dumps({"tool_calls": calls})
    told = lambda id_, text="r": json.dumps({"tool_call_id": id_, "content": text})
    rows = [
        (1, 0, "user", 'say "hi"\n'),
        (1, 1, "assistant", say(call("a", arguments={"z": {"b": 1, "a": [2]}, "n": 3}), call("b", after=["a"]))),
        (1, 2, "tool", told("a")),
        (1, 3, "tool", told("b")),
        (1, 4, "tool", told("b", "again")),
        (1, 5, "tool", told("x")),
        (1, 6, "assistant", say(call("a"), call("c", "g"), call("d", arguments={"n": "3"}), call("e", arguments={}), call("f", after=["y"]))),
        (2, 1, "assistant", say(call("p", after=["q"]))),
        (2, 2, "assistant", say(call("q"))),
        (2, 3, "assistant", say(call("u", after=["v"]), call("v", after=["u"]))),
        (None, None, None, None),
        (3, 0, "assistant", "{broken"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    out = chat_format.link(frame, {"f": {"n": ("integer", True)}}, scratch)
    found = {(r.conv_id, r.turn, r.part, r.kind): r for r in out.collect()}
    status = {(r.conv_id, r.call_id, r.turn): r.status for r in found.values() if r.kind == "call"}
    assert status[1, "a", 1] == "ok" and status[1, "b", 1] == "ok" and status[1, "a", 6] == "repeated id"
    assert status[1, "c", 6] == "unknown tool" and status[1, "d", 6] == "n is no integer" and status[1, "e", 6] == "n is missing"
    assert status[1, "f", 6] == "unknown need" and status[2, "u", 3] == status[2, "v", 3] == "cycle" and status[2, "q", 2] == "no result"
    assert [found[1, t, 0, "result"].status for t in (2, 3, 4, 5)] == ["ok", "ok", "repeated result", "no call"]
    assert found[1, 1, 0, "call"].json == '{"arguments":{"n":3,"z":{"a":[2],"b":1}},"id":"a","name":"f","result":"r","role":"assistant"}'
    assert found[1, 0, 0, "message"].json == '{"content":"say \\"hi\\"\\n","role":"user"}' and found[3, 0, 0, "message"].status == "ok"
    p, q = found[2, 1, 0, "call"], found[2, 2, 0, "call"]
    assert (q.at, q.level) < (p.at, p.level)
    assert len(found) == 1 + 2 + 4 + 5 + 4 + 2
    assert chat_format.link(frame.limit(0), {}, Scratch(spark)).count() == 0


def test_chat_json_after_blanks_and_byte_order_mark(spark, scratch):
    say, told = json.dumps({"tool_calls": [call("a"), call("b")]}), [json.dumps({"tool_call_id": i, "content": "r"}) for i in "ab"]
    rows = [(1, 0, "assistant", "\ufeff " + say), (1, 1, "tool", " \t\r\n" + told[0]), (1, 2, "tool", "\ufeff" + told[1]), (1, 3, "tool", "x " + told[0])]
    out = chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {"n": ("integer", True)}}, scratch)
    found = {(r.turn, r.part): (r.kind, r.status) for r in out.collect()}
    assert found == {(0, 0): ("call", "ok"), (0, 1): ("call", "ok"), (1, 0): ("result", "ok"), (2, 0): ("result", "ok"), (3, 0): ("message", "ok")}


def test_chat_calls_meet_results_in_a_hash_join(spark, scratch):
    keys = [(1, f"c{i}", i) for i in range(50)]
    calls = scratch.table("calls", spark.createDataFrame(keys, "conv_id long, call_id string, uid long"))
    results = scratch.table("results", spark.createDataFrame(keys[::2], "conv_id long, call_id string, result_uid long"))
    found = chat_format.matched(calls, results)
    assert sorted(found.collect()) == sorted(keys[::2])
    assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_pipeline_stages_on_edges_and_whole(spark, docs, none, texts):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "source_mixing", "best_fit_packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, kept = kept.columns, stage(spark, kept, FOLDER)
        assert kept.columns == columns
        none_left = stage(spark, none, FOLDER)
        assert none_left.columns == columns and none_left.count() == 0
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in found} <= set(texts) and max(r.offset + r.length for r in found) <= 4096


def test_near_dedup_stage_against_all_pairs(spark, texts):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, source, FOLDER).select("doc_id").collect()}
    assert kept == set(reachable({d: simhash(t) for d, t in texts.items()}).values())
