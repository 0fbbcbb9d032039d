"""Phrase collocations by top-order marginalisation: only the longest windows are counted, shorter phrases are sums over them."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch

#: What separates pieces of a text, and words of a piece.
STOPS = ".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = " \x09"
#: Words of a window, and so of the longest phrase.
LONGEST = 5
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
#: Words of the phrases by which windows are cut short, in the order in which they are counted.
CUTS = (2, 3)
#: Bits of a block of a filter of frequent phrases, as numbers of 64 bits. A phrase sets two bits of one block.
BLOCK_BITS = 4_096
#: Bits of a filter per phrase, and the phrases beyond which it grows no further: 32 MB are broadcast at most. With more,
#: more rare windows stay uncut, which gives the same results from a larger shuffle.
BITS_A_PHRASE = 16
MOST_PAIRS = 1 << 24
EXACT = "decimal(20,0)"


def pieces(docs: DataFrame) -> DataFrame:
    """lang (null: und) and the words of each piece of each text that has any; only A-Z are put in lower case."""
    # one stop and one blank are left, as Spark splits at single characters without a pattern
    plain = F.translate(
        F.coalesce(F.col("text").cast("string"), F.lit("")),
        string.ascii_uppercase + STOPS + BLANKS,
        string.ascii_lowercase + "\n" * len(STOPS) + " " * len(BLANKS),
    )
    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    return each.select("lang", F.array_remove(F.split("piece", " "), "").alias("words")).where(F.size("words") > 0)


def leads(found: DataFrame, longest: int) -> DataFrame:
    """lang and w1 to w<longest> of the window at every word: the word and those that follow it in its piece (null: none)."""
    ahead = [F.col("words"), *[F.slice("words", k, F.greatest(F.size("words"), F.lit(1))) for k in range(2, longest + 1)]]
    return found.select("lang", F.inline(F.arrays_zip(*[a.alias(w) for a, w in zip(ahead, WORDS, strict=False)])))


def key(words: list[str]) -> Column:
    return F.xxhash64("lang", *words)


def blocks_for(n: int) -> int:
    """How many blocks the filter of ``n`` phrases has, a power of two."""
    return 1 << max(0, math.ceil(min(n, MOST_PAIRS) * BITS_A_PHRASE / BLOCK_BITS) - 1).bit_length()


def block_of(hashed: str, blocks: int) -> Column:
    return F.expr(f"{hashed} & {blocks - 1}L")


def places(hashed: str) -> list[str]:
    """The two bits of its block that stand for a hashed phrase."""
    return [f"CAST(shiftrightunsigned({hashed}, {by}) & {BLOCK_BITS - 1} AS INT)" for by in (20, 40)]


def phrase_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """block and bits: a Bloom filter of the column ``hash``, one row of 64-bit numbers for each block that holds any."""
    each = hashes.select(block_of("hash", blocks).alias("block"), F.expr(f"explode(array({', '.join(places('hash'))}))").alias("place"))
    lanes = each.groupBy("block", F.expr("place >> 6").alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits"))
    held = lanes.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("lane", "bits"))).alias("held"))  # 64 at most
    return held.select("block", F.expr(f"transform(sequence(0, {BLOCK_BITS // 64 - 1}), i -> coalesce(held[i], 0L))").alias("bits"))


def holds(bits: str, hashed: str) -> Column:
    """Whether a block's bits (null: none) hold the phrase, or look as if they did."""
    found = [f"shiftrightunsigned(get({bits}, {at} >> 6), {at} & 63) & 1" for at in places(hashed)]
    return F.expr(f"coalesce({' & '.join(found)}, 0L) = 1L")


def cut(rows: DataFrame, longest: int, filters: dict[int, tuple[DataFrame, int]]) -> DataFrame:
    """``rows`` of ``leads`` with no words from where the first rare phrase of each window ends.

    ``filters`` has a filter and the number of its blocks by the number of words. The longest that fit are looked up, as a
    phrase that is not rare has no rare phrase in it.
    """
    go_on = F.lit(True)
    for k in range(2, longest + 1 if filters else 0):
        size = max(n for n in filters if n <= k)
        known, blocks = filters[size]
        rows = rows.withColumn(f"h{k}", F.when(go_on & F.col(f"w{k}").isNotNull(), key(WORDS[k - size : k])))
        there = F.broadcast(known.select(F.col("block").alias(f"b{k}"), F.col("bits").alias(f"x{k}")))  # 64 Ki rows at most
        rows = rows.join(there, block_of(f"h{k}", blocks) == F.col(f"b{k}"), "left")
        go_on = holds(f"x{k}", f"h{k}")
        rows = rows.withColumn(f"w{k}", F.when(go_on, F.col(f"w{k}")))
    return rows.select("lang", *WORDS[:longest])


def windows(found: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """lang, phrase and n: how often each longest window occurs, shorter where the piece ends.

    A phrase is rare if two or three neighbours in it are, so a window is cut before the last word of its first rare pair or
    triple: no phrase that occurs ``least`` times is lost, and hardly any rare window is shuffled. Triples are counted where
    both pairs are frequent. Frequent ones are known by Bloom filters over 64-bit hashes, whose errors only leave a rare
    window uncut.
    """
    filters: dict[int, tuple[DataFrame, int]] = {}
    for size in CUTS:
        rows = cut(leads(found, size), size, filters).where(F.col(WORDS[size - 1]).isNotNull())
        often = rows.groupBy(key(WORDS[:size]).alias("hash")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        hashes = scratch.table_freeing(f"frequent_{size}", often.select("hash"))
        blocks = blocks_for(hashes.count())
        filters[size] = scratch.table_freeing(f"filter_{size}", phrase_filter(hashes, blocks)), blocks
        scratch.drop(f"frequent_{size}")
    rows = cut(leads(found, LONGEST), LONGEST, filters).select("lang", F.concat_ws(" ", *WORDS).alias("phrase"))
    return scratch.table_freeing("windows", rows.groupBy("lang", "phrase").agg(F.count("*").alias("n")))


def marginals(counted: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """lang, phrase, size and f of the phrases of one to five words that occur ``least`` times, and size 0 for all words.

    Windows are summed by all their beginnings; the empty one is that of every window.
    """
    blanks = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    begins = [F.when(blanks >= k, F.substring_index("phrase", " ", k)) for k in range(1, LONGEST)]
    each = counted.select("lang", F.explode(F.array(F.lit(""), *begins, F.col("phrase"))).alias("phrase"), "n").where("phrase IS NOT NULL")
    size = F.when(F.col("phrase") == "", 0).otherwise(blanks + 1)
    some = each.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
    return scratch.table_freeing("phrases", some.select("lang", "phrase", size.alias("size"), "f"))


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, size, a, l, r, n and score, in exact whole numbers."""
    words = F.split("phrase", " ")
    total = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    cuts = phrases.where("size > 1").select(
        "lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.expr("sequence(1, size - 1)")).alias("k")
    )
    cuts = cuts.withColumn("first", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ")).drop("words")
    part = phrases.where("size > 0")
    both = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    both = both.join(F.broadcast(total), "lang")  # one row per language
    up, down = f"1000BD * CAST(a AS {EXACT}) * CAST(n AS {EXACT})", f"CAST(l AS {EXACT}) * CAST(r AS {EXACT})"
    cut = F.struct(F.expr(f"({up}) div ({down})").alias("score"), "k", "l", "r")
    least = both.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(cut).alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def contained(candidates: DataFrame) -> DataFrame:
    """lang, phrase and longer: the count of the most frequent longer candidate that holds the phrase."""
    words = candidates.where("size > 2").select("lang", "size", "a", F.split("phrase", " ").alias("words"))
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    return words.select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, scratch: Scratch, least: int = 100, keep: int = 2_000, share: int = 100) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score: the ``keep`` best phrases of two to five words of each language.

    Candidates occur at least ``least`` times within pieces. Each counts by the cut with the lowest score
    floor(1000 a n / (l r)); ties go to the earliest cut. Candidates in a longer one that occurs at least ``share``
    hundredths as often are dropped. Order: score and a descending, then the phrase by bytes.

    A null text is empty, a null lang is ``und``. Ids do not matter: repeated rows, null and repeated doc_ids count each.
    Texts of any length are cut into pieces in place. Other columns are ignored; an empty table gives no rows. Languages
    and words of any frequency are summed in each task before they are shuffled; no window frame or group holds the
    occurrences of a word, and the last ranking keeps ``keep`` rows per task and language before it meets in one. The
    shuffle files of each step are deleted once its table is written, so disk holds one step at a time.
    """
    counted = windows(pieces(docs), least, scratch)
    scratch.drop(*[f"filter_{size}" for size in CUTS])
    phrases = marginals(counted, least, scratch)
    scratch.drop("windows")
    found = scratch.table_freeing("candidates", scored(phrases))
    inside = contained(found)
    left = found.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return top.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
