"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, steps

#: A word: letters of these two blocks.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a letter, so that there is something to find.
DAMAGED = 31
#: Words a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Partitions of the letter vector. One replaced letter changes two of its bits, so of PARTS_SAME partitions all but two
#: are equal; one letter more changes one bit, so of PARTS_LONGER all but one are.
PARTS_SAME, PARTS_LONGER = 4, 3
#: Words of a bucket above which it is resolved by its words' deletions.
CROWDED = 256


def occurrences(docs: DataFrame) -> DataFrame:
    """word and n of the runs of letters in every whole text, A-Z in lower case, some with a letter left out.

    With h the crc32 of ``<doc_id>:<run>``, a run whose h is divisible by DAMAGED loses the letter at h modulo its
    length. A null doc_id counts as no characters.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return done

        for batch, texts in steps(batches):
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                start = zlib.crc32(f"{doc or ''}:".encode())
                # within a text equal runs have equal hashes
                for word, n in Counter(RUN.findall(text.lower().decode(errors="replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(counted, "word string, n bigint")


def signatures_of(word: str) -> Iterator[tuple[int, int]]:
    """(key, role) of a word: role 0 meets words of its length, 1 (the shorter) meets 2 (the longer by one).

    A letter's i-th occurrence is one bit of the vector; bits are dealt to partitions. A key hashes the letters of some
    partitions, the length, and the half of the word that one edit leaves as it is: its beginning or its end.
    """
    seen: Counter[str] = Counter()
    bits = []
    for letter in word:
        seen[letter] += 1
        bits.append((letter, 7 * ord(letter) + 3 * seen[letter]))
    bits.sort()
    for parts, changed, roles in ((PARTS_SAME, 2, ((0, 0),)), (PARTS_LONGER, 1, ((1, 0), (2, 1)))):
        own = ["".join(letter for letter, bit in bits if bit % parts == p) for p in range(parts)]
        for chosen in combinations(range(parts), parts - changed):
            letters = "|".join(own[p] for p in chosen)
            for role, more in roles:
                length = len(word) - more
                for half in ("<" + word[: length // 2], ">" + word[len(word) - length // 2 :]):
                    key = f"{parts}{chosen}{length}{half}{letters}"
                    yield xxhash.xxh64_intdigest(key) - (1 << 63), role


def signatures(words: DataFrame) -> DataFrame:
    """key, role, word and n of every signature of every word."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                rows = [(k, r, i) for i, word in enumerate(part.column(0).to_pylist()) for k, r in signatures_of(word)]
                keys, roles, owners = zip(*rows, strict=True)
                own = part.take(pa.array(owners, pa.int32()))
                columns = [pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), *own.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(listed, "key bigint, role tinyint, word string, n bigint")


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """word, n, other and m: both sides joined on ``keys``."""
    other = right.select(*keys, F.col("word").alias("other"), F.col("n").alias("m"))
    return left.select(*keys, "word", "n").join(other, keys).select("word", "n", "other", "m")


def deletions(words: DataFrame) -> DataFrame:
    """Pairs at one edit, by equal deletions at equal places: linear, as such a list holds at most one word per letter."""
    each = words.select("word", "n", F.explode(F.expr("sequence(1, char_length(word))")).alias("at"))
    each = each.withColumn("rest", F.expr("concat(substr(word, 1, at - 1), substr(word, at + 1))"))
    replaced = paired(each, each, ["at", "rest"]).where("word < other")
    longer = paired(words.withColumnRenamed("word", "rest").withColumn("word", F.col("rest")), each, ["rest"])
    return replaced.unionByName(longer)


def near_pairs(words: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """word, n, other and m of the pairs exactly one insertion, deletion or replacement apart, each pair once.

    ``words`` has distinct words and their n. Signatures are joined as equal keys and verified by edit distance. Buckets of
    more than ``crowded`` words are not paired: their words meet through deletions instead, which finds the same pairs.
    """
    listed = scratch.table("signatures", signatures(words))
    sizes = scratch.table("buckets", listed.groupBy("key").agg(F.count("*").alias("size"), F.max("role").alias("kind")).where("size > 1"))
    lists = scratch.table("lists", listed.join(sizes, "key"))
    calm = lists.where(F.col("size") <= crowded)
    same = paired(calm.where("role = 0"), calm.where("role = 0"), ["key"]).where("word < other")
    longer = paired(calm.where("role = 1"), calm.where("role = 2"), ["key"])
    found = same.unionByName(longer).where(F.levenshtein("word", "other", 1) == 1)
    busy = lists.where(F.col("size") > crowded)
    if not busy.isEmpty():
        found = found.unionByName(deletions(scratch.table("busy", busy.select("word", "n").distinct())))
    # a longer pair has the shorter word first, so each pair has one order
    return scratch.table("near", found.distinct())


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root: the end of the chain of forms from ``forms`` (word, form), by doubling.

    Each step of a chain multiplies the count, so chains are short and hold no cycle.
    """
    reach, rounds = forms.select("word", F.col("form").alias("root")), 0
    while True:
        reach = scratch.table(f"reach{rounds}", reach)
        jump = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reach.join(jump, "root", "left_semi").isEmpty():
            return reach
        reach = reach.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        rounds += 1


def variants(docs: DataFrame, scratch: Scratch, shortest: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``shortest`` letters and ``least`` occurrences or more.

    A word's form is its near word with the largest n (ties: the smallest in code point order) if that is at least
    ``times`` its own; root follows forms to their end and is the word itself where it has none.

    Null and empty texts have no words. Repeated rows and repeated doc_ids count each; texts of any length are read whole.
    Other columns are ignored; an empty table gives no rows. Words, however frequent, are counted in each task before they
    are shuffled, so copies and frequent words are single rows in the join.
    """
    counted = occurrences(docs).groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.table("words", counted.where((F.char_length("word") >= shortest) & (F.col("n") >= least)))
    near = near_pairs(words, scratch)
    both = near.unionByName(near.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    named = best.select(
        "word",
        "n_near",
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    named = scratch.table("forms", named)
    ends = roots(named.where("form IS NOT NULL"), scratch)
    out = words.join(named, "word", "left").join(ends, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
