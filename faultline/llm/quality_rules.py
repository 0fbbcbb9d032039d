"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, small, steps

#: Base rules: fewest words, and most words in repeated windows, in hundredths.
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: A sketch counts values by logarithmic bucket, so its quantiles are right to this relative error.
ERROR = 0.01
LOG_BASE = math.log((1 + ERROR) / (1 - ERROR))
TINY = 1e-4
#: Sketches of fewer documents are merged with those of the language's other sources.
LEAST_DOCS = 100
#: What is measured, and the size of a document that it is a share of.
MEASURES = {
    "symbols_a_word": "n_words",
    "shouts_a_word": "n_words",
    "capitals_a_char": "word_chars",
    "dup_lines_a_line": "n_lines",
    "chars_a_word": "n_words",
}
#: Measures whose low values are judged too.
TWO_SIDED = ("chars_a_word",)
#: A limit lies this many spreads (half of what is between the 10th percentile and what is usual) beyond what is usual.
SPREADS = 4.0
#: What a document of the cell's median size may have beyond that, as occurrences: spreads of rare things are zero.
OCCURRENCES = {"symbols_a_word": 8, "shouts_a_word": 8, "capitals_a_char": 8, "dup_lines_a_line": 2, "chars_a_word": 0}
#: Lines of which repeats are a share at least, where documents have fewer.
FEW_LINES = 10
AT = 0.9
LOW = 0.1
SPREAD = 2.0


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and counts over every row's whole text; a null text has no words."""

    lookup = {name: np.zeros(256, bool) for name in ("space", "symbol", "shout", "start")}
    lookup["space"][list(SPACES)] = lookup["symbol"][list(SYMBOLS)] = lookup["shout"][list(b"!?")] = True
    lookup["start"][:128] = lookup["start"][192:] = True
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_capitals"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            n = len(texts)
            raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
            sizes = np.fromiter(map(len, texts), np.int64, n) + 1
            starts = np.cumsum(sizes) - sizes
            per = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
            spaces = lookup["space"][raw]
            split = [t.split() for t in texts]
            words = np.fromiter(map(len, split), np.int64, n)
            lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, t in enumerate(texts):
                own = [x for x in t.split(b"\n") if x.strip()]
                lines[i], dups[i] = len(own), len(own) - len(set(own))
            columns = [
                words,
                per(lookup["start"][raw]) - per(spaces),
                per(lookup["symbol"][raw]),
                dups,
                repeated(split, words),
                lines,
                per(lookup["shout"][raw]),
                per((raw >= 65) & (raw <= 90)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, columns)], names=["doc_id", "lang", "source", *names])

    def repeated(split: list[list[bytes]], words: np.ndarray) -> np.ndarray:
        """Words of each text in windows of five that it holds at least twice."""
        total = int(words.sum())
        out = np.zeros(len(split), np.int64)
        if total < WINDOW:
            return out
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.uint64, len(w)) for w in split])
        owner = np.repeat(np.arange(len(split)), words)
        # owners are spread over all bits first, or one text's number and word could look like another's
        mixed = (owner[: total - WINDOW + 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        for k in range(WINDOW):
            mixed = (mixed ^ ids[k : total - WINDOW + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        at = np.flatnonzero(owner[: total - WINDOW + 1] == owner[WINDOW - 1 :])
        order = at[np.argsort(mixed[at], kind="stable")]
        same = mixed[order][1:] == mixed[order][:-1]
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        marks = np.zeros(total + 1, np.int64)
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + WINDOW, -1)
        np.add.at(out, owner[np.cumsum(marks)[:-1] > 0], 1)
        return out

    key = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(counted, f"doc_id {key}, lang string, source string, " + ", ".join(f"{c} bigint" for c in names))


def measures() -> list[Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [
        ratio("n_symbols", "n_words").alias("symbols_a_word"),
        ratio("n_shouts", "n_words").alias("shouts_a_word"),
        ratio("n_capitals", "word_chars").alias("capitals_a_char"),
        ratio("n_dup_lines", "n_lines").alias("dup_lines_a_line"),
        ratio("word_chars", "n_words").alias("chars_a_word"),
    ]


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches: how many documents per lang, source, measure or size, and logarithmic bucket (null: next to zero)."""
    names = [*MEASURES, *dict.fromkeys(MEASURES.values())]
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")) for name in names]))
    bucket = F.when(F.col("value") > TINY, F.ceil(F.log("value") / LOG_BASE)).cast("int")
    return rows.select("lang", "source", each).groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(found: DataFrame, *keys: str) -> DataFrame:
    """keys, docs, low (10th percentile), middle, high (90th percentile) and usual of each sketch.

    usual is the 90th percentile, but no further above the median than SPREAD times the median is above the 10th: what
    less than half of the documents have cannot raise that.
    """
    docs = Window.partitionBy(*keys)
    upto, total = F.sum("n").over(docs.orderBy(F.asc_nulls_first("bucket"))), F.sum("n").over(docs)
    value = F.coalesce(F.exp(F.col("bucket") * LOG_BASE), F.lit(0.0))
    at = found.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).withColumn("upto", upto).withColumn("docs", total)
    reached = lambda share: F.min(F.when(F.col("upto") >= share * F.col("docs"), value))
    each = at.groupBy(*keys).agg(F.first("docs").alias("docs"), reached(LOW).alias("low"), reached(0.5).alias("middle"), reached(AT).alias("high"))
    usual = F.least("high", F.col("middle") + SPREAD * (F.col("middle") - F.col("low")))
    return each.select(*keys, "docs", "low", "middle", "high", usual.alias("usual"))


def limits(found: DataFrame) -> DataFrame:
    """lang, source, and of each measure: least_ and most_, the passing values at the median size, and size_, that size.

    Sketches merge by adding counts: a source with few documents takes the sketch of its whole language. For any other its
    own 90th percentile counts, but no more of it than is usual in the language or than nine tenths of its own documents
    reach, which is a way of writing. So junk raises no limit while it is under half of the language and under nine tenths
    of the source. Limits lie SPREADS spreads and some occurrences beyond what is usual.
    """
    own = quantiles(found, "lang", "source", "measure")
    wide = quantiles(found, "lang", "measure").select(
        F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("usual").alias("wide"), F.col("low").alias("wide_low"), F.col("middle").alias("wide_middle")
    )
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")))
    few = F.col("docs") < LEAST_DOCS
    low = F.when(few, F.col("wide_low")).otherwise(F.col("low"))
    held = F.when(few, F.col("wide")).otherwise(F.least("high", F.greatest("wide", "low")))
    middle = F.when(few, F.col("wide_middle")).otherwise(F.col("middle"))
    cells = both.select("lang", "source", "measure", low.alias("low"), held.alias("held"), middle.alias("middle"))
    per_cell = cells.groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "held", "middle")))).alias("by")  # one entry per measure
    )
    columns = []
    for name, size in MEASURES.items():
        at = F.col("by")[name]
        typical = F.greatest(F.col("by")[size]["middle"], F.lit(FEW_LINES if size == "n_lines" else 1))
        # documents much alike still differ by chance: words deviate by about half their mean length
        chance = at["held"] / 2 / F.sqrt(typical) if name in TWO_SIDED else F.lit(0.0)
        spread = F.greatest((at["held"] - at["low"]) / 2, chance)
        beyond = SPREADS * spread + OCCURRENCES[name] / typical
        least = at["low"] - beyond if name in TWO_SIDED else F.lit(0.0)
        columns += [at["low"].alias(f"low_{name}"), at["held"].alias(f"usual_{name}"), least.alias(f"least_{name}")]
        columns += [(at["held"] + beyond).alias(f"most_{name}"), typical.alias(f"size_{name}")]
    return per_cell.select("lang", "source", *columns)


def passes(name: str) -> Column:
    """Whether a measure is within its limits: their distance to what is usual grows for documents below the median size, as
    the chance in a share does, with the root of how many times smaller they are."""
    size = F.greatest(F.col(MEASURES[name]), F.lit(1))
    wider = F.sqrt(F.greatest(F.col(f"size_{name}") / size, F.lit(1.0)))
    most = F.col(f"usual_{name}") + wider * (F.col(f"most_{name}") - F.col(f"usual_{name}"))
    least = F.col(f"low_{name}") - wider * (F.col(f"low_{name}") - F.col(f"least_{name}"))
    return F.coalesce(F.col(name).between(least, most), F.lit(True))


def judge(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, the base counts, base_failed, the measures with their limits, passes_ of each, and kept, for every row.

    A document fails the base rules with fewer than ten words, or if over a fifth of them stand in five-word windows that
    the text repeats. Of the others, the sketches give each language and source its limits, and a document is kept if
    all of its measures are within them. A null lang or source is one of its own. Repeated rows and null doc_ids are
    judged each; a null text has no words and fails. Other columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = scratch.table("measured", measured(docs).withColumn("base_failed", failed).select("*", *measures()))
    most = scratch.table("limits", limits(sketches(rows.where("NOT base_failed"))))
    named = most.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    judged = rows.join(small(named), same, "left").drop("of_lang", "of_source")
    kept = ~F.col("base_failed")
    for name in MEASURES:
        judged = judged.withColumn(f"passes_{name}", passes(name))
        kept = kept & F.col(f"passes_{name}")
    return judged.withColumn("kept", kept)
