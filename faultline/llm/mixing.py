"""Mixing sources to target weights by hash thresholds found in nested histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, fresh, small, text_of, word_count

#: Bits of the document hash, and how many of them one histogram resolves.
HASH_BITS = 60
LEVEL_BITS = 12
ALL = 1 << HASH_BITS


def place(doc_id: Column) -> Column:
    """A document's fixed place between 0 and 2**60, by which sources are filled."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def tie(row: Column) -> Column:
    """A row's fixed place among rows that share one, between 0 and 2**60."""
    return F.shiftrightunsigned(F.xxhash64(row), 64 - HASH_BITS)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source (source, source_size): its target in words.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words; a target stops
    at ``most`` times its source, the excess goes to the others by weight. Sources ordered by limit over weight fill up
    in that order, so those that stop are a prefix. One row per source is sorted in one task.
    """
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(every.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", level).withColumn("stops", F.col("limit") <= F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())
    return levels.select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * rest["level"]).alias("target"),
    )


def boundaries(rows: DataFrame, open_: DataFrame, key: str, scratch: Scratch, shared: bool = False) -> DataFrame:
    """Per source of ``open_`` (source, rest): the value ``at`` of ``key`` at which ``rest`` words run out.

    The first histogram sums words by source and the key's first twelve bits; the bucket in which ``rest`` runs out is
    resolved by the next twelve bits, and so on until it holds one value. Also n and rows, the words and rows there, and
    rest, what is left before them. With ``shared``, only rows whose place is the source's ``place`` count.
    """
    open_, found = open_.withColumn("prefix", F.lit(0).cast("long")), None
    for level, shift in enumerate(range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS)):
        inside = F.shiftright(key, shift + LEVEL_BITS) == F.col("prefix")
        near = small(open_.withColumnRenamed("source", "of").withColumnRenamed("place", "of_place"))
        if shared:
            inside = inside & (F.col("place") == F.col("of_place"))
        kept = ["rest", *["of_place"] * shared]
        histogram = (
            rows.join(near, F.col("source").eqNullSafe(F.col("of")) & inside)
            .groupBy("source", *kept, F.shiftright(key, shift).alias("bucket"))
            .agg(F.sum("size").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
            .withColumnsRenamed({"of_place": "place"})
        )
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        boundary = scratch.table(
            f"{key}{level}",
            histogram.withColumn("upto", upto).where("upto > rest AND upto - n <= rest").withColumn("rest", F.col("rest") - (F.col("upto") - F.col("n"))),
        )
        settled = boundary.where("low = high").select("source", "rest", F.col("low").alias("at"), "n", "rows", *["place"] * shared)
        found = settled if found is None else found.unionByName(settled)
        open_ = boundary.where("low < high").select("source", "rest", *["place"] * shared, F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    return found


def thresholds(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """Per source: source_size, target, how many times every document is taken, and where one more time ends.

    ``rows`` has source, size, place and tie. Rows below the place ``cutoff`` are taken once more, and at that place rows
    below ``tie_cutoff``. The row at which a target runs out is taken if that comes nearer to the target.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0)
    wanted = scratch.table(
        "targets",
        targets(sizes, weights, share, most)
        .withColumn("base", base.cast("long"))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")),
    )
    places = scratch.table("places", boundaries(rows, wanted.where("source_size > 0 AND rest > 0").select("source", "rest"), "place", scratch))
    nearer = F.when(F.col("rest") * 2 > F.col("n"), 1).otherwise(0)
    none = F.lit(0).cast("long")
    found = places.where("rows = 1").select("source", (F.col("at") + nearer).alias("cutoff"), none.alias("tie_cutoff"))
    shared = places.where("rows > 1")
    if not shared.isEmpty():
        ties = boundaries(rows, shared.select("source", "rest", F.col("at").alias("place")), "tie", scratch, shared=True)
        found = found.unionByName(ties.select("source", F.col("place").alias("cutoff"), (F.col("at") + nearer).alias("tie_cutoff")))
    return (
        wanted.drop("rest")
        .join(found.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        .drop("of")
        .withColumn("cutoff", F.coalesce("cutoff", none))
        .withColumn("tie_cutoff", F.coalesce("tie_cutoff", none))
    )


def plan(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, scratch: Scratch, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, source, size, place, tie; one row per source: targets and thresholds).

    Size is the number of words; a null text has none. A null source is a source of its own. A document's place depends
    on doc_id alone; rows that share one (null doc_ids do) are told apart by their row number, ``row`` or their place in
    the input, so they may be taken differently, and reruns over the same files agree. Texts without words are taken as
    often as their place says, at no cost. Other columns are ignored; no rows give no rows.
    """
    number = F.monotonically_increasing_id() if row is None else row
    slim = docs.select("doc_id", "source", word_count(text_of()).alias("size"), place(F.col("doc_id")).alias("place"), tie(number).alias("tie"))
    rows = scratch.table("sizes", slim)
    return rows, scratch.table("thresholds", thresholds(rows, weights, share, most, scratch))


def times(cutoffs: DataFrame, rows: DataFrame, place: Column, tie: Column, mix: str = "mix_") -> DataFrame:
    """``rows`` with the columns of their source's threshold, and how often each is taken (``mix_times``, by that prefix)."""
    sources = small(cutoffs.select(*[F.col(c).alias(f"{mix}{c}") for c in cutoffs.columns]))
    cutoff = F.col(f"{mix}cutoff")
    more = (place < cutoff) | ((place == cutoff) & (tie < F.col(f"{mix}tie_cutoff")))
    return rows.join(sources, F.col("source").eqNullSafe(F.col(f"{mix}source"))).withColumn(
        f"{mix}times", F.col(f"{mix}base") + more.cast("long")
    )


def mix(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """``docs`` with each row as often as it is taken, its columns unchanged."""
    prefix = fresh(docs, "mix_")
    count, row = f"{prefix}times", f"{prefix}row"
    numbered = scratch.table("numbered", docs.withColumn(row, F.monotonically_increasing_id()))
    _, cutoffs = plan(numbered, weights, share, most, scratch, F.col(row))
    taken = times(cutoffs, numbered, place(F.col("doc_id")), tie(F.col(row)), prefix).where(F.col(count) > 0)
    return taken.withColumn(count, F.explode(F.sequence(F.lit(1).cast("long"), count))).select(*[taken[c] for c in docs.columns])
