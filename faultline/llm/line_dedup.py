"""Line deduplication across sites: HyperLogLog sketches of each line's spread, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, fresh

#: log2 of a sketch's registers; its relative error is 0.83 / sqrt(2**12) = 1.3 %. Decisions within five errors of the
#: threshold, and one more, are made by exact counts. Small sketches are sparse lists of a few bytes.
SKETCH_BITS = 12
NEAR = 5 * 0.83 / 2 ** (SKETCH_BITS / 2)
EDGES = " \t\r\x0b\x0c"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGES))


def lines(numbered: DataFrame, site: Column, row: str) -> DataFrame:
    """row, doc_id, site (hashed), place (from 0), key and check (two hashes) of every line that is not blank."""
    each = numbered.select(F.col(row).alias("row"), "doc_id", F.xxhash64(site.isNull(), site).alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    each = each.withColumn("line", stripped(F.col("line"))).where("line <> ''")
    return each.select("row", "doc_id", "site", "place", F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("check"))


LINE = ["key", "check"]


def widespread(found: DataFrame, min_sites: int, scratch: Scratch) -> DataFrame:
    """key, check and first (its row and place) of each line on ``min_sites`` sites: smallest doc_id, place, then row."""
    spread = found.groupBy(*LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "place", "row")).alias("first"),
    )
    margin = NEAR * min_sites + 1
    candidates = scratch.table("spread", spread.where(F.col("sites") >= min_sites - margin).select(*LINE, "sites", "first.row", "first.place"))
    near = candidates.where(F.col("sites") <= min_sites + margin)
    exact = (
        found.join(near.select(*LINE), LINE, "left_semi")
        .groupBy(*LINE, "site")
        .agg(F.lit(1).alias("one"))
        .groupBy(*LINE)
        .agg(F.count("*").alias("exact"))
        .where(F.col("exact") >= min_sites)
        .select(*LINE)
    )
    wide = candidates.where(F.col("sites") > min_sites + margin).unionByName(near.join(exact, LINE, "left_semi"))
    return scratch.table("widespread", wide.select(*LINE, F.struct("row", "place").alias("first")))


def remove(docs: DataFrame, site: Column, min_sites: int, scratch: Scratch) -> DataFrame:
    """``docs`` without the repeats of lines that occur on at least ``min_sites`` sites, plus n_lines and n_removed.

    Lines are compared without the blanks around them; blank lines are left alone. Of each widespread line the
    occurrence in the smallest doc_id stays (ties: the smallest place, then the first row), in one row only, so nothing is
    lost from the corpus as a whole. A null site is a site of its own; a null text stays null, with no lines. Null doc_ids
    come last. Rows are told apart by a row number that is written with them, so rows that share a doc_id or have none are
    cut each on its own, and a third of all rows under one id is no hot key. A column n_chars is set to the new length
    where lines went. Other columns stay, whatever their names, but ``n_lines`` and ``n_removed`` are replaced. Texts meet
    the places of their removals by row in one shuffle, at every size, as the removals grow with the corpus. A line on a
    third of all rows is pre-aggregated in each task; its removals are spread over its documents.
    """
    row, line_of, line_gone = (fresh(docs, name) for name in ("line_row", "line_of", "line_gone"))
    numbered = scratch.table("numbered", docs.withColumn(row, F.monotonically_increasing_id()))
    found = scratch.table("lines", lines(numbered, site, row))
    wide = widespread(found, min_sites, scratch)
    hits = found.join(wide, LINE).where((F.col("row") != F.col("first.row")) | (F.col("place") != F.col("first.place")))
    # a row's list is no longer than its own text
    removals = scratch.table("removals", hits.groupBy(F.col("row").alias(line_of)).agg(F.collect_list("place").alias(line_gone)))
    own = F.split("text", "\n")
    out = numbered.drop("n_lines", "n_removed").join(removals.hint("merge"), F.col(row) == F.col(line_of), "left")
    out = out.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size(own)), F.lit(0)))
    out = out.withColumn("n_removed", F.greatest(F.coalesce(F.size(line_gone), F.lit(0)), F.lit(0)))
    left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(line_gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(row, line_of, line_gone)
