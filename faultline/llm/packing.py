"""Best-fit packing of token pieces into sequences of a fixed capacity, by bulk-synchronous rounds."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from faultline.llm.shared import Scratch, small, steps
from faultline.llm.tokens import encoder

#: Rows of one size and kind that are numbered together.
RANK_ROWS = 50_000
#: Sequences are opened when fewer than one in so many pieces found a gap.
STALLED = 50


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Ids of every text plus ``end_id``, cut every ``capacity`` ids.

    One row per piece: doc_id, piece (from 0), start, length, ids_crc32 (of the little-endian unsigned 32-bit ids), and
    the ids as binary if asked for. A null text counts as empty and has one piece, the end id. Null and repeated doc_ids
    stay as they are, each row on its own. Other columns are dropped.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        for batch, texts in steps(batches, encoding=True):
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), words.encode(texts), strict=True):
                ids = body + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [key, "int", "bigint", "bigint", "bigint"] + ["binary"] * keep_ids
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [arrow[k] for k in kinds]
    ddl = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, ddl)


def matched(items: DataFrame, bins: DataFrame, longest: int, rows: int) -> DataFrame:
    """One round: each piece with the open sequence whose gap fits it best, or with null.

    A gap of at least twice the longest piece offers several places, so that it can take several pieces in one round.
    Pieces and places are sorted by size, larger first, a place before a piece of its size. Sweeping down, a piece takes
    the smallest place seen that is still free, which is the last one seen: places are pushed, pieces pop. Rank among
    equals settles who takes which: the level of a push or pop follows from its rank and the counts of larger sizes, and
    at each level pushes and pops alternate, so the successor is the row before. Sizes are whole numbers up to the
    capacity, so the table of counts and every level hold at most two rows per size, however many pieces there are.
    """
    places = F.greatest(F.lit(1).cast("long"), F.floor(F.col("gap") / F.lit(longest)))
    offers = bins.select("bin_id", "gap", F.explode(F.sequence(F.lit(1).cast("long"), places)).alias("place")).select(
        F.lit(0).alias("kind"),
        F.col("bin_id").alias("id"),
        "place",
        F.floor(F.col("gap") / places).cast("long").alias("size"),
    )
    wanted = items.select(
        F.lit(1).alias("kind"), F.col("uid").alias("id"), F.lit(0).cast("long").alias("place"), F.col("length").alias("size")
    )
    buckets = max(1, math.ceil(rows / RANK_ROWS))
    every = offers.unionByName(wanted).withColumn("bucket", F.pmod(F.xxhash64("id", "place"), F.lit(buckets)))

    counts = every.groupBy("size", "kind", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size", "kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "size", "kind", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    down = Window.orderBy(F.desc("size"), "kind")
    totals = counts.groupBy("size", "kind").agg(F.sum("n").alias("n"))
    so_far = totals.select("size", "kind", F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(down).alias("sum"))
    depths = so_far.select(
        "size", "kind", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(down))).alias("after")
    ).select("size", "kind", F.coalesce(F.lag("after").over(down), F.lit(0)).alias("depth"))

    in_bucket = Window.partitionBy("size", "kind", "bucket").orderBy("id", "place")
    rank = F.row_number().over(in_bucket) - 1
    levels = (
        every.withColumn("rank", rank)
        .join(small(shifts, 8_192 * buckets), ["size", "kind", "bucket"])
        .join(F.broadcast(depths), ["size", "kind"])  # at most two rows per size
        .withColumn("rank", F.col("rank") + F.col("shift"))
        .withColumn("level", F.when(F.col("kind") == 0, F.col("depth") + F.col("rank")).otherwise(F.col("depth") - 1 - F.col("rank")))
    )
    left_over = levels.where((F.col("kind") == 1) & (F.col("level") < 0))
    at_level = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    pairs = (
        levels.where("level >= 0")
        .withColumn("bin_id", F.lag("id").over(at_level))
        .where("kind = 1")
        .select(F.col("id").alias("uid"), F.col("size").alias("length"), "bin_id")
    )
    return pairs.unionByName(
        left_over.select(F.col("id").alias("uid"), F.col("size").alias("length"), F.lit(None).cast("long").alias("bin_id"))
    )


def pack(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """``pieces`` (any columns, with ``length`` of 1 to ``capacity``) plus sequence_id and offset, gapless from 0.

    Pieces of full length get sequences of their own. The others are placed in rounds: open as many sequences as their
    tokens need, match pieces and gaps by best fit, reduce the gaps, and repeat; when hardly any piece fits an open gap,
    more sequences are opened for the tokens that are left. Every round places at least one piece if sequences were just
    opened, so it ends. Only counts, sums and extremes reach the driver. Equal lengths are told apart by a row number;
    repeated rows are packed each. An empty table gives an empty result. The row number, not doc_id, is the key, so
    null or repeated doc_ids do no harm. Columns named uid, bin_id, round, sequence_id or offset are not kept.
    """
    spark = scratch.spark
    pieces = pieces.drop("uid", "bin_id", "round", "sequence_id", "offset")
    numbered = scratch.table("pieces", pieces.withColumn("uid", F.monotonically_increasing_id()))
    items = numbered.where(F.col("length") < capacity).select("uid", F.col("length").cast("long").alias("length"))

    def state(frame: DataFrame):
        return frame.agg(
            F.count("*").alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("longest"), F.min("length").alias("shortest")
        ).first()

    rest, opened, rounds, kinds, bins, empty = state(items), 0, 0, None, None, True
    stalled = True
    while rest.n:
        if stalled:
            more = math.ceil(rest.tokens / capacity)
            fresh = spark.range(opened, opened + more).select(F.col("id").alias("bin_id"), F.lit(capacity).cast("long").alias("gap"))
            opened += more
            bins = fresh if empty else bins.unionByName(fresh)
            empty = False
        # the rounds are partitions of one table, so that what reads them all stays one scan however many there are
        out = scratch.table(f"placed/round={rounds}", matched(items, bins, rest.longest, rest.n))
        kinds = out.schema
        found = out.where("bin_id is not null")
        taken = found.groupBy("bin_id").agg(F.sum("length").alias("taken"))
        if rounds > 1:
            scratch.drop(f"bins{rounds - 2}")
        now = state(left := out.where("bin_id is null"))
        if now.n:
            reduced = bins.join(taken, "bin_id", "left").select(
                "bin_id", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")
            )
            bins = scratch.table(f"bins{rounds}", reduced.where(F.col("gap") >= now.shortest))
        stalled = (rest.n - now.n) * STALLED < rest.n
        items, rest, rounds = left.select("uid", "length"), now, rounds + 1

    whole = numbered.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    if kinds is None:
        return whole.drop("uid")
    every = spark.read.schema(StructType([*kinds, StructField("round", IntegerType())])).parquet(f"{scratch.folder}/placed")
    placed = every.where("bin_id is not null").select("uid", "bin_id", "round")
    in_order = Window.partitionBy("bin_id").orderBy("round", "uid").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        numbered.where(F.col("length") < capacity)
        .join(placed, "uid")
        .withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0)).cast("long"))
        .withColumnRenamed("bin_id", "sequence_id")
        .drop("round")
    )
    return parts.unionByName(whole).drop("uid")


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence with its ids as binary, from packed pieces that kept their ids; at most ``capacity`` ids each."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
