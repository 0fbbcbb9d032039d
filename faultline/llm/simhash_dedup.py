"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.shared import Scratch, fresh, steps

#: Differing bits that still link two fingerprints, and so the bytes at equal positions that such a pair must share.
DISTANCE = 3
POSITIONS = 8
SHARED = POSITIONS - DISTANCE
#: Words of a shingle, and shingles summed at a time.
SHINGLE = 3
SUM_ROWS = 100_000
#: Postings lists above these lengths are refined by two more bytes, then replaced by neighbourhoods.
CROWDED = 256
DENSE = 650


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def mask(positions: tuple[int, ...]) -> int:
    return signed(sum(0xFF << (8 * p) for p in positions))


#: Any five of eight positions hold three of one half, so pairs that share five bytes share one of these eight blocks.
BLOCKS = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Below a block, such a pair shares two more of the other five.
REFINED = [tuple(sorted(b + more)) for b in BLOCKS for more in combinations([p for p in range(POSITIONS) if p not in b], 2)]


def fingerprints(docs: DataFrame, copies: bool = False) -> DataFrame:
    """doc_id and fingerprint (long; the 64 bits of the majority of the shingles' XXH64) of every row's whole text.

    With ``copies``, also copy, a hash of the text as it stands.

    A null text, or one without words, has fingerprint 0. Texts of any length are summed in pieces of bounded size.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch, texts in steps(batches):
            counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
            hashes: list[int] = []
            owners: list[tuple[int, int]] = []

            def add() -> None:
                if hashes:
                    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    starts = np.concatenate([[0], np.cumsum([n for _, n in owners])[:-1]])
                    counts[[d for d, _ in owners]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
                    hashes.clear()
                    owners.clear()

            for doc, text in enumerate(texts):
                words = text.lower().split()
                body = b" ".join(words)
                if len(words) <= SHINGLE:
                    spans = [(0, len(body))] if words else []
                else:
                    sizes = np.fromiter(map(len, words), np.int64, len(words))
                    ends = np.cumsum(sizes + 1) - 1
                    spans = list(zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True))
                totals[doc] = len(spans)
                for at in range(0, len(spans), SUM_ROWS):
                    part = [digest(body[a:b], 42) for a, b in spans[at : at + SUM_ROWS]]
                    owners.append((doc, len(part)))
                    hashes.extend(part)
                    if len(hashes) >= SUM_ROWS:
                        add()
            add()
            prints = np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
            more = batch.columns[2:]
            names = ["doc_id", "fingerprint", "copy"][: 2 + len(more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *more], names=names)

    key = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[copy_of().alias("copy")] * copies)
    return slim.mapInArrow(summed, f"doc_id {key}, fingerprint bigint" + ", copy bigint" * copies)


def copy_of() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def tally(a: str, b: str) -> Column:
    """How many bytes of two fingerprints agree at their position."""
    other = F.col(a).bitwiseXOR(F.col(b))
    return sum((other.bitwiseAND(F.lit(mask((p,)))) == 0).cast("int") for p in range(POSITIONS))


def postings(prints: DataFrame, blocks: list[tuple[int, ...]], which: Column | None = None) -> DataFrame:
    """fp, block and its bytes for every block (of those that ``which`` selects by number)."""
    each = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(mask(b))).alias("bytes")) for i, b in enumerate(blocks)])
    if which is not None:
        each = which(each)
    return prints.select("fp", F.inline(each))


def sized(listed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The postings of lists with at least two entries, with the list's length."""
    lengths = scratch.table(f"{name}_lengths", listed.groupBy("block", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    return scratch.table(name, listed.join(lengths, ["block", "bytes"]))


def within(lists: DataFrame) -> DataFrame:
    """Pairs of a list that share the guaranteed number of bytes and then prove to be near."""
    other = lists.select("block", "bytes", F.col("fp").alias("b"))
    pairs = lists.select("block", "bytes", F.col("fp").alias("a")).join(other, ["block", "bytes"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return pairs.where((F.col("a") < F.col("b")) & (tally("a", "b") >= SHARED) & near).select("a", "b")


def neighbourhoods(dense: DataFrame) -> DataFrame:
    """Links of lists of any length that connect whatever is near, at most one per entry and neighbourhood.

    In a refined list 24 bits are free. Two entries are near if and only if some point is within one bit of one and two
    bits of the other. Each entry visits the 301 points within two bits; at each point the smallest entry within one bit
    takes all others as links. A point has at most 301 visitors.
    """
    rows = []
    for i, block in enumerate(REFINED):
        free = [8 * p + k for p in range(POSITIONS) if p not in block for k in range(8)]
        rows += [(i, 0, 0)] + [(i, signed(1 << a), 1) for a in free] + [(i, signed(1 << a | 1 << b), 2) for a, b in combinations(free, 2)]
    steps_ = dense.sparkSession.createDataFrame(rows, "block int, delta bigint, radius int")
    visits = dense.select("block", "bytes", "fp").join(F.broadcast(steps_), "block")  # 24,080 rows
    visits = visits.select("block", F.col("fp").bitwiseXOR(F.col("delta")).alias("point"), "radius", "fp")
    hub = F.min(F.when(F.col("radius") <= 1, F.col("fp"))).over(Window.partitionBy("block", "point"))
    return visits.select(hub.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()


def links(prints: DataFrame, scratch: Scratch, crowded: int = CROWDED, dense: int = DENSE) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) that connect exactly what DISTANCE bits connect.

    A fingerprint is listed under its positional bytes, three at a time, which finds every pair that shares five. Long
    lists are refined by two more bytes, and those that stay long give a star per neighbourhood instead of all pairs.
    """
    first = sized(postings(prints, BLOCKS), scratch, "postings")
    found = within(first.where(F.col("n") <= crowded))
    long_ = first.where(F.col("n") > crowded)
    if not long_.isEmpty():
        more = len(REFINED) // len(BLOCKS)
        both = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(mask(b))).alias("bytes")) for i, b in enumerate(REFINED)])
        own = long_.select("fp", F.inline(F.slice(both, F.col("block") * more + 1, F.lit(more))))
        second = sized(own, scratch, "refined")
        found = found.unionByName(within(second.where(F.col("n") <= dense)))
        still = second.where(F.col("n") > dense)
        if not still.isEmpty():
            found = found.unionByName(neighbourhoods(still))
    return found


def linked(prints: DataFrame, first: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """fp and root of every distinct fingerprint, and root and least: the least ``first`` of the rows that links reach."""
    classes = scratch.table("classes", prints.groupBy(F.col("fingerprint").alias("fp")).agg(first.alias("first")))
    roots = components(links(classes.select("fp"), scratch), scratch)
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = scratch.table("roots", joined)
    return joined, scratch.table("least", joined.groupBy("root").agg(F.min("first").alias("least")))


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row.

    Equal fingerprints are one class; classes are linked, so a text that a third of all rows repeat is one entry of the
    index. component_id is the smallest doc_id that links reach, the row's own included; null if none of them has an id.
    Rows without words have fingerprint zero and are linked like any other. Repeated rows are reported each. Other
    columns are ignored; no rows give no rows.
    """
    prints = scratch.table("fingerprints", fingerprints(docs))
    joined, least = linked(prints, F.min("doc_id"), scratch)
    named = scratch.table("named", joined.join(least, "root").select(F.col("fp").alias("fingerprint"), F.col("least").alias("component_id")))
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with one row of each group, one with the smallest doc_id; columns unchanged.

    Of several texts with that doc_id in a group the one with the smallest hash stays, and of equal rows one. Rows that
    share a doc_id but stand in different groups are judged each. A group without any doc_id keeps one row too.
    """
    near_id, near_copy, near_rank = (fresh(docs, name) for name in ("near_id", "near_copy", "near_rank"))
    prints = scratch.table("fingerprints", fingerprints(docs, copies=True))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")
    _, least = linked(prints, F.min(row), scratch)
    # an id and a text name a row: equal texts have equal fingerprints, so no two groups keep the same
    stays = scratch.table("stays", least.select(F.col("least.doc_id").alias(near_id), F.col("least.copy").alias(near_copy)))
    # one plan at every size: the table of ids grows with the corpus
    kept = docs.join(stays.hint("merge"), F.col("doc_id").eqNullSafe(F.col(near_id)) & (copy_of() == F.col(near_copy)))
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    one = kept.withColumn(near_rank, F.row_number().over(Window.partitionBy(near_id, near_copy).orderBy(whole)))
    return one.where(F.col(near_rank) == 1).drop(near_id, near_copy, near_rank)
