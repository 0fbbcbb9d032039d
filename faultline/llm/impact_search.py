"""Exact top-k search by inner product over an impact-ordered index, processed a score level at a time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch

#: Vectors of a shard of the index and queries of a block, on average.
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
#: Impacts are quantised to this many levels of a shard's largest.
LEVELS = 8
#: Queries scored together, and possible members of a query's top k at which scoring stops and they are rescored.
QUERIES_AT_ONCE = 256
RESCORED = 256
#: Sums below this are exact in 32-bit floats.
FLOAT_SAFE = 1 << 24
NO_ID = np.iinfo(np.int64).max


def whole_numbers(embedding: str = "embedding", factor: int = 64) -> Column:
    """floor(factor * x) of each component; null if the vector is null or holds null or non-finite components."""
    wide = F.col(embedding).cast("array<double>")
    fine = F.forall(wide, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * factor).cast("bigint")))


def packed(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def index(vectors: DataFrame, shards: int) -> DataFrame:
    """Posting segments: shard, impact, dim, docs, values, and per shard one row (impact -1) with its rows' ids.

    A shard takes rows by hash, its documents are numbered by ascending id, and a segment lists the documents whose
    component in ``dim`` has that quantised impact (LEVELS - 1 is the highest), with the component.
    """

    def segments(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unknown", "ascending"), ("vec_id", "ascending"), ("uid", "ascending")])
        width = max((len(x) for x in table["x"].to_pylist()), default=0)
        x = packed(table["x"], width)
        shard = table["shard"][0].as_py()
        top = int(np.abs(x).max(initial=0))
        level = np.abs(x) * LEVELS // (top + 1)
        rows = [(shard, -1, width, table["uid"].to_pylist(), [NO_ID if v is None else v for v in table["vec_id"].to_pylist()])]
        for impact in range(LEVELS - 1, -1, -1):
            for dim in range(width):
                docs = np.flatnonzero((level[:, dim] == impact) & (x[:, dim] != 0))
                if len(docs):
                    rows.append((shard, impact, dim, docs, x[docs, dim]))
        names = ["shard", "impact", "dim", "docs", "values"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = vectors.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), F.col("vec_id").isNull().alias("unknown"), "vec_id", "uid", "x")
    return dealt.groupBy("shard").applyInArrow(segments, "shard int, impact int, dim int, docs array<bigint>, values array<bigint>")


class Shard:
    """The segments of one shard, as one matrix of components per impact level."""

    def __init__(self, table: pa.Table, width: int):
        impacts, dims = table["impact"].to_numpy(), table["dim"].to_numpy()
        docs, values = table["docs"].combine_chunks(), table["values"].combine_chunks()
        doc_ends, docs, values = docs.offsets.to_numpy(), docs.values.to_numpy(), values.values.to_numpy()
        part = lambda i: slice(doc_ends[i], doc_ends[i + 1])
        head = int(np.flatnonzero(impacts == -1)[0])
        self.uids, self.ids = docs[part(head)], values[part(head)]
        self.whole = np.zeros((len(self.uids), max(width, int(dims[head]))), np.int64)
        kept = {}
        for i in np.flatnonzero(impacts >= 0).tolist():
            kept.setdefault(int(impacts[i]), []).append(i)
            self.whole[docs[part(i)], dims[i]] = values[part(i)]
        kind = np.float32 if np.abs(self.whole).max(initial=0) < FLOAT_SAFE else np.float64
        self.levels = []
        left = (self.whole.astype(np.float64) ** 2).sum(axis=1)
        for impact in sorted(kept, reverse=True):
            matrix = np.zeros(self.whole.shape, kind)
            for i in kept[impact]:
                matrix[docs[part(i)], dims[i]] = values[part(i)]
            left = np.maximum(left - (matrix.astype(np.float64) ** 2).sum(axis=1), 0)
            self.levels.append((matrix, np.sqrt(left)))


def top_of(shard: Shard, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, document, score) of the k best documents of a shard per query, ties to the first ones; never ``own``.

    Accumulators take in one level of impacts after the other, highest first. What the levels to come can add to a
    document is at most the norm of its components there times the query's norm. Scoring a query stops when few documents
    can still reach the k-th best of some exactly scored ones; these, or all that can reach it after the last level, are
    scored exactly.
    """
    n, width = shard.whole.shape
    q = np.zeros((len(queries), width), np.int64)
    q[:, : queries.shape[1]] = queries
    most = int(np.abs(q).max(initial=0)) * int(np.abs(shard.whole).max(initial=0)) * max(1, width)
    kind = np.float32 if most < FLOAT_SAFE else np.float64
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    acc = np.zeros((len(q), n), kind)
    mine = own >= 0
    acc[np.flatnonzero(mine), own[mine]] = -np.inf
    open_, least = np.arange(len(q)), np.full(len(q), -np.inf)
    chosen: list[tuple[np.ndarray, np.ndarray]] = []
    exact = lambda i, j: np.einsum("ab,ab->a", q[i], shard.whole[j])
    levels = shard.levels or [(shard.whole.astype(kind), np.zeros(n))]
    for number, (matrix, left) in enumerate(levels, 1):
        acc[open_] += q[open_].astype(kind) @ matrix.astype(kind, copy=False).T
        if n > k + 1:
            seeds = np.argpartition(acc[open_], n - k, axis=1)[:, n - k :]
            scores = exact(np.repeat(open_, k), seeds.ravel()).reshape(seeds.shape).astype(np.float64)
            scores[np.isinf(np.take_along_axis(acc[open_], seeds, 1))] = -np.inf
            least[open_] = np.maximum(least[open_], scores.min(axis=1))
        slack = 1e-9 * norms[open_, None] * left + (left > 0) * 1e-6  # rounding of the norms
        possible = acc[open_] + norms[open_, None] * left + slack >= least[open_, None]
        possible &= ~np.isinf(acc[open_])
        done = (possible.sum(axis=1) <= RESCORED) | (number == len(levels))
        at, docs = np.nonzero(possible[done])
        chosen.append((open_[done][at], docs))
        open_ = open_[~done]
        if not len(open_):
            break
    who, docs = (np.concatenate(x) for x in zip(*chosen, strict=True))
    scores = np.concatenate([exact(who[i : i + 100_000], docs[i : i + 100_000]) for i in range(0, len(who), 100_000)] or [np.zeros(0, np.int64)])
    order = np.lexsort((docs, -scores, who))
    who, docs, scores = who[order], docs[order], scores[order]
    first = np.searchsorted(who, np.arange(len(q)))
    keep = np.arange(len(who)) - first[who] < k
    return list(zip(who[keep].tolist(), docs[keep].tolist(), scores[keep].tolist(), strict=True))


def search(vectors: DataFrame, is_query: Column, k: int, scratch: Scratch, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` best rows by integer inner product for every query row.

    ``vectors`` has vec_id and x (array of whole numbers, null: takes no part); queries are the rows for which ``is_query``
    holds, each against every row but itself. Ties go to the smaller vec_id, null last, then to the earlier row. Shorter
    vectors count as padded with zeros; sums must stay below 2**53. Repeated rows are found each and ask each.

    Every block of queries meets every shard of the index in one task, with at most about SHARD_ROWS and BLOCK_ROWS rows
    of each, and hands on ``k`` rows per query. Rows are dealt to shards by a row number, so equal vectors are spread.
    """
    kept = vectors.where("x IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), "x", is_query.alias("asks"))
    rows = scratch.table("vectors", kept.select(F.monotonically_increasing_id().alias("uid"), "*"))
    count = rows.agg(F.count("*").alias("all"), F.sum(F.col("asks").cast("long")).alias("asking")).first()
    shards, blocks = max(1, math.ceil(count["all"] / shard_rows)), max(1, math.ceil((count["asking"] or 0) / block_rows))
    segments = scratch.table("segments", index(rows, shards))

    def scored(held: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_uid", "query_id", "vec_id", "uid", "score"]
        if not held.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        width = max(len(x) for x in asked["x"].to_pylist())
        shard, queries = Shard(held, width), packed(asked["x"], width)
        uids, ids = asked["uid"].to_numpy(), asked["vec_id"].to_numpy()
        by_uid = np.argsort(shard.uids)
        at = np.minimum(np.searchsorted(shard.uids[by_uid], uids), len(by_uid) - 1)
        own = np.where(shard.uids[by_uid[at]] == uids, by_uid[at], -1)
        found = []
        for i in range(0, len(uids), QUERIES_AT_ONCE):
            top = top_of(shard, queries[i : i + QUERIES_AT_ONCE], own[i : i + QUERIES_AT_ONCE], k)
            found += [(uids[i + a], ids[i + a], shard.ids[b], shard.uids[b], s) for a, b, s in top]
        columns = [np.array(c, np.int64) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 5
        nulls = columns[2] == NO_ID
        return pa.table([pa.array(c, mask=nulls if i == 2 else None) for i, c in enumerate(columns)], names=names)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = segments.select("*", each(blocks).alias("block"))
    asked = rows.where("asks").select("uid", "vec_id", "x", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard"))
    pairs = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    best = pairs.applyInArrow(scored, "query_uid bigint, query_id bigint, vec_id bigint, uid bigint, score bigint")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
