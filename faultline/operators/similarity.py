"""Near vectors within logs of any size (J4): all pairs or those that random hyperplanes bring together, and what follows
from the pairs without a table of them.

Vectors meet in buckets: one per log for all pairs, or those that share the signs of some hyperplanes. A bucket is dealt
into blocks of bounded size, and every two blocks of it meet in one task. So no task holds a bucket, however hot it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import blocks

# the task code travels with the job, so executors need NumPy, pandas and Arrow but not this package
cloudpickle.register_pickle_by_value(blocks)

#: Vectors of a small bucket's block, on average.
BLOCK_ROWS = 1_000
#: Vectors of a large bucket's block. A task holds two blocks and one tile of their products.
MOST_ROWS = 16_384
SEED = 20_240_115

Stage = Callable[[str, DataFrame], DataFrame]


def tables_for(eps: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` hyperplanes after which a pair at distance ``eps`` has met with probability ``recall``.

    Two vectors at an angle lie on one side of a random hyperplane with probability 1 - angle / pi. Nearer pairs meet
    more often.
    """
    one = (1 - math.acos(1 - eps) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-one)))


def _cells(keyed: DataFrame, stage: Stage, name: str, block_rows: int, least_blocks: int) -> DataFrame:
    """``keyed`` (log_id, number, bucket, ordinal, ...) once for every two blocks its own block belongs to.

    A bucket is copied once per block, so blocks are as large as memory allows: ``block_rows`` at least, ``MOST_ROWS`` at
    most, and in between ``least_blocks`` of them, to keep all cores busy.
    """
    bucket = ["log_id", "number", "bucket"]
    n = F.count(F.lit(1))
    size = F.greatest(F.lit(block_rows), F.least(F.lit(max(block_rows, MOST_ROWS)), F.ceil(n / least_blocks)))
    sizes = keyed.groupBy(*bucket).agg(F.ceil(n / size).cast("int").alias("blocks"), n.alias("rows"))
    # written, so that the join can be broadcast by its size, or split where a bucket is hot
    sizes = stage(f"{name}_sizes", sizes.filter("rows > 1").drop("rows"))
    dealt = keyed.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("ordinal"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("_other", other)
    return dealt.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other", "blocks")


def _compared(cells: DataFrame, eps: float, found: Callable, columns: str) -> DataFrame:
    def streamed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from found(blocks.Cell(key, batches), eps)

    def at_once(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(found(blocks.Cell(key, rows.to_batches()), eps))

    # only pairs may be many more than the vectors of a cell
    of_cell = streamed if found is blocks.pairs else at_once
    cell = ["log_id", "number", "bucket", "lo", "hi"]
    # few bytes mean much work here, so partitions are not to be merged by their size
    session = cells.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return cells.repartition(tasks, *cell).groupBy(*cell).applyInArrow(of_cell, f"log_id string, {columns}")


def _whole_logs(vectors: DataFrame, stage: Stage, name: str, block_rows: int, *more: str) -> DataFrame:
    one_bucket = [F.lit(0).alias("number"), F.lit(0).cast("bigint").alias("bucket")]
    whole = vectors.filter(F.col("embedding").isNotNull()).select(
        "log_id", F.col("ordinal").cast("bigint").alias("ordinal"), "embedding", *one_bucket, *more
    )
    return _cells(whole, stage, name, block_rows, 16)


def all_pairs(vectors: DataFrame, eps: float, stage: Stage, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``log_id, a, b, distance`` with a < b of all pairs of a log within cosine distance ``eps``.

    Exact, and so quadratic in the vectors of a log. Null embeddings take no part; a zero vector is at distance 1 from all.
    """
    cells = _whole_logs(vectors, stage, "all_pairs", block_rows)
    return _compared(cells, eps, blocks.pairs, "a bigint, b bigint, distance double")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("log_id").agg(F.sum("pairs").alias("pairs"))


def count_pairs(vectors: DataFrame, eps: float, stage: Stage, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``log_id, pairs``: how many ``all_pairs`` has; only counts leave a task. Logs of one vector have no row."""
    return _summed(_compared(_whole_logs(vectors, stage, "count_pairs", block_rows), eps, blocks.pair_count, "pairs bigint"))


def degrees(vectors: DataFrame, eps: float, stage: Stage, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``log_id, ordinal, near``: in how many of ``all_pairs`` a vector stands; those in none have no row."""
    counts = _compared(_whole_logs(vectors, stage, "degrees", block_rows), eps, blocks.degrees, "ordinal bigint, near bigint")
    return counts.groupBy("log_id", "ordinal").agg(F.sum("near").alias("near"))


def core_links(vectors: DataFrame, eps: float, stage: Stage, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``log_id, a, b, border`` from ``vectors`` with a ``core`` flag: what density clusters need of ``all_pairs``.

    Rows without ``border`` link core vectors that some near core vectors connect, at most one row per vector and two
    blocks. Rows with it are all pairs of a vector ``a`` that is no core vector and a core vector ``b``.
    """
    return _compared(_whole_logs(vectors, stage, "core_links", block_rows, "core"), eps, blocks.links, "a bigint, b bigint, border boolean")


def _likely_cells(vectors: DataFrame, eps: float, stage: Stage, bits: int, recall: float, block_rows: int, seed: int) -> DataFrame:
    tables = tables_for(eps, bits, recall)
    narrow = next((kind, name) for most, kind, name in ((7, "int8", "tinyint"), (15, "int16", "smallint"), (31, "int32", "int"), (63, "int64", "bigint")) if bits <= most)

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                matrix = blocks.np.vstack(part["embedding"].to_numpy())
                keys = blocks.signs(blocks.unit_rows(matrix), tables, bits, seed)
                yield part.assign(keys=list(keys.astype(narrow[0])))

    slim = vectors.filter(F.col("embedding").isNotNull()).select("log_id", F.col("ordinal").cast("bigint").alias("ordinal"), "embedding")
    kind = slim.schema["embedding"].dataType.simpleString()
    signed = slim.mapInPandas(keyed, f"log_id string, ordinal bigint, embedding {kind}, keys array<{narrow[1]}>")
    signed = stage("signed_vectors", signed)
    rows = signed.select("*", F.posexplode("keys").alias("number", "bucket"))
    return _cells(rows, stage, "likely_pairs", block_rows, 2)


def likely_pairs(
    vectors: DataFrame, eps: float, stage: Stage, bits: int, recall: float = 0.95, block_rows: int = BLOCK_ROWS, seed: int = SEED
) -> DataFrame:
    """Those pairs within ``eps`` (below 1) that share the signs of ``bits`` hyperplanes in one of several tables.

    Distances are exact, so every pair returned is one of ``all_pairs``; a pair at ``eps`` is missed with probability
    1 - ``recall``, a nearer one more rarely. With n vectors in a log, log2(n / block_rows) bits make buckets of about one
    block. Near groups that share a bucket are dealt into blocks like any other.
    """
    cells = _likely_cells(vectors, eps, stage, bits, recall, block_rows, seed)
    return _compared(cells, eps, blocks.pairs, "a bigint, b bigint, distance double")


def count_likely_pairs(
    vectors: DataFrame, eps: float, stage: Stage, bits: int, recall: float = 0.95, block_rows: int = BLOCK_ROWS, seed: int = SEED
) -> DataFrame:
    """``log_id, pairs``: how many ``likely_pairs`` has; only counts leave a task."""
    cells = _likely_cells(vectors, eps, stage, bits, recall, block_rows, seed)
    return _summed(_compared(cells, eps, blocks.pair_count, "pairs bigint"))
