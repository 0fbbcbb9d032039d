"""Raw logs as ``log_lines`` (S1, S2, S4, S5, W9). One file, or one row of a text column, is one log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.plans.staging import Staging

# The line ends of Python's str.splitlines(); the text reader is told to end lines at \n only.
ANY_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OTHER_LINE_ENDS = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Names by which the text reader knows that it must decompress.
COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"

Stage = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Logs:
    """``logs`` has one row per accepted log, also for empty ones; ``quarantine`` has log_id and reason."""

    logs: DataFrame
    lines: DataFrame
    quarantine: DataFrame


def split_lines(texts: DataFrame) -> DataFrame:
    """``log_id, text`` to numbered lines. A final line end does not start another line."""
    parts = F.split("text", ANY_LINE_END, -1)
    closed = F.element_at(parts, -1) == ""
    lines = F.when(closed, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return texts.select("log_id", F.posexplode(lines).alias("i", "raw_line")).select(
        "log_id", (F.col("i") + 1).cast("bigint").alias("line_number"), "raw_line"
    )


def _line_breaks(text):
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def judge(texts: DataFrame, cfg: Settings) -> DataFrame:
    """``texts`` with the reason for which a guard rejects them, or NULL. Sizes are taken row by row, no shuffle."""
    size = F.col("size") if "size" in texts.columns else F.octet_length("text").cast("bigint")
    # kept as a value of its own: a NULL reason must not make the negated filter drop a row
    reason = F.when(F.lit(False), "")
    if cfg.max_bytes is not None:
        reason = reason.when(size > cfg.max_bytes, "file_too_large")
    if cfg.max_line_breaks is not None:
        reason = reason.when(_line_breaks(F.col("text")) > cfg.max_line_breaks, "too_many_lines")
    return texts.withColumn("reason", reason)


def guard(texts: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """Accepted texts, and the rejected logs with their reason."""
    judged = judge(texts, cfg)
    accepted = judged.filter(F.col("reason").isNull()).select("log_id", "text")
    return accepted, judged.filter(F.col("reason").isNotNull()).select("log_id", "reason")


def from_texts(texts: DataFrame, cfg: Settings) -> Logs:
    """Logs held as ``log_id, text`` rows."""
    accepted, rejected = guard(texts, cfg)
    return Logs(accepted.select("log_id"), split_lines(accepted), rejected)


def _log_id():
    """The file's path as both readers name it, with its escapes undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _is_compressed() -> Column:
    return F.col("_metadata.file_name").rlike(COMPRESSED)


def _whole_files(files: DataFrame, up_to: int) -> DataFrame:
    # size and name are known from the listing: larger files are in no task
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.filter((F.col("_metadata.file_size") <= up_to) & ~_is_compressed()).select(
        _log_id().alias("log_id"), F.col("length").alias("size"), text.alias("text")
    )


def _oversized(files: DataFrame, above: int) -> DataFrame:
    return files.filter(F.col("_metadata.file_size") > above).select(
        _log_id().alias("log_id"), F.lit("file_too_large").alias("reason")
    )


def _rows(spark: SparkSession, path: str, above: int, up_to: int | None) -> DataFrame:
    """The reader's rows of compressed files and of those above a size, with what numbers them."""
    size = F.col("_metadata.file_size")
    wanted = (size > above) | _is_compressed()
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("lineSep", "\n")
        .text(path)
        .filter(wanted if up_to is None else wanted & (size <= up_to))
        .select(
            _log_id().alias("log_id"),
            F.col("_metadata.file_block_start").alias("block"),
            # the size of a compressed file says nothing about its last line
            F.when(~_is_compressed(), size).alias("size"),
            F.monotonically_increasing_id().alias("id"),
            F.octet_length("value").alias("bytes"),
            F.make_valid_utf8("value").alias("value"),
        )
    )


def _pieces() -> Column:
    # \r\n is one end: what a row ends with besides its \n belongs to it
    body = F.when(F.endswith("value", F.lit("\r")), F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return F.split(body, OTHER_LINE_ENDS, -1)


def _splits(rows: DataFrame) -> DataFrame:
    """One row per split: where its first row stands, how many lines come before it, whether its file's last line is open."""
    blocks = rows.groupBy("log_id", "block").agg(
        F.sum(F.size(_pieces())).alias("n"), F.count(F.lit(1)).alias("read"), F.min("id").alias("first"),
        F.max("id").alias("last"), F.sum("bytes").alias("bytes"), F.first("size").alias("size"),
    )
    per_log = Window.partitionBy("log_id")
    earlier = per_log.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # every row but an unclosed last one has lost one byte; the reader skips a byte order mark of three
    missing = F.sum(F.col("bytes") + F.col("read")).over(per_log) - F.col("size")
    return blocks.select(
        "log_id",
        "block",
        "first",
        "read",
        (F.col("n") > F.col("read")).alias("uneven"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.when(missing.isin(1, -2) & (F.col("block") == F.max("block").over(per_log)), F.col("last")).alias("unclosed"),
    )


def _placed(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Numbered lines. ``splits`` is a written table, so its size is known and it meets the rows where they are."""
    placed = rows.join(splits.drop("read"), ["log_id", "block"])
    whole = F.split("value", OTHER_LINE_ENDS, -1)
    closed = F.element_at(whole, -1) == ""
    open_pieces = F.when(closed, F.slice(whole, 1, F.size(whole) - 1)).otherwise(whole)
    last = F.coalesce(F.col("id") == F.col("unclosed"), F.lit(False))
    placed = placed.withColumn("pieces", F.when(last, open_pieces).otherwise(_pieces()))
    found = placed.filter(~F.col("uneven")).withColumn("start", F.col("offset") + F.col("id") - F.col("first"))
    if not splits.filter("uneven").isEmpty():
        # splits with further line ends inside the reader's lines are counted through; a split has a bounded size
        inside = Window.partitionBy("log_id", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.size("pieces")).over(inside), F.lit(0))
        found = found.unionByName(placed.filter("uneven").withColumn("start", F.col("offset") + before))
    return found.select("log_id", "start", F.posexplode("pieces").alias("i", "raw_line")).select(
        "log_id", (F.col("start") + F.col("i") + 1).cast("bigint").alias("line_number"), "raw_line"
    )


def large_file_lines(spark: SparkSession, path: str, above: int = -1, stage: Stage | None = None) -> DataFrame:
    """Lines of files read in splits, numbered without gathering a file; the same lines as those of whole files.

    Rows keep file order inside a split, so a line's number is its rank in the split plus the lines of all earlier
    splits of the file. One pass makes the table of splits, which ``stage`` writes; a second one numbers rows in place.
    Only splits that hold rarer line ends are put in order one by one, which reads them once more and shuffles their rows.
    Whether a file's last line is closed follows from its size and the bytes of its rows.
    """
    rows = _rows(spark, path, above, None)
    return _placed(rows, (stage or Staging(spark).table)("splits", _splits(rows)))


def read(spark: SparkSession, path: str, cfg: Settings, stage: Stage | None = None) -> Logs:
    """Every file below ``path`` as one log, bad bytes replaced, guards applied. Files of no bytes are not listed.

    Files up to ``whole_file_bytes`` are read as one string each, larger ones as in ``large_file_lines``. Both give the
    same log ids, lines and verdicts of the guards. Compressed files (known by their names) are decompressed in splits at
    every size; their last line counts as closed, and the size guard looks at the bytes stored. A guard that looks into
    files reads each of the small ones once for its verdict, which ``stage`` writes.
    """
    stage = stage or Staging(spark).table
    limit = cfg.whole_file_bytes if cfg.max_bytes is None else min(cfg.whole_file_bytes, cfg.max_bytes)
    files = _files(spark, path)  # listed once for both
    texts = _whole_files(files, limit)
    small = from_texts(texts, cfg)
    accepted, rejected = small.logs, small.quarantine
    if cfg.max_line_breaks is not None:
        # a narrow row per file, gathered from the many tasks that open files into few partitions
        verdicts = stage("verdicts", judge(texts, cfg).select("log_id", "reason").repartition("log_id"))
        accepted = verdicts.filter(F.col("reason").isNull()).select("log_id")
        rejected = verdicts.filter(F.col("reason").isNotNull())
    if cfg.max_bytes is not None:
        rejected = rejected.unionByName(_oversized(files, cfg.max_bytes))
    rows = _rows(spark, path, limit, cfg.max_bytes)
    splits = stage("splits", _splits(rows))
    breaks = F.sum("read") - F.count("unclosed")
    totals = splits.groupBy("log_id").agg(breaks.alias("breaks"))
    large = _placed(rows, splits)
    if cfg.max_line_breaks is not None:
        over = totals.filter(F.col("breaks") > cfg.max_line_breaks).select("log_id")
        large = large.join(over, "log_id", "left_anti")
        totals = totals.join(over, "log_id", "left_anti")
        rejected = rejected.unionByName(over.withColumn("reason", F.lit("too_many_lines")))
    return Logs(
        accepted.unionByName(totals.select("log_id")), small.lines.unionByName(large), rejected
    )
