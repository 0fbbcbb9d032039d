"""Logs made from the driver's tables: structured entries, rendered text lines, document texts, history rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table read in fewer tasks than there are cores are dealt out; larger tables stay as they are read.

    Lanes make texts from numbers, so one small file would otherwise keep a single core busy.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def _id() -> Column:
    return F.col("event_id")


def _user() -> Column:
    return F.col("user_id")


def _by_type(**values) -> Column:
    kind = F.col("event_type")
    other = values.pop("other")
    chain = F
    for name, value in values.items():
        chain = chain.when(kind == name, value)
    return chain.otherwise(other)


def message() -> Column:
    """Error texts with volatile parts in six families, and short texts for all other events."""
    family = _id() % 6
    error = (
        F.when(family == 0, F.format_string("Connection refused to 10.%d.%d.7:5432 for request %d", _id() % 250, _user() % 250, _id()))
        .when(family == 1, F.format_string("Worker %d timed out reading /var/data/part-%d.bin", _id() % 97, _id() % 13))
        .when(family == 2, F.format_string("Job 0000aaaa-0000-4000-8000-%012d failed with exception", _id()))
        .when(family == 3, F.format_string("Container c%d OOMKilled after %d restarts", _id(), _user()))
        .when(family == 4, F.format_string("GET /api/v%d/orders 503 upstream timed out", _id() % 3))
        .otherwise(F.format_string("SSL certificate check failed for host %d", _user()))
    )
    plain = F.when(_id() % 40 == 0, F.format_string("service svc-%d started", _user() % 7)).otherwise(
        F.format_string("Handled %s %d", F.col("event_type"), _id())
    )
    return F.when(F.col("event_type") == "error", error).otherwise(plain)


def entries(events: DataFrame, logs: int = 4) -> DataFrame:
    """Lane A: one entry per event, ``logs`` logs."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    error = F.when(F.col("value") > 100, "CRITICAL").otherwise("ERROR")
    traced = (F.col("event_type") == "error") & (_id() % 50 == 3)
    trace = F.format_string("Traceback (most recent call last):\n  File \"a.py\", line %d\nKeyError: %d", _id(), _id())
    return events.select(
        F.concat(F.lit("log-"), (_user() % logs).cast("string")).alias("log_id"),
        (_id() + 1).alias("line_number"),
        F.col("props").alias("raw_line"),
        "ts",
        _by_type(error=error, signup=F.lit("WARNING"), other=F.lit("INFO")).alias("level"),
        F.lit("python").alias("source"),
        message().alias("message"),
        F.concat(F.lit("svc-"), (_user() % 7).cast("string")).alias("service"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("request_id"),
        F.lit(None).cast("int").alias("status_code"),
        F.col("value").alias("response_time_ms"),
        F.when(traced, trace).alias("stack_trace"),
        none.alias("metadata"),
    )


def quiet_entries(events: DataFrame) -> DataFrame:
    """Lane A with one log per user and errors that show exhaustion, misconfiguration or, for every third user, nothing."""
    third = _user() % 3
    full = F.when(_id() % 2 == 0, "No space left on device").otherwise("Too many open files")
    trouble = F.when(third == 0, full).when(third == 1, "invalid configuration in app.yaml").otherwise("quiet trouble")
    text = F.when(F.col("event_type") == "error", trouble).otherwise("quiet step")
    made = entries(events.withColumn("props", text), 100_000)
    return made.withColumn("message", F.col("raw_line")).withColumn("stack_trace", F.lit(None).cast("string"))


def _ts(layout: str) -> Column:
    return F.date_format("ts", layout)


def _status() -> Column:
    return _by_type(error=500 + _id() % 5, signup=F.lit(404), other=F.lit(200)).cast("int")


def _nginx_access() -> Column:
    return F.format_string(
        '10.0.%d.%d - - [%s +0200] "GET /api/v%d/%s?id=%d HTTP/1.1" %d 512 "-" "agent x" rt=%s',
        _user() % 256, _id() % 256, _ts("dd/MMM/yyyy:HH:mm:ss"), _id() % 7, F.col("event_type"), _id(), _status(),
        F.col("value").cast("string"),
    )


def _nginx_error() -> Column:
    word = _by_type(error="error", signup="warn", purchase="crit", click="alert", other=F.lit("notice"))
    return F.format_string("%s [%s] 12#12: *%d while reading %s", _ts("yyyy/MM/dd HH:mm:ss"), word, _id(), F.col("event_type"))


def _python_word() -> Column:
    return _by_type(error="ERROR", signup="WARN", purchase="CRITICAL", click="DEBUG", other=F.lit("NOTICE"))


def _python_std() -> Column:
    return F.format_string("%s %s app.mod:%d handled %s %d", _ts("yyyy-MM-dd HH:mm:ss,SSS"), _python_word(), _id() % 90, F.col("event_type"), _id())


def _python_std_line() -> Column:
    return F.format_string("%s %s app.worker%d:%d handled %s %d", _ts("yyyy-MM-dd HH:mm:ss"), _python_word(), _user() % 5, _id() % 90, F.col("event_type"), _id())


def _uvicorn() -> Column:
    return F.format_string('INFO:     10.0.0.%d:%d - "GET /v/%d HTTP/1.1" %d Phrase', _user() % 256, _id() % 60000, _id(), _status())


def _docker_rfc() -> Column:
    stream = _by_type(error="stderr", other=F.lit("stdout"))
    return F.format_string("%s123Z %s F ERROR or not %d", _ts("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), stream, _id())


def _docker_pipe() -> Column:
    return F.format_string("svc-%d   | %s %s handled %d", _user() % 7, _ts("yyyy-MM-dd HH:mm:ss"), _python_word(), _id())


def _k8s_event() -> Column:
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhd"]), (_id() % 4 + 1).cast("int"))
    age = F.when(_id() % 10 == 0, F.lit("5m30s")).otherwise(F.concat((_id() % 50).cast("string"), unit))
    kind = _by_type(error="Warning", other=F.lit("Normal"))
    return F.format_string("%s   %s   BackOff   pod/web-%d   handled %d", age, kind, _user(), _id())


def _kubectl() -> Column:
    return F.format_string("web-%d   main-%d   handled %s %d", _user(), _id() % 3, F.col("event_type"), _id())


def _syslog() -> Column:
    text = _by_type(error="Unit FAILED", signup="warning shown", purchase="Out of memory", other=F.lit("Started"))
    return F.format_string(
        "%s %s %s host-%d unit%s: %s %d",
        _ts("MMM"), F.lpad(_ts("d"), 2, " "), _ts("HH:mm:ss"), _user() % 9,
        F.when(_id() % 2 == 0, F.format_string("[%d]", _id())).otherwise(""), text, _id(),
    )


def _priority() -> Column:
    return F.format_string("<%d>%s %d", _id() % 8, F.col("event_type"), _id())


def _generic() -> Column:
    iso = F.format_string("at %s something %s happened %d", _ts("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.col("event_type"), _id())
    slashed = F.format_string("Warn: %s step %d", _ts("yyyy/MM/dd HH:mm:ss"), _id())
    return F.when(_id() % 3 == 0, iso).when(_id() % 3 == 1, slashed).otherwise(F.format_string("no mark %d", _id()))


CUSTOM_PATTERN = r"^(?P<timestamp>\S+ \S+) \| (?P<level>\w+) \| (?P<service>[\w-]*) \| (?P<message>.*)$"


# one pattern per log: all parts, a line without its time, and what the service's name is called elsewhere
CUSTOM_PATTERNS = {
    "own-0": CUSTOM_PATTERN,
    "own-1": r"\| (?P<level>\w+) \|.*\| (?P<message>.*)$",
    "own-2": r"^(?P<timestamp>\S+ \S+) \| \w+ \| (?P<host>[\w-]*) \| (?P<message>.*)$",
}


def _custom() -> Column:
    word = _by_type(error="err", signup="warn", purchase="fatal", click="debug", other=F.lit("note"))
    good = F.format_string("%s | %s | svc-%d | handled %d", _ts("yyyy-MM-dd HH:mm:ss.SSSSSS"), word, _user() % 7, _id())
    return F.when(_id() % 9 == 4, F.format_string("unreadable %d", _id())).otherwise(good)


def _k8s_table() -> Column:
    """Events with repeated table headers and lines of no form between them."""
    header = F.when(_id() % 50 == 0, "LAST SEEN   TYPE   REASON   OBJECT   MESSAGE")
    return F.coalesce(header, F.when(_id() % 11 == 5, F.format_string("unreadable %d", _id())), _k8s_event())


def _syslog_loose() -> Column:
    return F.when(_id() % 11 == 5, F.format_string("loose text %d", _id())).otherwise(_syslog())


def _python_prefixed() -> Column:
    prefix = _by_type(error="ERROR:    ", signup="INFO:     ", other=F.lit("    at "))
    return F.concat(prefix, F.format_string("handled %s %d", F.col("event_type"), _id()))


# rendered on their own, not part of the detection lanes
LOOSE_LINES = {"k8s_table": _k8s_table, "syslog_loose": _syslog_loose, "python_prefixed": _python_prefixed}

LINES = {
    "nginx_access": _nginx_access,
    "nginx_error": _nginx_error,
    "python_std": _python_std,
    "python_std_line": _python_std_line,
    "uvicorn": _uvicorn,
    "docker_rfc": _docker_rfc,
    "docker_pipe": _docker_pipe,
    "k8s_event": _k8s_event,
    "kubectl": _kubectl,
    "syslog": _syslog,
    "priority": _priority,
    "generic": _generic,
    "custom": _custom,
}


def lines(events: DataFrame, kind: str, logs: int = 3) -> DataFrame:
    """Lane B: every event as one line of one kind, dealt out over ``logs`` logs and numbered without gaps."""
    return events.select(
        F.concat(F.lit(f"{kind}-"), (_id() % logs).cast("string")).alias("log_id"),
        (F.floor(_id() / logs) + 1).cast("bigint").alias("line_number"),
        (LINES | LOOSE_LINES)[kind]().alias("raw_line"),
    )


def mixed_lines(events: DataFrame, logs: int = 5) -> DataFrame:
    """Lane B with formats mixed by event type: clicks and views as access lines, errors as application lines,
    signups as blank lines, purchases as text of no format."""
    text = _by_type(
        click=_nginx_access(),
        view=_nginx_access(),
        error=_python_std(),
        signup=F.lit("   "),
        other=F.format_string("free text %d", _id()),
    )
    return events.select(
        F.concat(F.lit("mixed-"), (_user() % logs).cast("string")).alias("log_id"),
        (_id() + 1).alias("line_number"),
        text.alias("raw_line"),
    )


def traceback_lines(events: DataFrame, logs: int = 2) -> DataFrame:
    """Lane B for multi-line entries: errors as tracebacks, every seventh of them without a closing line; all other
    events as single lines."""
    closing = F.when(_id() % 7 == 0, F.lit("KeyError")).otherwise(F.format_string("app.errors.Bad: value %d", _id()))
    trace = F.array(
        F.lit("Traceback (most recent call last):"),
        F.format_string('  File "app.py", line %d', _id()),
        F.when(_id() % 5 == 0, F.lit("")).otherwise(F.lit("    raise Bad()")),
        closing,
    )
    texts = F.when(F.col("event_type") == "error", trace).otherwise(F.array(_python_std()))
    return events.select(
        F.concat(F.lit("py-"), (_id() % logs).cast("string")).alias("log_id"),
        (_id() * 4).alias("first"),
        F.posexplode(texts).alias("i", "raw_line"),
    ).select("log_id", (F.col("first") + F.col("i") + 1).alias("line_number"), "raw_line")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Lane C: every document as one raw log."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("log_id"), "text"
    )


def vectors(spark: SparkSession, folder: str, per_log: int | None = 200) -> DataFrame:
    """Lane D: stored vectors, dealt out over logs of at most ``per_log`` templates each; one log for None."""
    dealt = F.concat(F.lit("log-"), F.floor(F.col("vec_id") / (per_log or 1)).cast("string"))
    return table(spark, folder, "embeddings").select(
        (F.lit("corpus") if per_log is None else dealt).alias("log_id"),
        F.col("vec_id").alias("ordinal"),
        "embedding",
        F.col("label").alias("kind"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Lane E: every order as one past analysis."""
    key = F.col("o_orderkey")
    priority = F.substring("o_orderpriority", 1, 1)
    severity = F.when(priority == "1", "P1").when(priority == "2", "P2").when(priority == "3", "P3").otherwise("P4")
    status = F.col("o_orderstatus")
    source = F.when(status == "O", "nginx").when(status == "F", "python").otherwise("docker")
    rows = table(spark, folder, "orders").select(
        key.cast("string").alias("id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        severity.alias("severity"),
        source.alias("log_source"),
        F.floor("o_totalprice").cast("bigint").alias("total_lines"),
        (key % 8).alias("cluster_count"),
        (key % 5).alias("anomaly_count"),
        (F.col("o_custkey") % 10 == 0).alias("bookmarked"),
    )
    title = F.concat(F.col("log_source"), F.lit(" analysis — "), F.col("severity"), F.lit(" ("), F.col("total_lines"), F.lit(" lines)"))
    return rows.withColumn("title", title)
