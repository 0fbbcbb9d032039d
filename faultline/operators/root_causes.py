"""Rule-based root-cause hypotheses (R1-R9, A8, A9). One aggregate per log evaluates every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.text import bind, contains_any, pattern
from faultline.operators import ordered

# rules that quote their matches
QUOTED = {"memory": fixed.MEMORY, "resource_exhaustion": fixed.EXHAUSTION, "network": fixed.NETWORK}


def _configuration_file(text: Column) -> Column:
    return text.contains("filenotfounderror") & text.rlike(pattern(fixed.CONFIGURATION_FILE))


def _db_port(text: Column) -> Column:
    return text.contains(":") & text.rlike(pattern(fixed.DB_PORT))


def _gateway_status(text: Column) -> Column:
    return text.contains("50") & text.rlike(pattern(fixed.BAD_GATEWAY_WORD))


def _words(words):
    return lambda text: contains_any(text, words)


# signal -> test on lowered text; plain words are searched as bytes, patterns only run where their fixed part occurs
SIGNALS = {
    "refused": _words(("connection refused",)),
    "db_port": _db_port,
    "too_many": _words(("too many connections",)),
    "password": _words(("password authentication failed",)),
    "sqlalchemy": _words(("sqlalchemy",)),
    "operational": _words(("operationalerror",)),
    "no_server": _words(("could not connect to server",)),
    "memory": _words(fixed.MEMORY),
    "killed": _words(("killed",)),
    "oom": _words(("oom",)),
    "gateway_status": _gateway_status,
    "upstream": _words(("upstream timed out", "bad gateway")),
    "health_check": _words(("health check",)),
    "fail": _words(("fail",)),
    "exhaustion": _words(fixed.EXHAUSTION),
    "misconfigured": lambda text: contains_any(text, fixed.CONFIGURATION) | _configuration_file(text),
    "configuration": _words(("configuration error",)),
    "code": _words(fixed.CODE_ERROR),
    "network": _words(fixed.NETWORK),
}


def signals(entries: DataFrame) -> DataFrame:
    """Per log, whether each signal occurs anywhere, and the first time of each rule's own signal."""
    lowered = entries.select(
        "log_id",
        "ts",
        F.lower(F.coalesce("message", F.lit(""))).alias("text"),
        F.lower("stack_trace").alias("trace"),
    )
    text, trace = F.col("text"), F.col("trace")
    # no signal spans the line break between message and trace, so both are searched on their own
    tested = lowered.select(
        "log_id",
        "ts",
        F.coalesce(trace != "", F.lit(False)).alias("traced"),
        text.contains("connection").alias("connection"),
        text.rlike(fixed.BAD_GATEWAY_ANYWHERE).alias("gateway_digits"),
        *[test(text).alias(f"m_{name}") for name, test in SIGNALS.items()],
        *[
            F.when(trace.isNotNull(), bind(trace, test)).otherwise(F.lit(False)).alias(f"t_{name}")
            for name, test in SIGNALS.items()
        ],
    )
    # what a message must show to be the first signal of a rule
    firsts = {
        "database": "connection",
        "memory": "m_memory",
        "dependency": "gateway_digits",
        "resource_exhaustion": "m_exhaustion",
        "configuration": "m_misconfigured",
        "code_error": "traced",
        "network": "m_network",
    }
    return tested.groupBy("log_id").agg(
        F.bool_or("traced").alias("traced"),
        *[F.bool_or(F.col(f"m_{name}") | F.col(f"t_{name}")).alias(name) for name in SIGNALS],
        *[F.min(F.when(F.col(hit), F.col("ts"))).alias(f"first_{rule}") for rule, hit in firsts.items()],
    )


def quoted_evidence(entries: DataFrame, count: int = 3) -> DataFrame:
    """The first matches of each quoting rule in line and text order, per log."""
    every_word = [word for words in QUOTED.values() for word in words]
    lowered = F.lower(F.concat_ws("\n", "message", "stack_trace"))
    rows = entries.select("log_id", "line_number", lowered.alias("text"))
    rows = rows.filter(contains_any(F.col("text"), every_word))
    per_rule = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.slice(F.regexp_extract_all("text", F.lit("|".join(words)), F.lit(0)), 1, count).alias("matches"),
            )
            for rule, words in QUOTED.items()
        ]
    )
    exploded = rows.select("log_id", "line_number", F.explode(per_rule).alias("r")).select(
        "log_id", "line_number", "r.rule", F.posexplode("r.matches").alias("place", "match")
    )
    first = ordered.top(exploded, ["log_id", "rule"], [F.col("line_number"), F.col("place")], count)
    return first.groupBy("log_id", "rule").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_number", "place", "match"))), lambda m: m["match"]
        ).alias("evidence")
    )


def _listed(pairs) -> Column:
    """Array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]))


def analyse(entries: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Every matching rule of every log, ranked (``pos`` from 1). ``logs`` adds logs without entries."""
    found = signals(entries)
    quoted = quoted_evidence(entries)
    quoted = quoted.groupBy("log_id").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("evidence"))).alias(f"quoted_{rule}") for rule in QUOTED]
    )
    found = found.join(quoted, "log_id", "left")
    if logs is not None:
        found = logs.select("log_id").join(found, "log_id", "left")

    def has(*names: str) -> Column:
        flag = F.lit(True)
        for name in names:
            flag = flag & F.coalesce(F.col(name), F.lit(False))
        return flag

    database = _listed(
        zip(
            [has("refused", "db_port"), has("too_many"), has("password"), has("sqlalchemy", "operational"),
             has("no_server")],
            fixed.DATABASE_EVIDENCE,
        )
    )
    dependency = _listed(
        zip([has("gateway_status"), has("upstream"), has("health_check", "fail")], fixed.DEPENDENCY_EVIDENCE)
    )
    several = {name: F.when(F.size(ev) >= 2, "high").otherwise("medium") for name, ev in
               (("database", database), ("dependency", dependency))}
    memory = F.coalesce("quoted_memory", F.array(F.lit(fixed.MEMORY_EVIDENCE)))
    # rule -> (matched, confidence, evidence)
    rules = {
        "database": (F.size(database) > 0, several["database"], database),
        "memory": (has("memory") | has("killed", "oom"), F.lit("high"), memory),
        "dependency": (F.size(dependency) > 0, several["dependency"], dependency),
        "resource_exhaustion": (has("exhaustion"), F.lit("high"), F.col("quoted_resource_exhaustion")),
        "configuration": (has("misconfigured") | has("configuration"), F.lit("medium"), F.array(F.lit(fixed.CONFIGURATION_EVIDENCE))),
        "code_error": (
            has("traced") | has("code"),
            F.when(has("traced"), "high").otherwise("medium"),
            F.array(F.lit(fixed.CODE_EVIDENCE)),
        ),
        "network": (has("network"), F.lit("medium"), F.col("quoted_network")),
    }

    def hypothesis(number: int, rule: str, confidence: Column, evidence: Column, first: Column) -> Column:
        category, text, actions = fixed.RULES[rule]
        return F.struct(
            F.lit(number).alias("rule"),
            F.lit(text).alias("hypothesis"),
            confidence.alias("confidence"),
            evidence.alias("evidence"),
            F.lit(category).alias("category"),
            first.alias("first_signal_at"),
            F.array(*[F.lit(a) for a in actions]).alias("recommended_actions"),
        )

    matched = F.array_compact(
        F.array(
            *[
                F.when(hit, hypothesis(number, rule, confidence, evidence, F.col(f"first_{rule}")))
                for number, (rule, (hit, confidence, evidence)) in enumerate(rules.items(), 1)
            ]
        )
    )
    nothing = F.array(
        hypothesis(
            8, "none", F.lit("low"), F.array(F.lit(fixed.NO_RULE_EVIDENCE)), F.lit(None).cast("timestamp_ntz")
        )
    )
    rows = found.select("log_id", matched.alias("matched")).select(
        "log_id", F.inline(F.when(F.size("matched") > 0, F.col("matched")).otherwise(nothing))
    )
    confidence = F.col("confidence")
    rank = F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)
    order = Window.partitionBy("log_id").orderBy(rank, F.col("first_signal_at").asc_nulls_last(), "rule")
    return rows.withColumn("pos", F.row_number().over(order).cast("bigint")).select(
        "log_id",
        "pos",
        "hypothesis",
        "confidence",
        "evidence",
        "category",
        "first_signal_at",
        "recommended_actions",
    )
