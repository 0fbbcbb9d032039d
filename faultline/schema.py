"""Schemas of the tables that operators exchange, as column -> type."""

LOG_LINES = {"log_id": "string", "line_number": "bigint", "raw_line": "string"}

# columns that every parse fills
ENTRY_FIELDS = {
    "ts": "timestamp_ntz",
    "level": "string",
    "source": "string",
    "message": "string",
    "service": "string",
    "host": "string",
    "request_id": "string",
    "status_code": "int",
    "response_time_ms": "double",
    "stack_trace": "string",
    "metadata": "map<string,string>",
}

LOG_ENTRIES = LOG_LINES | ENTRY_FIELDS

ANOMALIES = {
    "log_id": "string",
    "ts": "timestamp_ntz",
    "anomaly_type": "string",
    "severity": "string",
    "description": "string",
    "affected_lines": "array<bigint>",
    "z_score": "double",
    "baseline_value": "double",
    "observed_value": "double",
}

EVAL_CASES = {
    "id": "string",
    "description": "string",
    "log_text": "string",
    "expected_log_source": "string",
    "expected_anomaly_types": "array<string>",
    "expected_root_cause_category": "string",
    "expected_severity": "string",
    "expected_min_clusters": "int",
    "expect_no_anomalies": "boolean",
}

HISTORY = {
    "id": "string",
    "ts": "timestamp_ntz",
    "title": "string",
    "severity": "string",
    "log_source": "string",
    "total_lines": "bigint",
    "cluster_count": "bigint",
    "anomaly_count": "bigint",
    "bookmarked": "boolean",
}

ERROR_LEVELS = ("ERROR", "CRITICAL")


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())
