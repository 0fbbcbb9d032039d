"""The registered queries in SQL over the same tables, computed from source columns and not from rendered text."""

from __future__ import annotations

from faultline import fixed_values as fixed

STAMP = "%Y-%m-%d %H:%M:%S.%f"

_MESSAGE = """CASE WHEN event_type = 'error' THEN CASE event_id % 6
    WHEN 0 THEN printf('Connection refused to 10.%d.%d.7:5432 for request %d', event_id % 250, user_id % 250, event_id)
    WHEN 1 THEN printf('Worker %d timed out reading /var/data/part-%d.bin', event_id % 97, event_id % 13)
    WHEN 2 THEN printf('Job 0000aaaa-0000-4000-8000-%012d failed with exception', event_id)
    WHEN 3 THEN printf('Container c%d OOMKilled after %d restarts', event_id, user_id)
    WHEN 4 THEN printf('GET /api/v%d/orders 503 upstream timed out', event_id % 3)
    ELSE printf('SSL certificate check failed for host %d', user_id) END
  WHEN event_id % 40 = 0 THEN printf('service svc-%d started', user_id % 7)
  ELSE printf('Handled %s %d', event_type, event_id) END"""


def _entries(logs: int = 4, log_id: str | None = None) -> str:
    """Lane A as a common table expression ``e``."""
    log_id = log_id or f"'log-' || (user_id % {logs})"
    return f"""e AS (SELECT {log_id} AS log_id, event_id + 1 AS line_number, ts, event_type, event_id, user_id,
  CASE WHEN event_type = 'error' AND value > 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
       WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  value AS response_time_ms, 'svc-' || (user_id % 7) AS service, {_MESSAGE} AS message,
  CASE WHEN event_type = 'error' AND event_id % 50 = 3 THEN 'Traceback (most recent call last): KeyError' END AS stack_trace,
  (event_type = 'error')::INT AS is_error FROM events)"""


def _stamp(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '{STAMP}') AS {alias or column}"


# --- detectors -----------------------------------------------------------------------------------------------------


def _rates(width: str) -> str:
    return f"""r AS (SELECT log_id, time_bucket(INTERVAL '{width}', ts) AS w, count(*) AS total,
    CAST(sum(is_error) AS BIGINT) AS errors, sum(is_error) / count(*)::DOUBLE AS rate FROM e GROUP BY 1, 2),
  st AS (SELECT log_id, avg(rate) AS mean, CASE WHEN min(rate) < max(rate) THEN stddev_pop(rate) END AS spread,
    count(*) AS windows, CAST(sum(total) AS BIGINT) AS timed FROM r GROUP BY 1),
  z AS (SELECT r.*, mean, windows, timed, abs((rate - mean) / spread) AS z,
    row_number() OVER (PARTITION BY log_id ORDER BY w) AS number FROM r JOIN st USING (log_id))"""


def _spikes(width: str, threshold: float) -> str:
    return f"""sp AS (SELECT z.log_id, z.w AS ts, 'error_spike' AS anomaly_type,
    CASE WHEN rate > 0.5 THEN 'high' ELSE 'medium' END AS severity,
    (SELECT list(line_number ORDER BY line_number)[1:200] FROM e
      WHERE e.log_id = z.log_id AND time_bucket(INTERVAL '{width}', e.ts) = z.w) AS lines,
    z AS z_score, mean AS baseline_value, rate AS observed_value
  FROM z WHERE timed >= 5 AND windows >= 3 AND z > {threshold} AND rate > mean AND rate > 0)"""


def _latency(threshold: float) -> str:
    return f"""ls AS (SELECT log_id, avg(response_time_ms) AS mu, stddev_pop(response_time_ms) AS sd, count(*) AS n
    FROM e WHERE response_time_ms > 0 GROUP BY 1),
  la AS (SELECT e.log_id, ts, 'latency_spike' AS anomaly_type, 'medium' AS severity, [line_number] AS lines,
    (response_time_ms - mu) / coalesce(nullif(sd, 0), 1e-6) AS z_score, mu AS baseline_value,
    response_time_ms AS observed_value
  FROM e JOIN ls USING (log_id) WHERE n >= 10 AND response_time_ms > 0
    AND (response_time_ms - mu) / coalesce(nullif(sd, 0), 1e-6) > {threshold})"""


_SILENCE = """g AS (SELECT log_id, ts, line_number AS lb, lag(line_number) OVER o AS la,
    (epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 1e6 AS gap
    FROM e WINDOW o AS (PARTITION BY log_id ORDER BY ts, line_number)),
  gs AS (SELECT log_id, avg(gap) FILTER (gap > 0) AS mu, stddev_pop(gap) FILTER (gap > 0) AS sd,
    count(*) FILTER (gap > 0) AS n, count(*) AS timed FROM g GROUP BY 1),
  si AS (SELECT g.log_id, ts, 'silence' AS anomaly_type,
    CASE WHEN gap > mu + 5 * sd THEN 'high' ELSE 'medium' END AS severity, [la, lb] AS lines,
    (gap - mu) / sd AS z_score, mu AS baseline_value, gap AS observed_value
  FROM g JOIN gs USING (log_id) WHERE timed >= 5 AND n >= 3 AND gap > mu + 3 * sd AND gap > 60)"""


def _cascades(width: str, threshold: float) -> str:
    return f"""fl AS (SELECT *, number - row_number() OVER (PARTITION BY log_id ORDER BY w) AS run FROM z
    WHERE timed >= 10 AND windows >= 4 AND z > {threshold} AND rate > coalesce(nullif(mean, 0), 1e-6) * 1.5),
  ru AS (SELECT log_id, run, min(w) AS ts, max(z) AS z_score, any_value(coalesce(nullif(mean, 0), 1e-6)) AS mean,
    avg(rate) AS observed FROM fl GROUP BY 1, 2 HAVING count(*) >= 3),
  ll AS (SELECT fl.log_id, fl.run, fl.w, line_number,
      row_number() OVER (PARTITION BY fl.log_id, fl.w ORDER BY line_number) AS rn
    FROM fl JOIN e ON e.log_id = fl.log_id AND time_bucket(INTERVAL '{width}', e.ts) = fl.w AND is_error = 1),
  ca AS (SELECT ru.log_id, ru.ts, 'cascade_failure' AS anomaly_type, 'critical' AS severity,
    (SELECT list(line_number ORDER BY w, line_number)[1:300] FROM ll
      WHERE ll.log_id = ru.log_id AND ll.run = ru.run AND rn <= 50) AS lines,
    z_score, mean AS baseline_value, observed AS observed_value FROM ru)"""


def _flat(source: str) -> str:
    return f"""SELECT log_id, {_stamp('ts')}, anomaly_type, severity, array_to_string(lines, ',') AS affected_lines,
  round(z_score, 6) AS z_score, round(baseline_value, 6) AS baseline_value, round(observed_value, 6) AS observed_value
  FROM {source}"""


_UNION = "u AS (SELECT * FROM sp UNION ALL SELECT * FROM la UNION ALL SELECT * FROM si UNION ALL SELECT * FROM ca)"


def _all(width: str, threshold: float) -> str:
    return ", ".join(
        [_entries(), _rates(width), _spikes(width, threshold), _latency(threshold), _SILENCE,
         _cascades(width, threshold), _UNION]
    )


_RANK = """CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
  ts, CASE anomaly_type WHEN 'error_spike' THEN 0 WHEN 'latency_spike' THEN 1 WHEN 'silence' THEN 2 ELSE 3 END, lines[1]"""

DETECTORS = {
    "error_rate_by_window": f"""WITH {_entries()}, {_rates('1 hour')}
  SELECT log_id, {_stamp('w', 'window_start')}, total, errors, round(rate, 6) AS rate FROM r""",
    "window_scores": f"""WITH {_entries()}, {_rates('1 hour')}
  SELECT log_id, {_stamp('w', 'window_start')}, round(z, 6) AS z, round(mean, 6) AS mean, windows, timed FROM z""",
    "error_spikes": f"WITH {_entries()}, {_rates('1 hour')}, {_spikes('1 hour', 2.5)} {_flat('sp')}",
    "latency_spikes": f"WITH {_entries()}, {_latency(2.5)} {_flat('la')}",
    "silence_gaps": f"WITH {_entries()}, {_SILENCE} {_flat('si')}",
    "cascade_failures": f"WITH {_entries()}, {_rates('1 minute')}, {_cascades('1 minute', 1.5)} {_flat('ca')}",
    "all_anomalies": f"WITH {_all('1 minute', 1.5)} {_flat('u')}",
    "leading_anomalies": f"""WITH {_all('1 hour', 2.5)},
  l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY {_RANK}) <= 20) {_flat('l')}""",
}

# --- summary -------------------------------------------------------------------------------------------------------

_TOP = """t AS (SELECT log_id, message, count(*) AS count, min(line_number) AS first_line FROM e WHERE is_error = 1
    GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY count(*) DESC, min(line_number)) <= 5)"""

_STATS = """s AS (SELECT log_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
    sum(is_error) / count(*)::DOUBLE AS error_rate, count(*) FILTER (level = 'WARNING') / count(*)::DOUBLE AS warning_rate,
    count(*) FILTER (level = 'CRITICAL') AS critical_count FROM e GROUP BY 1)"""

SUMMARY = {
    "log_summary": f"""WITH {_entries()}, {_TOP}, {_STATS}
  SELECT s.log_id, n AS total_lines, n AS parsed_lines, 0::BIGINT AS skipped_lines, {_stamp('first_ts')}, {_stamp('last_ts')},
    round(error_rate, 6) AS error_rate, round(warning_rate, 6) AS warning_rate, critical_count,
    (SELECT string_agg(message, '|' ORDER BY count DESC, first_line) FROM t WHERE t.log_id = s.log_id) AS top_error_messages
  FROM s""",
    "top_error_messages": f"WITH {_entries()}, {_TOP} SELECT log_id, message, count, first_line FROM t",
    "top_errors_in_two_passes": f"WITH {_entries()}, {_TOP} SELECT log_id, message, count, first_line FROM t",
    "level_distribution": f"""WITH {_entries(100_000)}, {_STATS}
  SELECT log_id, 'INFO' AS level, round(greatest(0.0, 1 - error_rate - warning_rate), 6) AS share FROM s
  UNION ALL SELECT log_id, 'WARN', round(warning_rate, 6) FROM s UNION ALL SELECT log_id, 'ERROR', round(error_rate, 6) FROM s""",
}

# --- parsing -------------------------------------------------------------------------------------------------------


def _dealt(kind: str, logs: int = 3) -> str:
    return f"'{kind}-' || (event_id % {logs}) AS log_id, event_id // {logs} + 1 AS line_number"


def _type(other: str, **values: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {value}" for name, value in values.items())
    return f"CASE event_type {cases} ELSE {other} END"


_STATUS = _type("200", error="500 + event_id % 5", signup="404")
_STATUS_LEVEL = _type("'INFO'", error="'ERROR'", signup="'WARNING'")
_WORD_LEVEL = _type("'UNKNOWN'", error="'ERROR'", signup="'WARNING'", purchase="'CRITICAL'", click="'DEBUG'")
_SECOND = "date_trunc('second', ts)"
_MILLI = "date_trunc('millisecond', ts)"
_HANDLED = "printf('handled %s %d', event_type, event_id)"


def _parse(kind: str, level: str, message: str, *columns: str) -> str:
    rest = "".join(f", {c}" for c in columns)
    return f"SELECT {_dealt(kind)}, {level} AS level, {message} AS message{rest} FROM events"


def _every_line(kind: str, header: str, skipped: str, level: str, message: str) -> str:
    return f"""SELECT log_id, line_number, NOT header AND NOT skipped AS is_entry, skipped AND NOT header AS is_skipped,
    CASE WHEN NOT header AND NOT skipped THEN level END AS level, CASE WHEN NOT header AND NOT skipped THEN message END AS message
  FROM (SELECT {_dealt(kind)}, {header} AS header, {skipped} AS skipped, {level} AS level, {message} AS message FROM events)"""


PARSERS = {
    "parse_nginx_access": _parse(
        "nginx_access", _STATUS_LEVEL, f"printf('GET /api/v%d/%s?id=%d %d', event_id % 7, event_type, event_id, {_STATUS})",
        _stamp(f"{_SECOND} - INTERVAL 2 HOUR", "ts"), f"CAST({_STATUS} AS BIGINT) AS status_code",
        "round(value * 1000, 6) AS response_time_ms",
        "printf('/api/v%d/%s?id=%d', event_id % 7, event_type, event_id) AS path"),
    "parse_nginx_error": _parse(
        "nginx_error", _type("'INFO'", error="'ERROR'", purchase="'ERROR'", signup="'WARNING'"),
        "printf('12#12: *%d while reading %s', event_id, event_type)", _stamp(_SECOND, "ts")),
    "parse_python_std": _parse("python_std", _WORD_LEVEL, _HANDLED, _stamp(_MILLI, "ts")),
    "parse_python_std_line": _parse(
        "python_std_line", _WORD_LEVEL, _HANDLED, _stamp(_SECOND, "ts"), "'app.worker' || (user_id % 5) AS service"),
    "parse_uvicorn": _parse(
        "uvicorn", _STATUS_LEVEL, f"printf('\"GET /v/%d HTTP/1.1\" %d', event_id, {_STATUS})",
        f"CAST({_STATUS} AS BIGINT) AS status_code"),
    "parse_docker_rfc": _parse(
        "docker_rfc", _type("'INFO'", error="'WARNING'"), "printf('ERROR or not %d', event_id)", _stamp("ts"),
        f"{_type(chr(39) + 'stdout' + chr(39), error=chr(39) + 'stderr' + chr(39))} AS stream"),
    "parse_docker_pipe": _parse(
        "docker_pipe", _type("'INFO'", error="'ERROR'", signup="'WARNING'", click="'DEBUG'"),
        "'handled ' || event_id", _stamp(_SECOND, "ts"), "'svc-' || (user_id % 7) AS service"),
    "parse_k8s_events": _parse(
        "k8s_event", _type("'INFO'", error="'WARNING'"), "'BackOff: handled ' || event_id",
        _stamp("""CASE WHEN event_id % 10 <> 0 THEN TIMESTAMP '2024-02-01' - to_seconds((event_id % 50) *
          CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END) END""", "ts"),
        "'pod/web-' || user_id AS service", "'BackOff' AS reason",
        "CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type"),
    "parse_kubectl": _parse(
        "kubectl", _type("'INFO'", error="'ERROR'"), _HANDLED,
        "printf('web-%d/main-%d', user_id, event_id % 3) AS service"),
    "parse_syslog": _parse(
        "syslog", _type("'INFO'", error="'ERROR'", signup="'WARNING'", purchase="'CRITICAL'"),
        f"{_type(chr(39) + 'Started' + chr(39), error=repr('Unit FAILED'), signup=repr('warning shown'), purchase=repr('Out of memory'))} || ' ' || event_id",
        _stamp(_SECOND, "ts"), "'host-' || (user_id % 9) AS host", "'unit' AS service",
        "CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS pid"),
    "parse_priority": _parse(
        "priority", """CASE WHEN event_id % 8 <= 2 THEN 'CRITICAL' WHEN event_id % 8 = 3 THEN 'ERROR'
          WHEN event_id % 8 = 4 THEN 'WARNING' WHEN event_id % 8 <= 6 THEN 'INFO' ELSE 'DEBUG' END""",
        "event_type || ' ' || event_id"),
    "parse_generic": _parse(
        "generic", """CASE WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'ERROR'
          WHEN event_id % 3 = 1 THEN 'WARNING' ELSE 'UNKNOWN' END""",
        """CASE event_id % 3 WHEN 0 THEN printf('at %s something %s happened %d',
          strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g'), event_type, event_id)
          WHEN 1 THEN printf('Warn: %s step %d', strftime(ts, '%Y/%m/%d %H:%M:%S'), event_id)
          ELSE 'no mark ' || event_id END""",
        _stamp(f"CASE WHEN event_id % 3 < 2 THEN {_SECOND} END", "ts")),
    "parse_custom": _parse(
        "custom", f"""CASE WHEN event_id % 9 = 4 THEN 'UNKNOWN' ELSE
          {_type("'UNKNOWN'", error="'ERROR'", signup="'WARNING'", purchase="'CRITICAL'", click="'DEBUG'")} END""",
        "CASE WHEN event_id % 9 = 4 THEN 'unreadable ' || event_id ELSE 'handled ' || event_id END",
        _stamp("CASE WHEN event_id % 9 <> 4 THEN ts END", "ts"),
        "CASE WHEN event_id % 9 <> 4 THEN 'svc-' || (user_id % 7) END AS service"),
    "parse_custom_many": f"""SELECT log_id, line_number, CASE WHEN bad OR own = 2 THEN 'UNKNOWN' ELSE known END AS level,
    message, CASE WHEN NOT bad AND own <> 1 THEN stamp END AS ts, CASE WHEN NOT bad AND own = 0 THEN svc END AS service,
    CASE WHEN NOT bad AND own = 2 THEN svc END AS host, bad AS is_skipped
  FROM (SELECT {_dealt('custom')}, event_id % 3 AS own, event_id % 9 = 4 AS bad, 'svc-' || (user_id % 7) AS svc, {_stamp('ts', 'stamp')},
    {_type("'UNKNOWN'", error="'ERROR'", signup="'WARNING'", purchase="'CRITICAL'", click="'DEBUG'")} AS known,
    CASE WHEN event_id % 9 = 4 THEN 'unreadable ' || event_id ELSE 'handled ' || event_id END AS message FROM events)""",
    "parse_k8s_table": _every_line(
        "k8s_table", "event_id % 50 = 0", "event_id % 11 = 5", _type("'INFO'", error="'WARNING'"), "'BackOff: handled ' || event_id"),
    "parse_syslog_loose": _every_line(
        "syslog_loose", "FALSE", "event_id % 11 = 5",
        _type("'INFO'", error="'ERROR'", signup="'WARNING'", purchase="'CRITICAL'"),
        f"{_type(chr(39) + 'Started' + chr(39), error=repr('Unit FAILED'), signup=repr('warning shown'), purchase=repr('Out of memory'))} || ' ' || event_id"),
    "parse_python_prefixed": _every_line(
        "python_prefixed", "FALSE", "FALSE", _type("'INFO'", error="'ERROR'"),
        f"{_type(repr('    at '), error=repr('ERROR:    '), signup=repr('INFO:     '))} || {_HANDLED}"),
    "custom_confidence": f"""SELECT 'custom-' || (event_id % 3) AS log_id,
  round(avg((event_id % 9 <> 4)::INT), 6) AS confidence FROM events GROUP BY 1""",
    "traceback_merge": """WITH t AS (SELECT 'py-' || (event_id % 2) AS log_id, event_id * 4 + 1 AS first, event_type, event_id,
    printf('%s %s app.mod:%d handled %s %d', strftime(ts, '%Y-%m-%d %H:%M:%S,%g'),
      CASE event_type WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'CRITICAL' WHEN 'click' THEN 'DEBUG' ELSE 'NOTICE' END,
      event_id % 90, event_type, event_id) AS single,
    CASE event_type WHEN 'signup' THEN 'WARNING' WHEN 'purchase' THEN 'CRITICAL' WHEN 'click' THEN 'DEBUG' ELSE 'UNKNOWN' END AS level,
    printf('  File "app.py", line %d', event_id) AS l2,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE '    raise Bad()' END AS l3,
    printf('app.errors.Bad: value %d', event_id) AS l4, 'Traceback (most recent call last):' AS l1 FROM events)
  SELECT log_id, first AS line_number, single AS raw_line, level, printf('handled %s %d', event_type, event_id) AS message,
    NULL::VARCHAR AS stack_trace FROM t WHERE event_type <> 'error'
  UNION ALL SELECT log_id, first, l1, 'ERROR', CASE WHEN event_id % 7 = 0 THEN l3 ELSE l4 END,
    l1 || chr(10) || l2 || chr(10) || l3 || CASE WHEN event_id % 7 = 0 THEN '' ELSE chr(10) || l4 END FROM t WHERE event_type = 'error'
  UNION ALL SELECT log_id, first + 3, 'KeyError', 'INFO', 'KeyError', NULL FROM t WHERE event_type = 'error' AND event_id % 7 = 0""",
}

# which detector each kind of rendered line answers to, and for which lines
_HITS = {
    "nginx_access": ("nginx", "TRUE"),
    "nginx_error": ("nginx", "TRUE"),
    "python_std": ("python", "TRUE"),
    "python_std_line": ("python", "TRUE"),
    "uvicorn": ("python", "TRUE"),
    "docker_rfc": ("docker", "TRUE"),
    "docker_pipe": ("docker", "TRUE"),
    "k8s_event": ("kubernetes", "TRUE"),
    "kubectl": ("", "FALSE"),
    "syslog": ("systemd", "TRUE"),
    "priority": ("systemd", "TRUE"),
    "generic": ("", "FALSE"),
    "custom": ("docker", "FALSE"),
}


def _kind_lines() -> str:
    """All lines of all kinds as ``k(log_id, line_number, kind, hit, event columns)``."""
    parts = [
        f"""SELECT 'mixed-' || (user_id % 5) AS log_id, event_id + 1 AS line_number, 'mixed' AS kind,
      CASE event_type WHEN 'click' THEN 'nginx' WHEN 'view' THEN 'nginx' WHEN 'error' THEN 'python' ELSE '' END AS hit,
      event_type, event_id FROM events"""
    ]
    for kind, (hit, when) in _HITS.items():
        parts.append(
            f"""SELECT {_dealt(kind)}, '{kind}' AS kind, CASE WHEN {when} THEN '{hit}' ELSE '' END AS hit,
      event_type, event_id FROM events"""
        )
    return "k AS (" + " UNION ALL ".join(parts) + ")"


_SCORES = """sc AS (SELECT log_id, count(*) AS n, least(1.0, count(*) FILTER (hit = 'nginx') / count(*)::DOUBLE * 1.2) AS nginx,
    least(1.0, count(*) FILTER (hit = 'python') / count(*)::DOUBLE * 1.1) AS python,
    least(1.0, count(*) FILTER (hit = 'docker') / count(*)::DOUBLE) AS docker,
    least(1.0, count(*) FILTER (hit = 'kubernetes') / count(*)::DOUBLE) AS kubernetes,
    least(1.0, count(*) FILTER (hit = 'systemd') / count(*)::DOUBLE) AS systemd
    FROM k WHERE line_number <= 20 GROUP BY 1),
  f AS (SELECT *, greatest(nginx, python, docker, kubernetes, systemd) AS best, CASE WHEN best <= 0.3 THEN 'generic'
    WHEN nginx = best THEN 'nginx' WHEN python = best THEN 'python' WHEN docker = best THEN 'docker'
    WHEN kubernetes = best THEN 'kubernetes' ELSE 'systemd' END AS format FROM sc)"""

DETECTION = {
    "detect_scores": f"""WITH {_kind_lines()}, {_SCORES} SELECT log_id, n AS sample_size, round(nginx, 6) AS nginx,
  round(python, 6) AS python, round(docker, 6) AS docker, round(kubernetes, 6) AS kubernetes, round(systemd, 6) AS systemd FROM sc""",
    "detect_format": f"""WITH {_kind_lines()}, {_SCORES}
  SELECT log_id, format, CASE WHEN format = 'generic' THEN 'unknown' ELSE format END AS log_source FROM f""",
}

DETECTION["detect_empty_logs"] = """SELECT 'nginx_access-' || (event_id % 3) AS log_id, 'nginx' AS format, 'nginx' AS log_source,
    1.0::DOUBLE AS score, count(*) AS total_lines FROM events GROUP BY 1
  UNION ALL SELECT DISTINCT 'empty-' || user_id, 'generic', 'unknown', 0.0, 0 FROM events"""

# kind -> when an entry is an error, when it has a time; the last three are read by the generic format
_ENTRY = {
    "nginx_access": ("event_type = 'error'", "TRUE"),
    "nginx_error": ("event_type IN ('error', 'purchase')", "TRUE"),
    "python_std": ("event_type IN ('error', 'purchase')", "TRUE"),
    "python_std_line": ("event_type IN ('error', 'purchase')", "TRUE"),
    "uvicorn": ("event_type = 'error'", "FALSE"),
    "docker_rfc": ("FALSE", "TRUE"),
    "docker_pipe": ("event_type = 'error'", "TRUE"),
    "k8s_event": ("FALSE", "event_id % 10 <> 0"),
    "syslog": ("event_type IN ('error', 'purchase')", "TRUE"),
    "priority": ("event_id % 8 <= 3", "FALSE"),
    "kubectl": ("event_type = 'error'", "FALSE"),
    "generic": ("event_type = 'error' AND event_id % 3 = 0", "event_id % 3 < 2"),
    "custom": ("FALSE", "event_id % 9 <> 4"),
}


def _detected_counts() -> str:
    error = " ".join(f"WHEN '{kind}' THEN {when}" for kind, (when, _) in _ENTRY.items())
    timed = " ".join(f"WHEN '{kind}' THEN {when}" for kind, (_, when) in _ENTRY.items())
    return f"""WITH {_kind_lines()}, {_SCORES},
  a AS (SELECT k.*, format, kind = 'mixed' AND event_type = 'signup' AS blank,
    kind = 'mixed' AND format = 'nginx' AND hit <> 'nginx' AS foreign_line FROM k JOIN f USING (log_id)),
  b AS (SELECT *, NOT blank AND NOT foreign_line AS entry,
    CASE kind {error} ELSE event_type = 'error' END AS error,
    CASE kind {timed} ELSE CASE WHEN format = 'nginx' THEN hit = 'nginx' ELSE event_type = 'error' END END AS timed FROM a)
  SELECT log_id, count(*) FILTER (entry) AS parsed_lines, count(*) FILTER (foreign_line AND NOT blank) AS skipped_lines,
    count(*) FILTER (entry AND error) AS errors, count(*) FILTER (entry AND timed) AS timed FROM b GROUP BY 1"""


DETECTION["detected_counts"] = _detected_counts()

# --- ingest --------------------------------------------------------------------------------------------------------

_LINES = r"""d AS (SELECT 'doc-' || doc_id AS log_id, text,
    string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents),
  l AS (SELECT log_id, text, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM d)"""

# a text file ends its only row with a newline
_WRITTEN = _LINES.replace("FROM documents", "FROM (SELECT doc_id, text || chr(10) AS text FROM documents)")

INGEST = {
    "text_file_lines_by_size": f"""WITH {_WRITTEN} SELECT log_id, len(parts) AS lines, len(parts) AS last_line,
  CAST(list_sum([length(p) for p in parts]) AS BIGINT) AS characters,
  len([p for p in parts if p = '']) AS empty_lines, size AS whole_file_bytes
  FROM l, (SELECT unnest([1, 67108864]) AS size) WHERE len(parts) > 0""",
    "text_file_lines": f"""WITH {_WRITTEN} SELECT log_id, len(parts) AS lines, len(parts) AS last_line,
  CAST(list_sum([length(p) for p in parts]) AS BIGINT) AS characters,
  len([p for p in parts if p = '']) AS empty_lines FROM l WHERE len(parts) > 0""",
    "document_lines": f"""WITH {_LINES} SELECT log_id, len(parts) AS lines, len(parts) AS last_line,
  CAST(list_sum([length(p) for p in parts]) AS BIGINT) AS characters,
  len([p for p in parts if p = '']) AS empty_lines FROM l WHERE len(parts) > 0""",
    "text_file_guards": """SELECT 'doc-' || doc_id AS log_id, CASE WHEN strlen(text) > 11999 THEN 'file_too_large'
  WHEN length(text) - length(replace(text, chr(10), '')) > 39 THEN 'too_many_lines' ELSE 'accepted' END AS reason
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "quarantine": """SELECT 'doc-' || doc_id AS log_id, CASE WHEN strlen(text) > 12000 THEN 'file_too_large'
  ELSE 'too_many_lines' END AS reason FROM documents
  WHERE strlen(text) > 12000 OR length(text) - length(replace(text, chr(10), '')) > 40""",
    "accepted_logs": f"""WITH {_LINES} SELECT log_id, len(parts) AS lines FROM l WHERE len(parts) > 0
  AND strlen(text) <= 12000 AND length(text) - length(replace(text, chr(10), '')) <= 40""",
}

# --- templates and clusters ----------------------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"


def _template(text: str) -> str:
    rules = [
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<ID>"),
        (rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "<IP>"),
        (r"(?:/[A-Za-z0-9_.\-~]+)+|(?:[a-z]:\\(?:[^\\\s]+\\)*[^\\\s]+)", "<PATH>"),
        (r"\b[0-9a-f]{32,64}\b", "<ID>"),
        (r"\d+", "<NUM>"),
        (r"\s+", " "),
    ]
    out = f"lower({text})"
    for rule, mark in rules:
        out = f"regexp_replace({out}, '{rule}', '{mark}', 'gi')"
    return f"trim({out})"


_KEYED = f"k AS (SELECT *, {_template('message')} AS template FROM e WHERE is_error = 1)"
_DEDUP = """t AS (SELECT log_id, template, min(line_number) AS first_line, min_by(message, line_number) AS message,
    count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(level = 'CRITICAL') AS critical,
    row_number() OVER (PARTITION BY log_id ORDER BY min(line_number)) - 1 AS ordinal FROM k GROUP BY 1, 2)"""
_TIER = """CASE WHEN regexp_matches(message, 'error|critical|crit\\]|\\[crit', 'i') THEN 0
    WHEN regexp_matches(message, 'exception|traceback|failed|refused|timeout|killed|crash|fatal|panic|segfault|oom|memory|disk|permission', 'i')
    THEN 1 ELSE 2 END"""


def _kept(cap: int) -> str:
    return f"""p AS (SELECT *, {_TIER} AS tier,
    row_number() OVER (PARTITION BY log_id ORDER BY {_TIER}, count DESC, ordinal) <= {cap} AS kept FROM t)"""


_FAMILY = """CASE WHEN template LIKE 'connection refused%' THEN 0 WHEN template LIKE 'worker%' THEN 1
    WHEN template LIKE 'job%' THEN 2 WHEN template LIKE 'container%' THEN 3 WHEN template LIKE 'get%' THEN 4 ELSE 5 END"""


def _clustered(cap: int, top: int, least: int) -> str:
    """Families as clusters: two or more kept templates of one family join, all others stand alone."""
    return f"""{_kept(cap)},
  n AS (SELECT log_id, count(*) AS errors FROM k GROUP BY 1),
  pk AS (SELECT p.*, {_FAMILY} AS family, row_number() OVER (PARTITION BY log_id ORDER BY ordinal) - 1 AS row
    FROM p JOIN n USING (log_id) WHERE kept AND errors >= {least}),
  pf AS (SELECT *, count(*) OVER (PARTITION BY log_id, family) AS members, count(*) OVER (PARTITION BY log_id) AS rows,
    min(row) OVER (PARTITION BY log_id, family) AS family_row FROM pk),
  pl AS (SELECT *, CASE WHEN rows = 1 THEN 0 WHEN members >= {least} THEN
      dense_rank() OVER (PARTITION BY log_id, members >= {least} ORDER BY family_row) - 1 ELSE -1 END AS label FROM pf),
  pc AS (SELECT log_id, template, ordinal, message, count, first_seen, last_seen, critical,
      CASE WHEN label = -1 THEN -1000 - row ELSE label END AS cluster_id, 1 AS stage,
      min(row) OVER (PARTITION BY log_id, label) AS emitted, CASE WHEN label = -1 THEN row ELSE 0 END AS emitted_row FROM pl
    UNION ALL SELECT log_id, template, ordinal, message, count, first_seen, last_seen, critical, -3000 - ordinal, 0, ordinal, 0
    FROM p JOIN n USING (log_id) WHERE NOT kept AND errors >= {least}),
  cl AS (SELECT log_id, cluster_id, min_by(message, ordinal) AS representative_message, CAST(sum(count) AS BIGINT) AS count,
      min(first_seen) AS first_seen, max(last_seen) AS last_seen,
      CASE WHEN bool_or(critical) THEN 'critical' ELSE 'high' END AS severity,
      row_number() OVER (PARTITION BY log_id ORDER BY sum(count) DESC, min(stage), min(emitted), min(emitted_row)) AS pos
    FROM pc GROUP BY 1, 2 QUALIFY pos <= {top}),
  m AS (SELECT pc.log_id, pc.cluster_id, list(k.message ORDER BY k.line_number)[1:3] AS samples,
      list_sort(list_distinct(list(k.service)))[1:10] AS services
    FROM pc JOIN k ON k.log_id = pc.log_id AND k.template = pc.template GROUP BY 1, 2),
  c AS (SELECT cl.*, samples, services FROM cl JOIN m USING (log_id, cluster_id)
    UNION ALL SELECT log_id, -rn, message, 1, ts, ts, CASE WHEN level = 'CRITICAL' THEN 'high' ELSE 'medium' END, rn,
      [message], [service] FROM (SELECT k.*, row_number() OVER (PARTITION BY k.log_id ORDER BY line_number) AS rn
        FROM k JOIN n USING (log_id) WHERE errors < {least}))"""


_FLAT_CLUSTERS = f"""SELECT log_id, pos, cluster_id, representative_message, count, {_stamp('first_seen')}, {_stamp('last_seen')},
  severity, array_to_string(samples, '|') AS sample_messages, array_to_string(services, ',') AS affected_services FROM c"""

_BY_USER = _entries(100_000)
_BY_USER_AND_LINE = _entries(log_id="'log-' || user_id || '/' || ((event_id + 1) % 8)")

_VECTORS = "v AS (SELECT 'log-' || (vec_id // 200) AS log_id, vec_id AS ordinal, embedding::DOUBLE[] AS x, label AS kind FROM embeddings)"
_PAIRS = """e AS (SELECT a.log_id, a.ordinal AS a, b.ordinal AS b, list_cosine_distance(a.x, b.x) AS distance
    FROM v a JOIN v b ON a.log_id = b.log_id AND a.ordinal < b.ordinal WHERE list_cosine_distance(a.x, b.x) <= 0.7)"""

CLUSTERS = {
    "message_templates": f"""WITH {_entries()}, {_KEYED}, {_DEDUP} SELECT log_id, template, ordinal, message, count,
  {_stamp('first_seen')}, {_stamp('last_seen')}, critical FROM t""",
    "document_templates": f"SELECT {_template('text')} AS template, count(*) AS count FROM documents GROUP BY 1",
    "template_priority": f"""WITH {_BY_USER}, {_KEYED}, {_DEDUP}, {_kept(3)}
  SELECT log_id, template, ordinal, count, CAST(tier AS BIGINT) AS tier FROM p WHERE kept""",
    "left_out_templates": f"""WITH {_BY_USER}, {_KEYED}, {_DEDUP}, {_kept(3)}
  SELECT log_id, template, ordinal, count FROM p WHERE NOT kept""",
    "cosine_edges": f"WITH {_VECTORS}, {_PAIRS} SELECT log_id, a, b, round(distance, 4) AS distance FROM e",
    "dbscan_components": f"""WITH RECURSIVE {_VECTORS}, {_PAIRS},
  s AS (SELECT log_id, a, b FROM e UNION ALL SELECT log_id, b, a FROM e),
  reach AS (SELECT log_id, ordinal AS a, ordinal AS b FROM v UNION
    SELECT r.log_id, r.a, s.b FROM reach r JOIN s ON s.log_id = r.log_id AND s.a = r.b),
  root AS (SELECT log_id, a AS ordinal, min(b) AS root, count(*) AS size FROM reach GROUP BY 1, 2)
  SELECT log_id, ordinal, row_number() OVER (PARTITION BY log_id ORDER BY ordinal) - 1 AS row,
    CASE WHEN size = 1 THEN -1 ELSE dense_rank() OVER (PARTITION BY log_id, size > 1 ORDER BY root) - 1 END AS label FROM root""",
    "cluster_representative": f"""WITH {_VECTORS},
  u AS (SELECT log_id, kind, ordinal, unnest(x) AS xi, generate_subscripts(x, 1) AS i FROM v),
  m AS (SELECT log_id, kind, i, avg(xi) AS mi FROM u GROUP BY 1, 2, 3),
  nn AS (SELECT log_id, kind, sqrt(sum(mi * mi)) AS length FROM m GROUP BY 1, 2),
  d AS (SELECT u.log_id, u.kind, ordinal, sum(xi * mi) / any_value(length) AS centrality
    FROM u JOIN m USING (log_id, kind, i) JOIN nn USING (log_id, kind) GROUP BY 1, 2, 3)
  SELECT log_id || '/' || kind AS log_id, arg_max(ordinal, centrality) AS ordinal, round(max(centrality), 4) AS centrality
  FROM d GROUP BY log_id, kind""",
    "error_clusters": f"WITH {_entries()}, {_KEYED}, {_DEDUP}, {_clustered(200, 8, 2)} {_FLAT_CLUSTERS}",
    "error_clusters_capped": f"WITH {_BY_USER}, {_KEYED}, {_DEDUP}, {_clustered(3, 5, 2)} {_FLAT_CLUSTERS}",
    "singleton_clusters": f"""WITH {_BY_USER_AND_LINE}, {_KEYED}, {_DEDUP}, {_clustered(200, 8, 3)}
  {_FLAT_CLUSTERS} WHERE cluster_id < 0""",
    "cluster_search": f"""WITH {_entries()}, {_KEYED}, {_DEDUP}, {_clustered(200, 8, 2)}
  SELECT log_id, pos, CASE severity WHEN 'critical' THEN 'P1' ELSE 'P2' END AS p_level FROM c
  WHERE severity IN ('critical', 'high') AND (array_to_string(samples, '|') || array_to_string(services, '|')
    || representative_message) ILIKE '%svc-3%'""",
    "cluster_export": f"""WITH {_entries()}, {_KEYED}, {_DEDUP}, {_clustered(200, 8, 2)}
  SELECT log_id, cluster_id, severity, count, representative_message AS message,
    strftime(first_seen, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(first_seen, '%f') = '000000' THEN '' ELSE strftime(first_seen, '.%f') END AS first_seen,
    strftime(last_seen, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(last_seen, '%f') = '000000' THEN '' ELSE strftime(last_seen, '.%f') END AS last_seen,
    array_to_string(services, '; ') AS services FROM c""",
}

_CORPUS = """v AS (SELECT 'corpus' AS log_id, vec_id AS ordinal, embedding::DOUBLE[] AS x FROM embeddings),
  e AS (SELECT a.log_id, a.ordinal AS a, b.ordinal AS b, list_cosine_distance(a.x, b.x) AS distance
    FROM v a JOIN v b ON a.ordinal < b.ordinal WHERE list_cosine_distance(a.x, b.x) <= 0.65)"""

CLUSTERS["cosine_edges_corpus"] = f"WITH {_CORPUS} SELECT log_id, a, b, round(distance, 4) AS distance FROM e"
CLUSTERS["cosine_edges_hyperplanes"] = f"WITH {_CORPUS} SELECT log_id, count(*) AS pairs, TRUE AS enough FROM e GROUP BY log_id"
CLUSTERS["dbscan_corpus"] = f"""WITH RECURSIVE {_CORPUS},
  s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  m AS (SELECT unnest([2, 4]) AS least),
  core AS (SELECT least, ordinal FROM m, (SELECT ordinal, (SELECT count(*) FROM s WHERE s.a = v.ordinal) + 1 AS near FROM v) WHERE near >= least),
  reach AS (SELECT least, ordinal AS a, ordinal AS b FROM core UNION
    SELECT r.least, r.a, s.b FROM reach r JOIN s ON s.a = r.b JOIN core c ON c.least = r.least AND c.ordinal = s.b),
  roots AS (SELECT least, a AS ordinal, min(b) AS root FROM reach GROUP BY 1, 2),
  numbered AS (SELECT least, ordinal, dense_rank() OVER (PARTITION BY least ORDER BY root) - 1 AS label FROM roots),
  border AS (SELECT n.least, s.b AS ordinal, min(n.label) AS label FROM numbered n JOIN s ON s.a = n.ordinal
    WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.least = n.least AND c.ordinal = s.b) GROUP BY 1, 2),
  l AS (SELECT * FROM numbered UNION ALL SELECT * FROM border)
  SELECT m.least AS min_samples, v.log_id, v.ordinal, row_number() OVER (PARTITION BY m.least ORDER BY v.ordinal) - 1 AS row,
    coalesce(l.label, -1) AS label FROM v CROSS JOIN m LEFT JOIN l ON l.least = m.least AND l.ordinal = v.ordinal"""

CLUSTERS["template_embeddings"] = f"""WITH {_BY_USER}, {_KEYED}, {_DEDUP},
  w AS (SELECT log_id, ordinal, unnest(regexp_split_to_array(lower(template), '<[a-z]+>|[^\\p{{L}}\\p{{N}}]+')) AS word FROM t),
  s AS (SELECT log_id, ordinal, ('0x' || md5(word)[:8])::BIGINT % 64 AS slot, sqrt(count(*)) AS tf FROM w WHERE word <> '' GROUP BY 1, 2, 3),
  d AS (SELECT log_id, slot, count(*) AS d FROM s GROUP BY 1, 2), n AS (SELECT log_id, count(*) AS n FROM t GROUP BY 1),
  x AS (SELECT s.log_id, ordinal, s.slot, tf * (ln((1 + n) / (1 + d)::DOUBLE) + 1) AS x FROM s JOIN d ON d.log_id = s.log_id AND d.slot = s.slot
    JOIN n ON n.log_id = s.log_id)
  SELECT log_id, ordinal, slot, round((x / sqrt(sum(x * x) OVER (PARTITION BY log_id, ordinal)))::FLOAT::DOUBLE, 4) AS weight FROM x"""
CLUSTERS["cluster_csv"] = CLUSTERS["cluster_export"]

# --- timeline ------------------------------------------------------------------------------------------------------

_FIRST = """fe AS (SELECT log_id, min(line_number) AS line_number, min_by(ts, line_number) AS ts, 'first_error' AS event_type,
    min_by(message, line_number) AS description,
    CASE WHEN min_by(level, line_number) = 'CRITICAL' THEN 'high' ELSE 'medium' END AS severity, 0 AS sub
    FROM e WHERE is_error = 1 GROUP BY log_id, message[:120])"""
_OWN = """oe AS (SELECT log_id, line_number, ts, 'critical' AS event_type, message AS description, 'critical' AS severity, 1 AS sub
    FROM e WHERE level = 'CRITICAL'
    UNION ALL SELECT log_id, line_number, ts, 'service_restart', message, 'low', 2 FROM e
      WHERE message ILIKE '%started%' OR message ILIKE '%starting%' OR message ILIKE '%listening%'
    UNION ALL SELECT log_id, line_number, ts, 'resource', message, 'critical', 3 FROM e
      WHERE message ILIKE '%oomkilled%' OR message ILIKE '%out of memory%')"""
_RECOVERY = """rc AS (SELECT log_id, ts, line_number, message FROM (SELECT *, max(is_error) OVER (PARTITION BY log_id
      ORDER BY ts, line_number ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS near FROM e)
    WHERE level = 'INFO' AND near = 1 QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY ts, line_number) = 1)"""
_FLAT_EVENTS = f"""SELECT log_id, {_stamp('ts')}, event_type, description, severity, line_number::VARCHAR AS related_entries FROM"""

TIMELINE = {
    "first_errors": f"WITH {_entries()}, {_FIRST} {_FLAT_EVENTS} fe",
    "entry_events": f"WITH {_entries()}, {_OWN} {_FLAT_EVENTS} oe",
    "recovery_points": f"WITH {_BY_USER}, {_RECOVERY} SELECT log_id, {_stamp('ts')}, line_number FROM rc",
    "timeline_build": f"""WITH {_entries()}, {_FIRST}, {_OWN}, {_RECOVERY}, {_latency(2.5)},
  ev AS (SELECT log_id, ts, event_type, description, severity, line_number, 0 AS stage, line_number AS t1, sub AS t2 FROM fe
    UNION ALL SELECT log_id, ts, event_type, description, severity, line_number, 0, line_number, sub FROM oe
    UNION ALL SELECT log_id, ts, 'anomaly', NULL, severity, lines[1], 1, 0, lines[1] FROM la
    UNION ALL SELECT log_id, ts, 'recovery', 'Possible recovery: ' || message, 'low', line_number, 2, 0, 0 FROM rc),
  o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ts, stage, t1, t2) AS nth, count(*) OVER (PARTITION BY log_id) AS n FROM ev)
  SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY nth) AS pos, {_stamp('ts')}, event_type, description, severity,
    line_number::VARCHAR AS related_entries FROM o WHERE n <= 100 OR nth <= 50 OR nth > n - 50""",
    "timeline_volume": f"""WITH {_entries()}, {_FIRST}, {_OWN},
  ev AS (SELECT log_id, ts, severity FROM fe UNION ALL SELECT log_id, ts, severity FROM oe)
  SELECT log_id, {_stamp("date_trunc('minute', ts)", 'minute')}, count(*) FILTER (severity = 'low') AS info,
    count(*) FILTER (severity = 'medium') AS warning, count(*) FILTER (severity IN ('critical', 'high')) AS error,
    count(*) AS total FROM ev GROUP BY log_id, date_trunc('minute', ts)""",
}

# --- root causes ---------------------------------------------------------------------------------------------------

# lane A has two database signals, memory, upstream, code and network signals, each tied to one message family
_CAUSES = """f AS (SELECT log_id, bool_or(is_error = 1 AND event_id % 6 = 0) AS refused, bool_or(is_error = 1 AND event_id % 6 = 3) AS oom,
    bool_or(is_error = 1 AND event_id % 6 = 4) AS upstream, bool_or(stack_trace IS NOT NULL) AS traced,
    bool_or(is_error = 1 AND event_id % 6 = 5) AS ssl,
    bool_or(regexp_matches(message, '\\b50[234]\\b')) AS gateway,
    min(ts) FILTER (is_error = 1 AND event_id % 6 = 0) AS t_refused, min(ts) FILTER (is_error = 1 AND event_id % 6 = 3) AS t_oom,
    min(ts) FILTER (regexp_matches(message, '50[234]')) AS t_gateway, min(ts) FILTER (stack_trace IS NOT NULL) AS t_traced,
    min(ts) FILTER (is_error = 1 AND event_id % 6 = 5) AS t_ssl FROM e GROUP BY 1),
  q AS (SELECT log_id, least(3, count(*) FILTER (is_error = 1 AND event_id % 6 = 3)) AS n_oom,
    least(3, count(*) FILTER (is_error = 1 AND event_id % 6 = 5)) AS n_ssl FROM e GROUP BY 1)"""

_RULE_ROWS = """r AS (
  SELECT log_id, 1 AS rule, 'Database connectivity or authentication failure likely caused the outage.' AS hypothesis,
    'medium' AS confidence, 'connection refused to DB port' AS evidence, 'database' AS category, t_refused AS first,
    'Verify database availability and credentials.|Check connection pool sizing and idle timeouts.|Review DB logs for refused connections or auth errors.' AS actions
    FROM f WHERE refused
  UNION ALL SELECT log_id, 2, 'Memory exhaustion or OOM kill likely involved.', 'high',
    array_to_string(['oomkilled', 'oomkilled', 'oomkilled'][1:n_oom], '|'), 'memory', t_oom,
    'Inspect container/pod memory limits and host memory pressure.|Profile application memory usage and leaks.|Scale or increase memory limits if legitimate growth.'
    FROM f JOIN q USING (log_id) WHERE oom
  UNION ALL SELECT log_id, 3, 'Downstream or upstream dependency failure caused user-facing errors.',
    CASE WHEN gateway AND upstream THEN 'high' ELSE 'medium' END,
    concat_ws('|', CASE WHEN gateway THEN 'Multiple 502/503/504 responses observed' END,
      CASE WHEN upstream THEN 'Upstream timeout / bad gateway messages' END), 'dependency', t_gateway,
    'Check upstream services and load balancer configuration.|Validate network paths between tiers.|Review retry and timeout settings.'
    FROM f WHERE gateway OR upstream
  UNION ALL SELECT log_id, 6, 'Unhandled application exception indicates a code defect or unexpected input.', 'high',
    'Python tracebacks or exception strings present', 'code_error', t_traced,
    'Triage stack trace to failing module.|Add guards and tests around failing path.|Deploy hotfix after root fix is verified.'
    FROM f WHERE traced
  UNION ALL SELECT log_id, 7, 'Network, DNS, or TLS issues detected.', 'medium',
    array_to_string(['ssl certificate', 'ssl certificate', 'ssl certificate'][1:n_ssl], '|'), 'network', t_ssl,
    'Verify DNS records and resolver health.|Check TLS certificate validity and chain.|Inspect firewall and security group rules.'
    FROM f JOIN q USING (log_id) WHERE ssl
  UNION ALL SELECT log_id, 8, 'No strong automated rule matched; manual investigation required.', 'low',
    'Insufficient distinctive signals in parsed logs', 'dependency', NULL,
    'Correlate with deployments and infra changes.|Narrow time window around first customer impact.|Collect metrics alongside logs for context.'
    FROM f WHERE NOT (refused OR oom OR gateway OR upstream OR traced OR ssl))"""

_RULE_ORDER = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, first NULLS LAST, rule"


def _rule_text(name: str) -> str:
    category, text, actions = fixed.RULES[name]
    return f"'{text}' AS hypothesis, '{category}' AS category, '{'|'.join(actions)}' AS recommended_actions"


_QUIET = f"""WITH w AS (SELECT user_id, user_id % 3 AS third, count(*) FILTER (event_type = 'error') AS errors,
    min(ts) FILTER (event_type = 'error') AS first, array_to_string(list(CASE WHEN event_id % 2 = 0 THEN 'no space left on device'
      ELSE 'too many open files' END ORDER BY event_id) FILTER (event_type = 'error')[1:3], '|') AS quoted FROM events GROUP BY 1),
  r AS (SELECT user_id, 'high' AS confidence, quoted AS evidence, first, {_rule_text('resource_exhaustion')}
      FROM w WHERE third = 0 AND errors > 0
    UNION ALL SELECT user_id, 'medium', '{fixed.CONFIGURATION_EVIDENCE}', first, {_rule_text('configuration')}
      FROM w WHERE third = 1 AND errors > 0
    UNION ALL SELECT user_id, 'low', '{fixed.NO_RULE_EVIDENCE}', NULL, {_rule_text('none')} FROM w WHERE third = 2 OR errors = 0)
  SELECT 'log-' || user_id AS log_id, 1::BIGINT AS pos, confidence, evidence, hypothesis, category, recommended_actions,
    {_stamp('first', 'first_signal_at')} FROM r"""

ROOT_CAUSES = {
    "root_cause_rules": _QUIET,
    "root_cause_ranking": f"""WITH {_BY_USER}, {_CAUSES}, {_RULE_ROWS}
  SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
    first NULLS LAST, rule) AS pos, hypothesis, confidence, evidence, category, {_stamp('first', 'first_signal_at')},
    actions AS recommended_actions FROM r""",
    "root_cause_evidence": f"""WITH {_BY_USER}, {_CAUSES}
  SELECT log_id, 'memory' AS rule, array_to_string(['oomkilled', 'oomkilled', 'oomkilled'][1:n_oom], '|') AS evidence FROM q WHERE n_oom > 0
  UNION ALL SELECT log_id, 'network', array_to_string(['ssl certificate', 'ssl certificate', 'ssl certificate'][1:n_ssl], '|') FROM q WHERE n_ssl > 0""",
    "severity": f"""WITH {_BY_USER}, {_STATS}, {_CAUSES}, {_rates('1 hour')}, {_spikes('1 hour', 2.5)}, {_latency(2.5)}, {_SILENCE},
    {_cascades('1 hour', 2.5)}, {_UNION},
  a AS (SELECT log_id, bool_or(anomaly_type = 'cascade_failure') AS cascade FROM u GROUP BY 1)
  SELECT s.log_id, CASE WHEN critical_count > 0 AND (oom OR traced OR (gateway AND upstream)) THEN 'P1'
    WHEN error_rate > 0.1 OR coalesce(cascade, FALSE) THEN 'P2'
    WHEN error_rate > 0.02 OR a.log_id IS NOT NULL THEN 'P3' ELSE 'P4' END AS severity
  FROM s JOIN f USING (log_id) LEFT JOIN a USING (log_id)""",
}

_ISO_FIRST = """strftime(first_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(first_ts, '%f') = '000000' THEN ''
    ELSE strftime(first_ts, '.%f') END"""

REPORTS = {
    "report_shape": f"""WITH {_all('1 hour', 2.5)}, {_STATS}, {_CAUSES}, {_FIRST}, {_OWN}, {_RECOVERY}, {_KEYED}, {_DEDUP},
    {_clustered(200, 8, 2)},
  ev AS (SELECT log_id FROM fe UNION ALL SELECT log_id FROM oe UNION ALL SELECT log_id FROM u UNION ALL SELECT log_id FROM rc),
  x AS (SELECT log_id, least(100, count(*)) AS events FROM ev GROUP BY 1),
  y AS (SELECT log_id, count(*) AS clusters FROM c GROUP BY 1),
  a AS (SELECT log_id, count(*) AS anomalies, bool_or(anomaly_type = 'cascade_failure') AS cascade FROM u GROUP BY 1)
  SELECT s.log_id, CASE WHEN critical_count > 0 AND (oom OR traced OR (gateway AND upstream)) THEN 'P1'
      WHEN error_rate > 0.1 OR cascade THEN 'P2' ELSE 'P3' END AS severity, n AS total_lines,
    round(error_rate, 6) AS error_rate, {_ISO_FIRST} AS first_ts, clusters, events,
    CAST(refused::INT + oom::INT + (gateway OR upstream)::INT + traced::INT + ssl::INT AS BIGINT) AS causes, anomalies
  FROM s JOIN f USING (log_id) JOIN x USING (log_id) JOIN y USING (log_id) JOIN a USING (log_id)""",
    "report_continuations": f"""WITH {_entries()}, {_latency(2.5)},
  o AS (SELECT log_id, lines[1] AS line, row_number() OVER (PARTITION BY log_id ORDER BY ts, lines[1]) AS pos FROM la)
  SELECT log_id, (pos - 1) // 25 AS part, count(*) AS rows, string_agg(line::VARCHAR, ',' ORDER BY pos) AS lines
  FROM o WHERE pos > 25 GROUP BY 1, 2""",
    "prompt_continuations": f"""WITH {_entries()}, {_latency(2.5)},
  o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ts, lines[1]) AS pos FROM la)
  SELECT log_id, (pos - 1) // 25 AS part, printf('KEY ANOMALIES DETECTED (continued, part %d):', (pos - 1) // 25) || chr(10) ||
    string_agg('latency_spike (medium) z=#: High response time #ms (z=# vs baseline #ms)', chr(10) ORDER BY pos) AS prompt FROM o WHERE pos > 25 GROUP BY 1, 2""",
    "analyse_access_logs": f"""SELECT 'nginx_access-' || (event_id % 3) AS log_id, 'nginx' AS log_source, count(*) AS total_lines,
    count(*) AS parsed_lines, 0::BIGINT AS skipped_lines, {_stamp(f'min({_SECOND}) - INTERVAL 2 HOUR', 'first_ts')},
    round(avg((event_type = 'error')::INT), 6) AS error_rate, round(avg((event_type = 'signup')::INT), 6) AS warning_rate,
    CASE WHEN avg((event_type = 'error')::INT) > 0.1 THEN 'P2' ELSE 'P3' END AS severity FROM events GROUP BY 1""",
}



def _spaced(column: str) -> str:
    whole = f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return f"{whole} || CASE WHEN strftime({column}, '%f') = '000000' THEN '' ELSE strftime({column}, '.%f') END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NL = "chr(10)"
_RANGE = f"{_spaced('first_ts')} || ' → ' || {_spaced('last_ts')}"
_AT = "2024-02-01T00:00:00.000000Z"
_REQUEST = " with these sections:\n" + "\n".join(f"## {title}" for title in fixed.SECTIONS)
_TWO_ACTIONS = "unnest(string_split(actions, '|')[1:2]) AS action, generate_subscripts(string_split(actions, '|')[1:2], 1) AS i"

REPORTS |= {
    "report_sections": f"""WITH {_entries()}, {_TOP}, {_STATS}, {_CAUSES}, {_RULE_ROWS},
  o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY {_RULE_ORDER}) AS pos FROM r),
  rt AS (SELECT log_id, string_agg('- **' || category || '** (' || confidence || '): ' || hypothesis || {_NL} || '  - Evidence: '
    || replace(evidence, '|', ', '), {_NL} ORDER BY pos) AS root FROM o GROUP BY 1),
  ac AS (SELECT log_id, pos, {_TWO_ACTIONS} FROM o),
  re AS (SELECT log_id, string_agg('- ' || action, {_NL} ORDER BY pos, i) AS recommended FROM
    (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY pos, i) AS n FROM ac) WHERE n <= 6 GROUP BY 1),
  tm AS (SELECT log_id, string_agg(message[:80], ', ' ORDER BY count DESC, first_line) AS top FROM t GROUP BY 1)
  SELECT s.log_id, '# Incident Report' || {_NL} || {_NL} || '- **generated_at:** {_AT}' || {_NL} || '- **log_source:** unknown' || {_NL}
      || '- **lines_analysed:** ' || n || {_NL} || '- **prompt_version:** v1.0' AS header,
    'Automated analysis of **' || n || '** log lines (unknown), **' || n || '** structured entries. Error rate **'
      || printf('%.1f%%', error_rate * 100) || '**, warnings **' || printf('%.1f%%', warning_rate * 100) || '**, critical events **'
      || critical_count || '**. Time range: **' || {_RANGE} || '**.' AS incident,
    root, 'Top error signatures: ' || coalesce(top, 'none') || '.' || {_NL}
      || 'Pipeline processing took **0 ms** (parser version v1.0).' AS impact, recommended,
    {_quoted(fixed.PREVENTION)} AS prevention, 'Incident Report v1.0' AS footer
  FROM s JOIN rt USING (log_id) JOIN re USING (log_id) LEFT JOIN tm USING (log_id)""",
    "report_fields": f"""SELECT q.log_id, TRUE AS ok, '{_AT}' AS generated_at, 'unknown' AS log_source, q.total_lines,
    'v1.0' AS prompt_version, severity, critical_count, q.error_rate, q.first_ts, hypothesis, string_split(actions, '|')[2] AS second_action
  FROM ({REPORTS['report_shape']}) q JOIN ({SUMMARY['log_summary']}) l USING (log_id)
  JOIN (WITH {_entries()}, {_CAUSES}, {_RULE_ROWS} SELECT * FROM r
    QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY {_RULE_ORDER}) = 1) c USING (log_id)""",
    "prompt_anomalies": f"""SELECT log_id, CASE WHEN anomalies > 10 THEN 11 ELSE greatest(anomalies, 1) END AS lines,
    greatest(anomalies - 10, 0) AS more FROM ({REPORTS['report_shape']})""",
    "report_store": f"""SELECT 12::BIGINT AS id_length, severity, 'unknown' AS log_source, total_lines, '{_AT}' AS generated_at
  FROM ({REPORTS['report_shape']})""",
    "prompt_sections": f"""WITH {_entries()}, {_STATS}, {_CAUSES}, {_RULE_ROWS}, {_KEYED}, {_DEDUP}, {_clustered(200, 8, 2)},
  h AS (SELECT log_id, string_agg('[' || category || '|' || confidence || '] ' || hypothesis || ' (evidence: '
    || replace(evidence, '|', '; ') || ')', {_NL} ORDER BY {_RULE_ORDER}) AS causes FROM r GROUP BY 1),
  j AS (SELECT log_id, string_agg(count || 'x ' || representative_message[:300] || ' services=['
    || array_to_string([chr(39) || x || chr(39) for x in services], ', ') || ']', {_NL} ORDER BY pos) AS clusters FROM c GROUP BY 1)
  SELECT s.log_id, 'Write an incident report based on this analysis:' || {_NL} || {_NL} || 'LOG SOURCE: unknown' || {_NL} || 'TIME RANGE: '
      || {_RANGE} || {_NL} || 'TOTAL LINES ANALYSED: ' || n || {_NL} || 'ERROR RATE: ' || printf('%.1f%%', error_rate * 100)
      || {_NL} || {_NL} || 'ROOT CAUSE HYPOTHESES:' || {_NL} || causes AS opening,
    clusters, {_quoted(_REQUEST)} AS request, md5({_quoted(fixed.SYSTEM_PROMPT)}) AS system_md5
  FROM s JOIN h USING (log_id) LEFT JOIN j USING (log_id)""",
}

# --- history and evaluation ----------------------------------------------------------------------------------------

_ACCESS = f"""e AS (SELECT 'nginx_access-' || (event_id % 3) AS log_id, event_id // 3 + 1 AS line_number,
    {_SECOND} - INTERVAL 2 HOUR AS ts, value * 1000 AS response_time_ms, (event_type = 'error')::INT AS is_error FROM events)"""

_HISTORY = """h AS (SELECT o_orderkey::VARCHAR AS id, o_orderdate AS ts, CASE o_orderpriority[1] WHEN '1' THEN 'P1' WHEN '2' THEN 'P2'
      WHEN '3' THEN 'P3' ELSE 'P4' END AS severity, CASE o_orderstatus WHEN 'O' THEN 'nginx' WHEN 'F' THEN 'python' ELSE 'docker' END AS log_source,
    CAST(floor(o_totalprice) AS BIGINT) AS total_lines, o_orderkey % 8 AS cluster_count, o_orderkey % 5 AS anomaly_count,
    o_custkey % 10 = 0 AS bookmarked, log_source || ' analysis — ' || severity || ' (' || total_lines || ' lines)' AS title FROM orders)"""

_EVAL = """o AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value > 120)) AS types,
    list_sort(list(DISTINCT event_type) FILTER (value < 3)) AS cats, count(*) FILTER (value > 120) AS n_an,
    count(*) FILTER (value < 3) AS n_cl, round(avg(value), 6) AS ms FROM events GROUP BY 1),
  w AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN ['error', 'click'] ELSE ['view'] END AS want FROM o),
  v AS (SELECT user_id::VARCHAR AS id, ms, (user_id % 2 = 0) = (user_id % 3 = 0) AS source_ok, len(want)::BIGINT AS types_expected,
    len(list_intersect(want, coalesce(types, []::VARCHAR[])))::BIGINT AS types_found,
    list_contains(coalesce(cats, []::VARCHAR[]), CASE WHEN user_id % 2 = 0 THEN 'purchase' ELSE 'signup' END) AS cause_ok,
    user_id % 4 = user_id % 3 AS severity_ok, n_cl >= user_id % 3 AS clusters_ok,
    user_id % 5 = 0 AND n_an > 0 AS false_positive FROM w)"""

HISTORY = {
    "severity_distribution": f"WITH {_HISTORY} SELECT severity, count(*) AS analyses FROM h GROUP BY 1",
    "source_distribution": f"WITH {_HISTORY} SELECT log_source, count(*) AS analyses FROM h GROUP BY 1",
    "history_totals": f"""WITH {_HISTORY} SELECT count(*) AS analyses, CAST(sum(total_lines) AS BIGINT) AS total_lines,
  CAST(sum(cluster_count) AS BIGINT) AS clusters, CAST(sum(anomaly_count) AS BIGINT) AS anomalies,
  strftime(max(ts), '{STAMP}') AS last_analysis FROM h""",
    "daily_trend": f"""WITH {_HISTORY} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS analyses,
  count(*) FILTER (severity IN ('P1', 'P2')) AS serious FROM h GROUP BY 1""",
    "average_severity": f"""WITH {_HISTORY}, a AS (SELECT avg(CASE severity WHEN 'P1' THEN 4 WHEN 'P2' THEN 3 WHEN 'P3' THEN 2 ELSE 1 END) AS x FROM h)
  SELECT round(x, 6) AS average, CASE WHEN x >= 3.5 THEN 'P1' WHEN x >= 2.5 THEN 'P2' WHEN x >= 1.5 THEN 'P3' ELSE 'P4' END AS severity FROM a""",
    "history_latest": f"WITH {_HISTORY} SELECT id, strftime(ts, '{STAMP}') AS ts, title, bookmarked FROM h ORDER BY h.ts DESC, id LIMIT 50",
    "history_search": f"WITH {_HISTORY} SELECT id, title FROM h WHERE bookmarked AND severity = 'P1' AND log_source = 'nginx'",
    "service_metrics": """WITH s AS (SELECT event_type, count(*) AS n, sum(value) AS ms FROM events GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS total_requests, round(sum(ms) / sum(n), 6) AS avg_processing_time_ms,
    string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS format_distribution, 'v1.0' AS prompt_version FROM s""",
    # of the rules only those with the expected category can match access lines
    "eval_from_file": f"""WITH {_ACCESS}, {_rates('1 hour')}, {_spikes('1 hour', 2.5)}, {_latency(2.5)}, {_SILENCE}, {_cascades('1 hour', 2.5)}, {_UNION},
  a AS (SELECT log_id, count(DISTINCT anomaly_type) FILTER (anomaly_type IN ('latency_spike', 'silence')) AS found,
    bool_or(anomaly_type = 'cascade_failure') AS cascade FROM u GROUP BY 1),
  l AS (SELECT log_id, avg(is_error) AS rate, sum(is_error) AS errors FROM e GROUP BY 1),
  v AS (SELECT l.*, coalesce(found, 0) AS found, rate > 0.1 OR coalesce(cascade, FALSE) AS severe,
    log_id = 'nginx_access-0' AND a.log_id IS NOT NULL AS wrong FROM l LEFT JOIN a USING (log_id))
  SELECT '20240201_000000' AS run, count(*) AS cases, TRUE AS measured, 1.0::DOUBLE AS log_source_accuracy,
    round(sum(found) / (2 * count(*))::DOUBLE, 6) AS anomaly_type_recall, 1.0::DOUBLE AS root_cause_category_accuracy,
    round(avg(severe::INT), 6) AS severity_accuracy, round(avg((errors > 0)::INT), 6) AS cluster_detection_rate,
    round(avg(wrong::INT), 6) AS false_positive_rate FROM v""",
    "eval_rows": f"""WITH {_EVAL} SELECT id, source_ok, types_expected, types_found, cause_ok, severity_ok, clusters_ok, false_positive FROM v""",
    "eval_summary": f"""WITH {_EVAL} SELECT count(*) AS cases, round(avg(source_ok::INT), 6) AS log_source_accuracy,
  round(sum(types_found) / sum(types_expected)::DOUBLE, 6) AS anomaly_type_recall, round(avg(cause_ok::INT), 6) AS root_cause_category_accuracy,
  round(avg(severity_ok::INT), 6) AS severity_accuracy, round(avg(clusters_ok::INT), 6) AS cluster_detection_rate,
  round(avg(false_positive::INT), 6) AS false_positive_rate, round(avg(ms), 6) AS avg_processing_time_ms FROM v""",
}

_LAST = "(SELECT max(ts) FROM events)"

STREAMS = {
    "stream_parse": PARSERS["parse_docker_pipe"],
    "stream_error_rates": f"""{DETECTORS['error_rate_by_window']}
  WHERE w + INTERVAL 1 HOUR <= {_LAST} - INTERVAL 2 HOUR""",
    "stream_spike_flags": f"""WITH {_entries()}, {_rates('1 hour')},
  m AS (SELECT date_trunc('day', min(ts) + to_microseconds((epoch_us(max(ts)) - epoch_us(min(ts))) // 2)) AS middle FROM events),
  k AS (SELECT max(ts) FILTER (ts < middle) - INTERVAL 3 HOUR AS closed, max(ts) - INTERVAL 3 HOUR AS ended FROM events, m),
  o AS (SELECT log_id, min(w) AS oldest FROM r, k WHERE w > closed AND w <= ended GROUP BY 1),
  b AS (SELECT log_id, avg(rate) AS mean, stddev_pop(rate) AS spread, count(*) AS windows FROM r JOIN o USING (log_id), k
    WHERE w <= closed AND w >= oldest - INTERVAL 3 DAY GROUP BY 1 HAVING count(*) >= 3)
  SELECT log_id, {_stamp('w', 'window_start')}, round(rate, 6) AS rate, round(mean, 6) AS mean, windows,
    round((rate - mean) / spread, 6) AS z_score FROM r JOIN b USING (log_id), k
  WHERE w > closed AND w <= ended AND spread > 0 AND (rate - mean) / spread > 1.5 AND rate > 0""",
    "stream_silence_alarms": f"""WITH {_entries(100_000)},
  g AS (SELECT log_id, ts, CASE WHEN ts - lag(ts) OVER o >= INTERVAL 6 HOUR OR lag(ts) OVER o IS NULL THEN 1 ELSE 0 END AS fresh
    FROM e WINDOW o AS (PARTITION BY log_id ORDER BY ts)),
  s AS (SELECT log_id, ts, sum(fresh) OVER (PARTITION BY log_id ORDER BY ts) AS burst FROM g),
  b AS (SELECT log_id, min(ts) AS active_from, max(ts) AS silent_since, count(*) AS entries FROM s GROUP BY log_id, burst)
  SELECT log_id, {_stamp('active_from')}, {_stamp('silent_since')}, entries FROM b
  WHERE b.silent_since + INTERVAL 6 HOUR <= {_LAST} - INTERVAL 1 HOUR""",
    "stream_silence_gaps": f"""WITH {_entries(100_000)}, d AS (SELECT DISTINCT log_id, ts FROM e),
  g AS (SELECT log_id, ts, lag(ts) OVER o AS since, (epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 1e6 AS gap FROM d
    WINDOW o AS (PARTITION BY log_id ORDER BY ts)),
  s AS (SELECT *, avg(gap) OVER o AS mean, stddev_pop(gap) OVER o AS spread, count(gap) OVER o AS n FROM g WHERE gap IS NOT NULL
    WINDOW o AS (PARTITION BY log_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT log_id, {_stamp('since', 'silent_since')}, {_stamp('ts', 'until')}, round(gap, 2) AS gap, round(mean, 2) AS mean,
    round(spread, 2) AS spread, 'ended' AS kind FROM s WHERE n >= 3 AND gap > 60 AND gap > mean + 3 * greatest(spread, 1e-6)""",
    "stream_tracebacks": PARSERS["traceback_merge"],
    "stream_first_seen_errors": f"WITH {_entries()}, {_KEYED} SELECT DISTINCT log_id, template FROM k",
}

ORACLES: dict[str, str] = (
    DETECTORS | SUMMARY | PARSERS | DETECTION | INGEST | CLUSTERS | TIMELINE | ROOT_CAUSES | REPORTS | HISTORY | STREAMS
)
