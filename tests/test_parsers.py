import datetime as dt

import pytest
from conftest import by_line

from faultline import Settings
from faultline.operators.parse import custom, dispatch

CFG = Settings(reference_time=dt.datetime(2024, 2, 1), default_year=2024)


def parsed(lines, text, kind, cfg=CFG):
    return by_line(dispatch.entries(dispatch.parse_as(lines(text), kind, cfg)))


def skipped(lines, text, kind):
    rows = dispatch.skipped(dispatch.parse_as(lines(text), kind, CFG)).collect()
    return rows[0].skipped_lines if rows else 0


def test_access_lines(lines):
    text = "\n".join(
        [
            '10.0.0.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 23 "-" "ua"',
            '10.0.0.1 - - [10/Oct/2000:13:55:37 -0700] "POST /x HTTP/1.0" 500 0 "-" "-" rt=0.25',
            '10.0.0.1 - - [10/Oct/2000:13:55:37] "POST /x HTTP/1.0" 404 0 rt=1.2.3',
            '10.0.0.1 - - [31/Feb/2000:13:55:37 +0000] "POST /x HTTP/1.0" 301 0',
        ]
    )
    a, b, c, d = parsed(lines, text, "nginx")
    assert (a.level, a.status_code, a.message, a.metadata) == ("INFO", 200, "GET /a.gif 200", {"path": "/a.gif"})
    assert a.ts == dt.datetime(2000, 10, 10, 20, 55, 36) and a.response_time_ms is None
    assert (b.level, b.response_time_ms, b.source) == ("ERROR", 250.0, "nginx")
    assert (c.level, c.response_time_ms, c.ts) == ("WARNING", None, dt.datetime(2000, 10, 10, 13, 55, 37))
    assert d.ts is None


def test_error_lines_and_skipping(lines):
    text = "\n".join(
        [
            "2024/01/15 12:34:56 [error] 12#12: *1 connect() failed (111: Connection refused)",
            "2024/01/15 12:34:56 [crit] x",
            "2024/01/15 12:34:56 [warn] x",
            "2024/01/15 12:34:56 [emerg] x",
            "nothing known",
            "",
        ]
    )
    rows = parsed(lines, text, "nginx")
    assert [r.level for r in rows] == ["ERROR", "ERROR", "WARNING", "INFO"]
    assert rows[0].message == "12#12: *1 connect() failed (111: Connection refused)"
    assert skipped(lines, text, "nginx") == 1


def test_error_log_zone_option(lines):
    row = parsed(lines, "2024/01/15 12:00:00 [warn] x", "nginx", CFG.but(error_log_tz="Europe/Berlin"))[0]
    assert row.ts == dt.datetime(2024, 1, 15, 11, 0)


def test_python_forms(lines):
    text = "\n".join(
        [
            "2024-01-15 12:00:00,250 ERROR mod:1 something failed",
            "2024-01-15 12:00:00 WARN app.db:88 slow query",
            'INFO:     127.0.0.1:5000 - "GET / HTTP/1.1" 404 Not Found',
            'INFO:     127.0.0.1:5000 - "GET / HTTP/1.1" 500 Oops',
            "ERROR:    worker died",
            "2024-01-15 12:00:00,250 ERROR    a.b: text",
            "2024-01-15 12:00:00,250 ERROR    a.b:k=v text",
            "   trailing   ",
        ]
    )
    rows = parsed(lines, text, "python")
    assert [r.level for r in rows] == ["ERROR", "WARNING", "WARNING", "ERROR", "ERROR", "INFO", "ERROR", "INFO"]
    assert rows[0].message == "something failed" and rows[0].service is None
    assert rows[0].ts == dt.datetime(2024, 1, 15, 12, 0, 0, 250000)
    assert (rows[1].service, rows[1].message) == ("app.db", "slow query")
    assert (rows[2].message, rows[2].status_code, rows[2].ts) == ('"GET / HTTP/1.1" 404', 404, None)
    assert rows[5].ts is None and rows[5].message.startswith("2024-01-15")
    assert rows[7].message == "   trailing"


def test_docker_forms(lines):
    text = "\n".join(
        [
            "2024-01-15T12:34:56.789012345Z stdout F hello",
            "2024-01-15T12:34:56.7Z stderr F ERROR inside",
            "myapp  | 2024-01-15 12:34:56 ERROR boom",
            "myapp  | 2024-01-15 12:34:56 FATAL boom",
            "free text",
        ]
    )
    rows = parsed(lines, text, "docker")
    assert [r.level for r in rows] == ["INFO", "WARNING", "ERROR", "INFO", "INFO"]
    assert rows[0].ts == dt.datetime(2024, 1, 15, 12, 34, 56, 789012) and rows[0].metadata == {"stream": "stdout"}
    assert rows[1].ts == dt.datetime(2024, 1, 15, 12, 34, 56, 700000)
    assert rows[2].service == "myapp" and rows[4].ts is None


def test_cluster_events(lines):
    text = "\n".join(
        [
            "LAST SEEN   TYPE   REASON   OBJECT   MESSAGE",
            "90s   Warning   BackOff   pod/web-1   Back-off restarting",
            "2h   Normal   Pulled   pod/web-1   done",
            "5m30s   Normal   Pulled   pod/web-1   done",
            "web-1 main an Error here",
            "/not a pod row",
            "two tokens",
        ]
    )
    rows = parsed(lines, text, "kubernetes")
    assert [r.level for r in rows] == ["WARNING", "INFO", "INFO", "ERROR"]
    assert rows[0].ts == dt.datetime(2024, 1, 31, 23, 58, 30)
    assert rows[0].message == "BackOff: Back-off restarting" and rows[0].metadata["type"] == "Warning"
    assert rows[1].ts == dt.datetime(2024, 1, 31, 22) and rows[2].ts is None
    assert (rows[3].service, rows[3].message) == ("web-1/main", "an Error here")
    assert skipped(lines, text, "kubernetes") == 2


def test_syslog_and_priority(lines):
    text = "\n".join(
        [
            "Jan  5 12:34:56 host-1 sshd[12]: Failed password",
            "Jan 15 12:34:56 host-1 kernel: Out of memory: kill",
            "<3>mysqld: ready",
            "<7>trace",
            "junk",
        ]
    )
    rows = parsed(lines, text, "systemd")
    assert [r.level for r in rows] == ["ERROR", "CRITICAL", "ERROR", "DEBUG"]
    assert rows[0].ts == dt.datetime(2024, 1, 5, 12, 34, 56)
    assert (rows[0].host, rows[0].service, rows[0].metadata) == ("host-1", "sshd", {"pid": "12"})
    assert rows[1].metadata == {} and rows[2].ts is None
    assert skipped(lines, text, "systemd") == 1


def test_generic_lines(lines):
    text = "\n".join(
        [
            "x 2024-01-15T14:00:00.999 noise",
            "2024/01/15 14:00:15 burst of error words",
            "bad 2024-13-45 00:00:00 then 2024/01/15 14:00:15 warn",
            "errors are not a word match; criticality neither",
            "  ",
        ]
    )
    rows = parsed(lines, text, "generic")
    assert [r.level for r in rows] == ["UNKNOWN", "ERROR", "WARNING", "UNKNOWN"]
    assert rows[0].ts == dt.datetime(2024, 1, 15, 14, 0, 0)
    assert rows[2].ts == dt.datetime(2024, 1, 15, 14, 0, 15)
    assert {r.source for r in rows} == {"unknown"}


def test_custom_pattern(lines):
    known = custom.custom_format("mine", r"\[(?P<level>\w+)\] (?P<timestamp>\S+ \S+) (?P<service>\w*): (?P<message>.+)")
    text = "\n".join(
        ["pre [fatal] 2024-01-15 12:00:00.5 db: down", "[note] never ever x: y", "[warn] 2024/01/15 12:00:00 : z", "no"]
    )
    rows = parsed(lines, text, known)
    assert [r.level for r in rows] == ["CRITICAL", "UNKNOWN", "WARNING", "UNKNOWN"]
    assert rows[0].ts == dt.datetime(2024, 1, 15, 12, 0, 0, 500000)
    assert (rows[0].service, rows[0].message) == ("db", "down")
    assert rows[1].ts is None and rows[2].service is None and rows[3].message == "no"
    assert skipped(lines, text, known) == 1


@pytest.mark.parametrize("bad", ["(", r"(?P<level>\w+)"])
def test_custom_pattern_checks(bad):
    with pytest.raises(ValueError):
        custom.validated("x", bad)


def test_custom_backreference(lines):
    known = custom.custom_format("q", r"^(?P<q>['|])(?P<message>.*)(?P=q)$")
    rows = parsed(lines, "'a'\n|b|\n'c|", known)
    assert [r.message for r in rows] == ["a", "b", "'c|"]


def test_separator_character_in_a_line(lines):
    rows = parsed(lines, "app | 2024-01-15 12:34:56 ERROR a\x01b\x01c", "docker")
    assert (rows[0].message, rows[0].service) == ("a\x01b\x01c", "app")


def test_unicode_spaces(lines):
    row = parsed(lines, "　app | 2024-01-15 12:34:56 ERROR boom ", "docker")[0]
    assert (row.service, row.level, row.message) == ("app", "ERROR", "boom")


def test_a_plan_without_python(lines):
    plan = dispatch.parse(lines("x"), CFG)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_many_patterns_in_one_pass(spark):
    formats = custom.format_table(spark, {"x": r"(?P<level>\w+): (?P<message>.*)", "y": r"^(?P<message>\S+) at (?P<timestamp>\S+ \S+)$"})
    rows = [("a", 1, "err: broken"), ("a", 2, "no match"), ("a", 3, "  "), ("b", 1, "err: broken"), ("b", 2, "up at 2024-01-15 12:00:00"), ("c", 1, "x: y"), ("d", 1, "x: y")]
    lines = spark.createDataFrame(rows, "log_id string, line_number long, raw_line string")
    assigned = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "unknown")], "log_id string, name string")
    many = custom.parse_many(lines, assigned, formats, Settings())
    for log, name in (("a", "x"), ("b", "y")):
        pattern = {"x": r"(?P<level>\w+): (?P<message>.*)", "y": r"^(?P<message>\S+) at (?P<timestamp>\S+ \S+)$"}[name]
        alone = dispatch.parse_as(lines.filter(lines.log_id == log), custom.custom_format(name, pattern), Settings())
        assert many.columns == alone.columns
        assert sorted(map(str, many.filter(many.log_id == log).collect())) == sorted(map(str, alone.collect()))
    assert many.filter("log_id IN ('c', 'd')").count() == 0
    with pytest.raises(ValueError, match="message"):
        custom.format_table(spark, {"z": r"(?P<level>\w+)"})
