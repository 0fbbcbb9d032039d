import pytest

from faultline import Settings
from faultline.operators import detect

ACCESS = '10.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 1 "-" "-"'
APP = "2024-01-15 12:00:00,000 ERROR mod:1 failed"

CASES = {
    "access": (ACCESS, "nginx"),
    "app": (APP, "python"),
    "traceback": ("Traceback (most recent call last):\n  File\nValueError: x\nfree\nfree", "python"),
    "container": ("2024-01-15T12:34:56.7Z stdout F x\nfree text with stderr inside", "docker"),
    "events": ("LAST SEEN  TYPE  REASON  OBJECT\nfree\nfree\nfree", "kubernetes"),
    "syslog": ("Jan  5 12:34:56 h u[1]: x\n<3>y", "systemd"),
    "long_priority": ("<3>" + "y" * 300, "generic"),
    "free": ("2024-01-15 12:00:00 some text", "generic"),
    "two_thirds": (f"{ACCESS}\n{APP}\n{APP}", "python"),
    "blank_heavy_low": ("\n".join([ACCESS] * 5 + [" "] * 15), "generic"),
    "blank_heavy_high": ("\n".join([ACCESS] * 6 + [" "] * 14), "nginx"),
    "late": ("\n".join(["free"] * 20 + [ACCESS] * 50), "generic"),
}


@pytest.fixture(scope="module")
def found(spark, lines):
    frames = [lines(text, name) for name, (text, _) in CASES.items()]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    logs = spark.createDataFrame([(n,) for n in [*CASES, "empty"]], "log_id string")
    return {r.log_id: r for r in detect.formats(every, Settings(), logs).collect()}


@pytest.mark.parametrize("name", CASES)
def test_format(found, name):
    assert found[name].format == CASES[name][1]


def test_lines_are_counted_and_the_sample_may_be_everything(found, spark, lines):
    assert (found["late"].total_lines, found["two_thirds"].total_lines, found["empty"].total_lines) == (70, 3, 0)
    row = detect.formats(lines(CASES["late"][0]), Settings(sample_lines=None)).collect()[0]
    assert row.format == "nginx" and row.score == pytest.approx(50 / 70 * 1.2)


def test_scores(found):
    assert found["two_thirds"].score == pytest.approx(2 / 3 * 1.1)
    assert found["events"].score == pytest.approx(0.5 + 0.25 * 0.5)
    assert found["traceback"].score == pytest.approx(0.66)
    assert (found["free"].log_source, found["empty"].format, found["empty"].log_source) == (
        "unknown",
        "generic",
        "unknown",
    )
