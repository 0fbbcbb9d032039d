"""Syslog and priority-prefixed rows."""

from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions import times
from faultline.functions.text import pattern
from faultline.operators.parse.forms import LineForm, LogFormat


def level_from_message(message):
    """The first hit wins."""
    upper = F.upper(message)
    return (
        F.when(upper.contains("OOMKILL") | upper.contains("OUT OF MEMORY"), "CRITICAL")
        .when(upper.contains("ERROR") | upper.contains("FAILED"), "ERROR")
        .when(upper.contains("WARN"), "WARNING")
        .otherwise("INFO")
    )


def _priority(group, text, cfg):
    """P25."""
    number = group(1).try_cast("int")
    level = (
        F.when(number <= 2, "CRITICAL")
        .when(number == 3, "ERROR")
        .when(number == 4, "WARNING")
        .when(number <= 6, "INFO")
        .otherwise("DEBUG")
    )
    return {"level": level, "message": group(2)}


def _syslog(group, text, cfg):
    """P24, P27."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return {
        "ts": times.month_day(group(1), cfg.year()),
        "level": level_from_message(group(5)),
        "host": group(2),
        "service": group(3),
        "message": group(5),
        "metadata": F.when(group(4) != "", F.create_map(F.lit("pid"), group(4))).otherwise(empty),
    }


FORMAT = LogFormat(
    "systemd",
    "systemd",
    (
        LineForm("priority", "systemd", _priority, fixed.PRIORITY, 2),
        LineForm("syslog", "systemd", _syslog, fixed.SYSLOG, 5),
    ),
    hits={
        "systemd": lambda s: s.rlike(pattern(fixed.SYSLOG))
        | (s.rlike(pattern(fixed.PRIORITY)) & (F.length(s) < 200))
    },
    score=lambda hit, n: F.least(F.lit(1.0), hit["systemd"] / n),
)
