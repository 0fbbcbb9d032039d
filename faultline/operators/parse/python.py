"""Python application logs (D2, P7-P11, P13, P14). Tracebacks are merged beforehand, see ``tracebacks``."""

from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions import times
from faultline.functions.text import pattern, rstrip, strip
from faultline.operators.parse.forms import LineForm, LogFormat, always, level_of, status_level


def _std(group, text, cfg):
    """P7, P13, P14."""
    return {
        "ts": times.naive(F.translate(group(1), ",", ".")),
        "level": level_of(group(2), fixed.PYTHON_LEVELS, "UNKNOWN"),
        "message": group(3),
    }


def _std_line(group, text, cfg):
    """P8."""
    return {
        "ts": times.naive(group(1)),
        "level": level_of(group(2), fixed.PYTHON_LEVELS, "UNKNOWN"),
        "service": group(3),
        "message": group(4),
    }


def _uvicorn(group, text, cfg):
    """P9."""
    return {
        "level": status_level(group(2)),
        "message": F.concat(F.lit('"'), group(1), F.lit('" '), group(2)),
        "status_code": group(2).try_cast("int"),
    }


def _prefixed(group, text, cfg):
    """P10."""
    level = F.when(F.substring(text, 1, 20).contains("ERROR"), "ERROR").otherwise("INFO")
    return {"level": level, "message": text}


def _plain(group, text, cfg):
    """P11."""
    return {"level": F.lit("INFO"), "message": text}


def starts_with_prefix(text):
    return text.startswith(fixed.PYTHON_PREFIXES[0]) | text.startswith(fixed.PYTHON_PREFIXES[1])


def sample_hits(line):
    """Score of one sample line: a traceback header weighs three."""
    s = strip(line)
    one = (
        s.rlike(pattern(fixed.PYTHON_STD))
        | s.rlike(pattern(fixed.PYTHON_STD_LINE))
        | s.rlike(pattern(fixed.PYTHON_UVICORN))
        | s.contains(" - ERROR - ")
        | s.startswith(fixed.PYTHON_PREFIXES[0])
    )
    return F.when(s.startswith(fixed.TRACEBACK_HEADER), 3).when(one, 1).otherwise(0)


FORMAT = LogFormat(
    "python",
    "python",
    (
        LineForm("python_std", "python", _std, fixed.PYTHON_STD, 3),
        LineForm("python_std_line", "python", _std_line, fixed.PYTHON_STD_LINE, 4),
        LineForm("python_uvicorn", "python", _uvicorn, fixed.PYTHON_UVICORN, 2),
        LineForm("python_prefixed", "python", _prefixed, applies=starts_with_prefix),
        LineForm("python_plain", "python", _plain, applies=always),
    ),
    text=rstrip,
    hits={"python": sample_hits},
    score=lambda hit, n: F.least(F.lit(1.0), hit["python"] / n * 1.1),
)
