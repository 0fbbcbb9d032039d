"""Container output."""

from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions import times
from faultline.functions.text import pattern, strip
from faultline.operators.parse.forms import LineForm, LogFormat, always, level_of


def _rfc(group, text, cfg):
    """The stream alone decides the level; nanoseconds are cut to microseconds."""
    return {
        "ts": times.naive(F.concat_ws(" ", group(1), F.substring(group(2), 1, 15))),
        "level": F.when(group(3) == "stderr", "WARNING").otherwise("INFO"),
        "message": group(4),
        "metadata": F.create_map(F.lit("stream"), group(3)),
    }


def _pipe(group, text, cfg):
    """P16."""
    return {
        "ts": times.naive(group(2)),
        "level": level_of(group(3), fixed.DOCKER_LEVELS, "INFO"),
        "service": strip(group(1)),
        "message": group(4),
    }


def _raw(group, text, cfg):
    """P17."""
    return {"level": F.lit("INFO"), "message": text}


def _is_container_line(s):
    return (
        s.contains(" stdout ")
        | s.contains(" stderr ")
        | s.rlike(pattern(fixed.DOCKER_RFC))
        | s.rlike(pattern(fixed.DOCKER_PIPE))
    )


FORMAT = LogFormat(
    "docker",
    "docker",
    (
        LineForm("docker_rfc", "docker", _rfc, fixed.DOCKER_RFC, 4),
        LineForm("docker_pipe", "docker", _pipe, fixed.DOCKER_PIPE, 4),
        LineForm("docker_raw", "docker", _raw, applies=always),
    ),
    hits={"docker": _is_container_line},
    score=lambda hit, n: F.least(F.lit(1.0), hit["docker"] / n),
)
