"""Cluster event tables and pod log rows."""

from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions import times
from faultline.functions.text import pattern
from faultline.operators.parse.forms import LineForm, LogFormat


def age_to_time(age, reference):
    """P20: ``<whole number>[smhd]`` before the reference time; anything else is NULL."""
    clean = F.lower(age)
    valid = F.when(clean.rlike(r"^[+-]?[0-9]{1,9}[smhd]$"), clean)
    count = F.regexp_extract(valid, r"^([+-]?[0-9]+)", 1).try_cast("bigint")
    unit = F.substring(valid, -1, 1)
    seconds = count * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return times.shifted(reference, -seconds)


def _event(group, text, cfg):
    """P19."""
    return {
        "ts": age_to_time(group(1), cfg.now()),
        "level": F.when(group(2) == "Warning", "WARNING").otherwise("INFO"),
        "message": F.concat(group(3), F.lit(": "), group(5)),
        "service": group(4),
        "metadata": F.create_map(F.lit("reason"), group(3), F.lit("type"), group(2)),
    }


def _pod_row(group, text, cfg):
    """P21."""
    return {
        "level": F.when(F.lower(group(3)).contains("error"), "ERROR").otherwise("INFO"),
        "message": group(3),
        "service": F.concat(group(1), F.lit("/"), group(2)),
    }


def _header_hit(s):
    return s.contains("LAST SEEN") & s.contains("REASON")


def _line_hit(s):
    tabbed = s.contains("\t") & (s.contains("pod/") | s.contains("Pod"))
    return _header_hit(s) | s.rlike(pattern(fixed.K8S_EVENT)) | tabbed


def _score(hit, n):
    share = hit["k8s"] / n
    return F.when(hit["k8s_header"] > 0, F.least(F.lit(1.0), 0.5 + share * 0.5)).otherwise(
        F.least(F.lit(1.0), share)
    )


FORMAT = LogFormat(
    "kubernetes",
    "kubernetes",
    (
        LineForm("k8s_event", "kubernetes", _event, fixed.K8S_EVENT, 5),
        LineForm("k8s_pod_row", "kubernetes", _pod_row, fixed.K8S_KUBECTL, 3),
    ),
    is_header=lambda s: s.contains("LAST SEEN") & s.contains("TYPE"),
    hits={"k8s": _line_hit, "k8s_header": _header_hit},
    score=_score,
)
