"""Web-server access and error lines."""

from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions import times
from faultline.functions.text import null_if_empty, pattern
from faultline.operators.parse.forms import LineForm, LogFormat, level_of, status_level


def _access(group, text, cfg):
    """P1, P2, P4."""
    status = group(6)
    return {
        "ts": times.day_month_year(group(2)),
        "level": status_level(status),
        "message": F.concat_ws(" ", group(3), group(4), status),
        "status_code": status.try_cast("int"),
        "response_time_ms": null_if_empty(group(10)).try_cast("double") * 1000.0,
        "metadata": F.create_map(F.lit("path"), group(4)),
    }


def _error(group, text, cfg):
    """P3, P5."""
    ts = times.naive(F.translate(group(1), "/", "-"))
    if cfg.error_log_tz is not None:
        ts = F.convert_timezone(F.lit(cfg.error_log_tz), F.lit("UTC"), ts)
    return {"ts": ts, "level": level_of(group(2), fixed.NGINX_ERROR_LEVELS, "INFO"), "message": group(3)}


ACCESS = LineForm("nginx_access", "nginx", _access, fixed.NGINX_ACCESS, 10)
ERROR = LineForm("nginx_error", "nginx", _error, fixed.NGINX_ERROR, 3)

FORMAT = LogFormat(
    "nginx",
    "nginx",
    (ACCESS, ERROR),
    hits={"nginx": lambda s: s.rlike(pattern(fixed.NGINX_ACCESS)) | s.rlike(pattern(fixed.NGINX_ERROR))},
    score=lambda hit, n: F.least(F.lit(1.0), hit["nginx"] / n * 1.2),
)
