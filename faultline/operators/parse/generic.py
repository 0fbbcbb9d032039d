"""Any other text: every non-blank line becomes an entry."""

from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions import times
from faultline.functions.text import pattern
from faultline.operators.parse.forms import LineForm, LogFormat, always, level_of


def first_time(text):
    """The first ISO-like time without its fraction, else the first slash-style time."""
    iso = F.concat_ws(
        " ",
        F.regexp_extract(text, pattern(fixed.GENERIC_ISO), 1),
        F.regexp_extract(text, pattern(fixed.GENERIC_ISO), 2),
    )
    slashed = F.translate(F.regexp_extract(text, pattern(fixed.GENERIC_SLASHED), 1), "/", "-")
    return F.coalesce(times.naive(iso), times.naive(slashed))


def _line(group, text, cfg):
    word = F.regexp_extract(text, pattern(fixed.GENERIC_LEVEL, ignore_case=True), 1)
    return {"ts": first_time(text), "level": level_of(word, fixed.PYTHON_LEVELS, "UNKNOWN"), "message": text}


FORMAT = LogFormat("generic", "unknown", (LineForm("generic", "unknown", _line, applies=always),))
