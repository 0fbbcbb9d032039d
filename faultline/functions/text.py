"""String helpers whose results agree with Python's text rules, built from JVM-side functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space in str.strip().
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_MARK = "\x01"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def pattern(body: str, ignore_case: bool = False) -> str:
    """Unicode classes, and only newline as a line end, as in Python's default matching."""
    return ("(?Udi)" if ignore_case else "(?Ud)") + body


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A higher-order function also keeps its projection out of whole-stage code generation. That is wanted here: a wide
    parsing projection fused into one method outgrows what the JVM compiles, while on its own it is split up.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def captures(text: Column, anchored: str, groups: int) -> Column:
    """All groups of a pattern that spans the whole (already matched) text, as an array, unmatched groups empty.

    One substitution and one split replace a matcher run per group. Text holding the separator itself takes the
    slow route, so the result is exact for any input.
    """
    joined = F.regexp_replace(text, anchored, _MARK.join(f"${i}" for i in range(1, groups + 1)))
    one_by_one = F.transform(
        F.sequence(F.lit(1), F.lit(groups)),
        lambda i: F.call_function("regexp_extract", text, F.lit(anchored), i),
    )
    return F.when(text.contains(_MARK), one_by_one).otherwise(F.split(joined, _MARK, -1))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def first_chars(text: Column, count: int) -> Column:
    return F.substring(text, 1, count)


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit
