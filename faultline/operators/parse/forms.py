"""Building blocks shared by the format modules.

A log format is an ordered list of line forms. Parsing a frame takes three projections: choose the form of every line,
capture the groups of that form, and build the entry columns from the groups. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import text as txt
from faultline.schema import ENTRY_FIELDS

Groups = Callable[[int], Column]
Builder = Callable[[Groups, Column, "object"], dict[str, Column]]

# form names that do not give an entry
SKIPPED = "skipped"
HEADER = "header"
BLANK = "blank"


@dataclass(frozen=True)
class LineForm:
    """One shape of a line: when it applies, what it captures and which entry columns it fills."""

    name: str
    source: str
    build: Builder
    grammar: str | None = None
    groups: int = 0
    applies: Callable[[Column], Column] | None = None
    # entries of this form are still counted as skipped lines
    counts_as_skipped: bool = False

    def matches(self, text: Column) -> Column:
        if self.applies is not None:
            return self.applies(text)
        return text.rlike(txt.pattern(self.grammar))

    def captured(self, text: Column) -> Column:
        if self.grammar is None:
            return F.array().cast("array<string>")
        return txt.captures(text, txt.pattern(self.grammar), self.groups)


@dataclass(frozen=True)
class LogFormat:
    name: str
    source: str
    forms: tuple[LineForm, ...]
    # Python log lines keep their indentation; all other formats are stripped on both sides
    text: Callable[[Column], Column] = txt.strip
    # lines that are neither entries nor skipped
    is_header: Callable[[Column], Column] | None = None
    # score terms per sample line and the score as a function of their sums
    hits: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    score: Callable[[dict[str, Column], Column], Column] | None = None

    def choose(self, text: Column) -> Column:
        chosen = F.when(self.is_header(text), HEADER) if self.is_header else F.when(F.lit(False), HEADER)
        for form in self.forms:
            chosen = chosen.when(form.matches(text), form.name)
        return chosen.otherwise(SKIPPED)


def always(_: Column) -> Column:
    return F.lit(True)


def level_of(word: Column, levels: dict[str, str], otherwise: str) -> Column:
    table = F.create_map(*[F.lit(part) for pair in levels.items() for part in pair])
    return F.coalesce(F.try_element_at(table, F.upper(word)), F.lit(otherwise))


def status_level(status: Column) -> Column:
    # a status too long for a number is above 500 all the same
    number = F.coalesce(status.try_cast("bigint"), F.lit(500))
    return F.when(number >= 500, "ERROR").when(number >= 400, "WARNING").otherwise("INFO")


def columns_of(forms: list[LineForm], form: Column, group: Groups, text: Column, cfg) -> dict[str, Column]:
    """Entry columns for a frame whose lines were assigned to ``forms``."""
    built = {f.name: f.build(group, text, cfg) | {"source": F.lit(f.source)} for f in forms}
    out = {}
    for name, kind in ENTRY_FIELDS.items():
        by_value: list[tuple[str, Column]] = [(f, cols[name]) for f, cols in built.items() if name in cols]
        missing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        value = missing if name == "metadata" else F.lit(None)
        if by_value:
            chain = F
            for f, expr in by_value:
                chain = chain.when(form == f, expr)
            value = chain.otherwise(value)
        out[name] = value.cast(kind)
    return out
