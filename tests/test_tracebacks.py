import random
import re

import pytest
from conftest import by_line

from faultline import Settings
from faultline.operators.parse import dispatch, tracebacks
from faultline.schema import LOG_LINES, ddl

HEADER = "Traceback (most recent call last):"


def walked(texts):
    """The blocks of one log, found by walking its lines: line number -> header line number."""
    owner, open_at = {}, None
    for number, text in enumerate(texts, 1):
        if open_at is not None:
            if not text.strip() or text[0] in " \t":
                owner[number] = open_at
                continue
            if re.match(r"^[\w.]+: .+", text.lstrip()):
                owner[number] = open_at
                open_at = None
                continue
            open_at = None
        if text.strip().startswith(HEADER):
            owner[number] = open_at = number
    return owner


PIECES = [HEADER, "  " + HEADER, "", "   ", "  File x", "\tindented", "ValueError: x", "KeyError", "free text", "a: b"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100_000])
def test_random_logs_against_a_walk(spark, chunk):
    rng = random.Random(chunk)
    logs = {f"log-{i}": [rng.choice(PIECES) for _ in range(rng.randint(1, 14))] for i in range(400)}
    rows = [(log, n, text) for log, texts in logs.items() for n, text in enumerate(texts, 1)]
    frame = spark.createDataFrame(rows, ddl(LOG_LINES))
    got = {
        (r.log_id, r.line_number): r.block
        for r in tracebacks.assign(frame, Settings(chunk_lines=chunk)).collect()
        if r.block is not None
    }
    want = {(log, n): start for log, texts in logs.items() for n, start in walked(texts).items()}
    assert got == want


def test_merged_entry(lines):
    text = f'{HEADER}  \n  File "a.py", line 1\n\n    raise X\napp.X: {"y" * 600}\nnext'
    first, second = by_line(dispatch.entries(dispatch.parse_as(lines(text), "python", Settings())))
    assert (first.line_number, first.level, first.ts) == (1, "ERROR", None)
    assert first.message == "app.X: " + "y" * 493
    assert first.stack_trace.split("\n")[:3] == [HEADER, '  File "a.py", line 1', ""]
    assert first.raw_line == f"{HEADER}  "
    assert (second.message, second.level) == ("next", "INFO")


def test_open_at_the_end(lines):
    rows = by_line(dispatch.entries(dispatch.parse_as(lines(f"{HEADER}\n{HEADER}\n  x\n\n"), "python", Settings())))
    assert [r.message for r in rows] == [HEADER, ""]
    assert rows[1].stack_trace == f"{HEADER}\n  x\n"


def test_prefixed_line_right_after_a_block_is_swallowed(lines):
    rows = by_line(dispatch.entries(dispatch.parse_as(lines(f"{HEADER}\n  x\nINFO:     y"), "python", Settings())))
    assert [r.message for r in rows] == ["INFO:     y"]
