"""Documents as text files, and whole lists in report documents."""

import pathlib

import oracle_check
import pytest

from faultline.config import Settings
from faultline.plans import driver_queries, lanes, staging
from faultline.plans.oracles import ORACLES
from faultline.sources import logs

FOLDER = "/root/testdata/sf0.001"


def folders_of(path: str) -> tuple[int, int]:
    files = list(pathlib.Path(path).rglob("*.txt*"))
    files = [f for f in files if not f.name.startswith(".")]
    return len({f.parent for f in files}), len(files)


def test_files_of_one_document_share_folders(spark):
    path, names = driver_queries._own_files(spark, FOLDER)
    documents = lanes.documents(spark, FOLDER).count()
    folders, files = folders_of(path)
    assert files == documents == names.count() and folders == 1


def test_own_files_hold_their_documents_whatever_writes_them(spark, tmp_path, monkeypatch):
    documents = {r.log_id: (r.text or "") + "\n" for r in lanes.documents(spark, FOLDER).collect()}

    def held(place, names):
        numbers = {(r.folder, r.number): r.name for r in names.collect()}
        files = [f for f in pathlib.Path(place).rglob("*c*.txt") if not f.name.startswith(".")]
        return {numbers[int(f.parent.name.split("=")[1]), int(f.stem.rsplit("c", 1)[1])]: f.read_bytes().decode() for f in files}

    path, names = driver_queries._own_files(spark, FOLDER)
    assert held(path, names) == documents
    assert not list(pathlib.Path(path).rglob(".*"))  # a file each, and no checksum file by it
    spark.conf.set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(staging, "shared_folder", lambda _: "viewfs://own/in")
    path, names = driver_queries._own_files(spark, FOLDER)
    assert held(path.replace("viewfs://own/in", str(tmp_path)), names) == documents
    spark.conf.unset("fs.viewfs.mounttable.own.link./in")


def test_verdicts_of_guards_are_taken_once(spark, tmp_path):
    for name, text in {"a": "1\n2\n3", "b": "1\n2", "c": "x" * 9, "d": "x" * 30, "e": "1\n2\n3\n4"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    cfg = Settings(max_bytes=20, max_line_breaks=1, whole_file_bytes=6)
    read = logs.read(spark, str(tmp_path), cfg)
    assert sorted((pathlib.Path(r.log_id).stem, r.reason) for r in read.quarantine.collect()) == [("a", "too_many_lines"), ("d", "file_too_large"), ("e", "too_many_lines")]
    assert sorted(pathlib.Path(r.log_id).stem for r in read.logs.collect()) == ["b", "c"]
    assert not [f for f in read.logs.inputFiles() if f.endswith(".txt")]  # the texts are not read again for this


def test_documents_share_files(spark):
    path, _ = driver_queries._shared_files(spark, FOLDER)
    folders, files = folders_of(path)
    assert folders <= 4 and files < lanes.documents(spark, FOLDER).count() / 4


@pytest.mark.parametrize("size", [1, 1_500, 64 << 20])
def test_lines_of_documents_in_shared_files(spark, monkeypatch, size):
    monkeypatch.setattr(driver_queries, "TEXTS_A_FILE", 7)
    found = driver_queries._read_back(spark, *driver_queries._shared_files(spark, FOLDER), size)
    assert oracle_check.compare(found, oracle_check.connect(FOLDER), ORACLES["text_file_lines"]) is None


def test_report_shape_counts_anomalies_past_the_inline_rows(spark):
    found = driver_queries.report_shape(spark, FOLDER, 3)
    assert oracle_check.compare(found, oracle_check.connect(FOLDER), ORACLES["report_shape"]) is None


def test_steps_return_what_arrow_took():
    import pyarrow as pa

    from faultline.llm.shared import steps

    batch = pa.record_batch({"text": pa.array(["x" * 1_000_000, None, "", "é"] * 40)})
    before = pa.total_allocated_bytes()
    most, seen = 0, []
    for part, texts in steps(iter([batch]), encoding=True):
        most = max(most, pa.total_allocated_bytes() - before)
        seen += list(zip(part.column(0).to_pylist(), texts, strict=True))
    assert [(t or "").encode() for t, _ in seen] == [b for _, b in seen] and len(seen) == 160
    assert most < 10_000_000  # a step's texts, not the batch's


def test_packing_reads_its_rounds_as_one_table(spark):
    from faultline.llm.packing import pack
    from faultline.llm.shared import Scratch

    pieces = spark.range(300).selectExpr("id AS doc_id", "1 + (id * 37) % 97 AS length")
    placed = pack(pieces, 100, Scratch(spark))
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4
    rows = placed.collect()
    ends = {}
    for row in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == ends.get(row.sequence_id, 0)
        ends[row.sequence_id] = row.offset + row.length
    assert len(rows) == 300 and max(ends.values()) <= 100
