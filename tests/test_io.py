"""Scans and sinks on files."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import io


def test_checked_csv_needs_its_columns_and_keeps_broken_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿participant_id,value\n1,2.5\n2,oops\n".encode())
    rows = io.checked_csv(spark, str(path), "participant_id long, value double", {"participant_id", "value"}).collect()
    assert sorted((r["value"], r["_corrupt"]) for r in rows if r["_corrupt"] is None) == [(2.5, None)]
    assert [r["_corrupt"] for r in rows if r["_corrupt"]] == ["2,oops"]
    with pytest.raises(ValueError, match="missing required"):
        io.checked_csv(spark, str(path), "x long", {"x"})


def test_csv_columns_go_by_name_and_not_by_place(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("b,other,a\n2,x,1\n")
    assert [r["a"] for r in io.wide_csv(spark, str(path), "a long, b long", ["a"]).collect()] == [1]
    row = io.checked_csv(spark, str(path), "a long, b long", {"a", "b"}).first()
    assert (row["a"], row["b"], row["_corrupt"]) == (1, 2, None)


def test_json_lists(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r["a"] for r in io.json_arrays(spark, str(path), "a long", whole_file=True).collect()) == [1, 2]
    assert io.json_arrays(spark, str(tmp_path / "none.json"), "a long").count() == 0


def test_corpus_files(spark, tmp_path):
    (tmp_path / "x.md").write_text("# Title\nsource: one；level: high\n## First\nbody a\n## Empty\n\n## source: z\nbody c\n## Last\nsource: b")
    (tmp_path / "y.md").write_text("# Only\nplain body")
    rows = io.text_corpus(spark, str(tmp_path))
    meta = rows.filter("text like '%level%'").select(io.header_metadata(F.col("text")).alias("m")).first()["m"]
    assert meta == {"source": "one", "level": "high"}
    assert [(r["section_no"], r["title"], r["body"]) for r in io.sections(rows).orderBy("section_no", "title").collect()] == [
        (0, "First", "body a"), (0, "Only", "plain body"), (3, "Last", "source: b")]


def test_file_manifest_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    row = io.file_manifest(spark, str(tmp_path)).first()
    assert (row["path"], row["bytes"], row["sha256"]) == ("f.bin", 3, hashlib.sha256(b"abc").hexdigest())


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in io.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_file_manifest_reads_files_beyond_two_gib_in_pieces(spark, tmp_path):
    import hashlib

    size = (1 << 31) + 1
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)  # a hole: no disk is used
    want, block = hashlib.sha256(), bytes(1 << 22)
    for _ in range(size >> 22):
        want.update(block)
    want.update(bytes(size & ((1 << 22) - 1)))
    row = io.file_manifest(spark, str(tmp_path)).first()
    assert (row["path"], row["bytes"], row["sha256"]) == ("large.bin", size, want.hexdigest())


def test_artifact_manifest_counts_rows_and_positives(spark, tmp_path):
    import hashlib

    for folder, text in {"a": "y,z\n1,x\n1.0,x\n0,x\n", "b + c%20é": "y,z\n1,x\nnone,x\n,x\n", "d": "y,z\n"}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.csv").write_text(text)
    got = {r["path"]: (r["n_total"], r["n_positive"], r["sha256"]) for r in io.artifact_manifest(spark, str(tmp_path), "y").collect()}
    digest = lambda folder: hashlib.sha256((tmp_path / folder / "same.csv").read_bytes()).hexdigest()
    assert got == {
        "a/same.csv": (3, 2, digest("a")), "b + c%20é/same.csv": (3, 1, digest("b + c%20é")), "d/same.csv": (0, 0, digest("d")),
    }
