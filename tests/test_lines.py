"""Line numbers over many splits, and the lines that do not fit."""

import pytest

from tidemark.sources import lines as L


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbers_run_over_splits_and_files(spark, tmp_path, small_splits):
    texts = {}
    for name, n in (("a b", 400), ("c+d", 3), ("empty", 0), ("é", 150)):
        (tmp_path / name).mkdir()
        texts[f"{name}/f.txt"] = ["" if i % 9 == 0 else f"{name} {i} " + "x" * (i % 37) for i in range(n)]
        (tmp_path / name / "f.txt").write_text("".join(x + "\n" for x in texts[f"{name}/f.txt"]), encoding="utf-8")
    texts["long.txt"] = ["y" * 5000, "z", "y" * 3000, "end"]
    (tmp_path / "long.txt").write_text("\n".join(texts["long.txt"]))
    got = L.numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1
    want = {(file, i, x) for file, lines in texts.items() for i, x in enumerate(lines, 1)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_bad_csv_lines(spark, tmp_path, small_splits):
    rows = ["id,value"] + [f"{i},{'bad' if i % 50 == 7 else i / 2}" for i in range(300)]
    rows[100], rows[101] = "", "100,1.0,too many"
    (tmp_path / "one.csv").write_text("﻿" + "\n".join(rows), encoding="utf-8")
    (tmp_path / "two.csv").write_text("id,value\n1,2\nx,3\n")
    got = {tuple(r) for r in L.bad_csv_lines(spark, str(tmp_path), "id long, value double", {"id", "value"}).collect()}
    want = {("one.csv", i + 1, x) for i, x in enumerate(rows) if "bad" in x or "many" in x} | {("two.csv", 3, "x,3")}
    assert got == want
    with pytest.raises(ValueError, match="other"):
        L.bad_csv_lines(spark, str(tmp_path), "id long, other double", {"other"})


def test_bad_json_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"a": 1}]\n\n{"a": 2}\n[{"a": 3}\nnot json\n  [] \n')
    got = {(r["line"], r["problem"], r["text"]) for r in L.bad_json_lines(spark, str(tmp_path)).collect()}
    assert got == {(3, "not_a_list", '{"a": 2}'), (4, "malformed", '[{"a": 3}'), (5, "malformed", "not json")}
