import pytest
from pyspark.sql import functions as F

from dwellgrid.sources import checked, scan, sinks


def test_missing_kinds(spark):
    rows = [(0, None), (1, "null"), (2, '{"k": null}'), (3, '{"k": 1.5, "on": true, "name": "x"}'), (4, '{"k": 2, "status": "error"}')]
    out = scan.flatten_stream(spark.createDataFrame(rows, "i int, s string"), "s", "m", {"k": "double", "on": "boolean", "name": "string"})
    got = [(r.m_k, r.m_on, r.m_name, r.m_ok) for r in out.orderBy("i").collect()]
    assert got == [(None, None, "MISSING", False), (None, None, "MISSING", False), (None, None, "MISSING", True),
                   (1.5, 1.0, "x", True), (2.0, None, "MISSING", False)]


def test_corrupt_streams_keep_their_rows(spark):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("b", "{truncated"), ("c", None)], "f string, s string")
    good, bad = scan.quarantine(df, "s", "k bigint")
    assert sorted((r.f, r.k) for r in good.collect()) == [("a", 1), ("b", None), ("c", None)]
    assert [r.f for r in bad.collect()] == ["b"]


def test_coverage_of_requests():
    assert scan.covers("all", "x") and scan.covers(["x", "y"], "x") and not scan.covers(["x"], "all") and not scan.covers("x", ["x", "y"])


def test_jsonl(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"provenance": "x"}\n\n{"file": "a", "ok": true}\n{"file": "b", "ok": false}\n')
    df = checked.read_lines(spark, str(path), "file string, ok boolean", "provenance")
    assert sorted((r.file, r.ok) for r in df.collect()) == [("a", True), ("b", False)]
    with pytest.raises(ValueError, match="duplicate"):
        checked.require_unique(df.union(df), ["file"])


def test_versions_are_named(spark):
    df = spark.createDataFrame([("v1", "d1"), ("v2", "d1")], "version string, day string")
    with pytest.raises(KeyError, match="v1"):
        checked.require_version(df, "version", "v3")
    with pytest.raises(KeyError, match="nothing for"):
        checked.read_product(df, "v1", F.col("day"), "d9")


def test_parameter_hash_ignores_order():
    assert checked.parameter_hash({"a": 1, "b": 2}) == checked.parameter_hash({"b": 2, "a": 1}) != checked.parameter_hash({"a": 1, "b": 3})


def test_write_refuses_partial_files_and_overwrites(spark, tmp_path):
    raw = spark.createDataFrame([("a", 0, "d"), ("a", 1, "d"), ("b", 0, "e")], "file string, row int, day string")
    path = str(tmp_path / "p")
    args = dict(version="v1", file="file", row="row", day="day")
    with pytest.raises(ValueError, match="raw rows"):
        sinks.write_product(raw.where("row = 0"), raw, path, **args)
    with pytest.raises(ValueError, match="raw rows"):
        sinks.write_product(raw.union(raw.where("file = 'b'")), raw, path, **args)
    sinks.write_product(raw, raw, path, **args)
    with pytest.raises(FileExistsError):
        sinks.write_product(raw, raw, path, **args)
    one = raw.where("file = 'b'")
    sinks.write_product(one, one, path, overwrite=True, **args)  # replaces its own day only
    assert spark.read.parquet(path).count() == 3


def test_file_hashes(spark, tmp_path):
    import hashlib
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert checked.file_hashes(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_default_keys_are_those_of_every_file(spark):
    cube = spark.createDataFrame([("f", 0, "a", 1.0), ("f", 0, "b", 2.0), ("g", 0, "a", 3.0)], "file string, row int, key string, v double")
    out = scan.load_spectra(cube, cube.select("file", "row"), ["file", "row"], "key", "v")
    assert out.columns == ["file", "row", "a"]
    with pytest.raises(Exception, match="lacks a key"):
        scan.load_spectra(cube, cube.select("file", "row"), ["file", "row"], "key", "v", keys=["a", "b"], missing="raise").collect()


def test_differing_channel_counts_are_refused(spark):
    rows = [("f", 0, "a", [1.0, 2.0]), ("f", 0, "b", [1.0, 2.0, 3.0]), ("g", 0, "a", [3.0, 4.0]), ("g", 0, "b", None), ("h", 0, "a", [5.0])]
    cube = spark.createDataFrame(rows, "file string, row int, key string, v array<double>")
    ids = cube.select("file", "row")
    with pytest.raises(ValueError, match="1 to 3 channels"):
        scan.load_spectra(cube, ids, ["file", "row"], "key", "v", keys=["a", "b"])
    kept = scan.load_spectra(cube, ids.where("file <> 'h'"), ["file", "row"], "key", "v", keys=["a"]).orderBy("file").collect()
    assert [r.a for r in kept] == [[1.0, 2.0], [3.0, 4.0]]
    assert scan.load_spectra(cube, ids.where("file = 'h'"), ["file", "row"], "key", "v").columns == ["file", "row", "a"]
