import json
import struct

import pytest
from pyspark.sql import functions as F

from arealis.sources import pipe, sinks
from arealis.streaming.cohorts import windowed_counts


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lenient_reader(spark, tmp_path):
    path = write(tmp_path / "a.txt", "1| x |2\n\n3|y|\n")
    assert [tuple(r) for r in pipe.read_lenient(spark, path, ["a", "b", "c"]).collect()] == [("1", "x", "2"), ("3", "y", "")]
    with pytest.raises(Exception, match="expected 2 fields"):
        pipe.read_lenient(spark, path, ["a", "b"]).collect()
    row = pipe.widths(spark, write(tmp_path / "b.txt", "1|2\n1|2|3\n")).first()
    assert (row["rows"], row["widths"]) == (2, [2, 3])


FIELDS = [pipe.Field("id", "long", False), pipe.Field("v", "double"), pipe.Field("ok", "boolean"), pipe.Field("at", "timestamp"), pipe.Field("s")]


def test_strict_reader(spark, tmp_path):
    path = write(tmp_path / "a.txt", '1|2.5|t|2024-01-02T03:04:05Z|"q\n2|\\N|f|\\N|\n')
    rows = pipe.read_strict(spark, path, FIELDS, ["id"], "src", "snap").orderBy("id").collect()
    assert [(r.id, r.v, r.ok, r.s, r.source_id) for r in rows] == [(1, 2.5, True, '"q', "src"), (2, None, False, "", "src")]
    assert rows[0].at.hour == 3 and rows[0].source_file == "a.txt"
    for bad in ("x|1|t|\\N|s", "1|nan|t|\\N|s", "1|1|true|\\N|s", "1|1|t|2024-01-02|s", "\\N|1|t|\\N|s", "1|1|t|\\N"):
        with pytest.raises(Exception):
            pipe.read_strict(spark, write(tmp_path / "bad.txt", bad + "\n"), FIELDS).collect()
    with pytest.raises(ValueError, match="repeat the key"):
        pipe.read_strict(spark, write(tmp_path / "twice.txt", "1|1|t|\\N|s\n1|2|t|\\N|s\n"), FIELDS, ["id"])


def test_json_sources(spark):
    m = spark.createDataFrame([(json.dumps([["NAME", "e", "state", "county"], ["A", "5", "17", "031"], ["B", None, "17", "043"]]),)], "j string")
    assert [(r.record_id, r["values"]["e"]) for r in pipe.json_matrix(m, "j", ["state", "county"]).collect()] == [("17031", "5"), ("17043", None)]
    page = {"features": [{"properties": {"n": "1"}, "geometry": {"type": "Polygon", "coordinates": []}}]}
    g = spark.createDataFrame([(json.dumps(page),)], "j string")
    assert [tuple(r) for r in pipe.geojson_features(g, "j", "n string").collect()] == [("1", "Polygon", "[]")]
    page["features"][0]["geometry"]["type"] = "Point"
    with pytest.raises(Exception, match="no polygon"):
        pipe.geojson_features(spark.createDataFrame([(json.dumps(page),)], "j string"), "j", "n string").collect()


def test_hex_geometry(spark):
    ring = struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    polygon = struct.pack("<BII", 1, 0x20000003, 4326) + struct.pack("<I", 1) + ring
    multi = struct.pack("<BII", 1, 6, 1) + struct.pack("<BII", 1, 3, 1) + ring
    df = spark.createDataFrame([(polygon.hex(),), (multi.hex(),), ("zz",), ("01",), (None,)], "h string")
    got = [r[0] for r in df.select(pipe.ewkb_to_wkt("h")).collect()]
    assert got == ["POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", None, None, None]


def test_optional_table_and_checksums(spark, tmp_path):
    assert pipe.optional_parquet(spark, str(tmp_path / "none"), "a int").count() == 0
    spark.range(3).write.parquet(str(tmp_path / "some"))
    assert pipe.optional_parquet(spark, str(tmp_path / "some"), "id long").count() == 3
    folder = tmp_path / "files"
    folder.mkdir()
    write(folder / "x", "abc")
    found = pipe.checksums(spark, str(folder))
    ledger = found.select("path", F.lit("0").alias("sha256")).union(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    assert sorted(r.problem for r in pipe.verified(found, ledger).collect()) == ["changed", "missing"]
    assert pipe.verified(found, found).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.1 + 0.2), (1, 1e20), (3, None)], "k int, v double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["k"])
    lines = [line for f in sorted((tmp_path / "csv").glob("part-*")) for line in f.read_text().split("\n")[1:] if line]
    assert lines == ["1,1e+20", "2,0.3", "3,"]
    sinks.publish(df, str(tmp_path / "p"), ["k"], ["k", "v"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    with pytest.raises(Exception):
        sinks.publish(df, str(tmp_path / "p"), ["k"], ["k", "v"])
    with pytest.raises(ValueError):
        sinks.publish(df.union(df), str(tmp_path / "q"), ["k"], ["k", "v"])
    assert sinks.manifest(df, "d") == sinks.manifest(df.repartition(3), "d") != sinks.manifest(df.limit(1), "d")


def test_rebuild_reasons():
    done = {"complete": True, "inputs": {"a": "1"}, "parameters": {"x": 1}}
    cases = [(None, {"a": "1"}, {"x": 1}), (done, {"a": "1"}, {"x": 2}), (done, {"b": "1"}, {"x": 1}), (done, {"a": "2"}, {"x": 1}), (done | {"complete": False}, {"a": "1"}, {"x": 1}), (done, {"a": "1"}, {"x": 1})]
    assert [sinks.rebuild_reason(*c) for c in cases] == ["no_manifest", "parameters_changed", "inputs_differ", "input_changed", "incomplete", None]


def test_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "event_type", "value", 10).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    as_text = lambda df: df.withColumn("window_start", F.col("window_start").cast("string"))
    assert as_text(spark.table("counts")).exceptAll(as_text(windowed_counts(events, "event_type", "value", 10))).isEmpty()


def test_strict_reader_numbers_lines_and_refuses_what_is_not_finite_or_utf8(spark, tmp_path):
    path = write(tmp_path / "n.txt", "".join(f"{i}|{'x' * (i % 7)}\n" for i in range(1, 400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = pipe.read_strict(spark, path, [pipe.Field("id", "long"), pipe.Field("s")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    data = open(path, "rb").read()
    assert sorted(r.source_row for r in rows) == list(range(1, 400)) and all(r.source_row == r.id for r in rows)
    assert all(data[r.source_offset :].startswith(f"{r.id}|".encode()) for r in rows)
    for kind, bad in (("double", "1e999"), ("timestamp", "2024-01-01 10:00:00+00:00"), ("timestamp", "2024-01-01T10:00:00+0000"), ("timestamp", "2024-01-01T10:00:00.1234567Z")):
        with pytest.raises(Exception, match="not a"):
            pipe.read_strict(spark, write(tmp_path / "bad.txt", bad + "\n"), [pipe.Field("v", kind)]).collect()
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9\n")
    with pytest.raises(Exception, match="(?i)utf"):
        pipe.read_strict(spark, str(tmp_path / "latin.txt"), [pipe.Field("v")]).collect()
    assert pipe.read_lenient(spark, str(tmp_path / "latin.txt"), ["v"]).first().v == "caf\ufffd"


def test_manifest_tells_repeated_rows_apart(spark):
    one, other = (spark.createDataFrame([(x,) for x in v], "x long") for v in ((1, 1, 2, 2), (7, 7, 9, 9)))
    assert json.loads(sinks.manifest(one, "t"))["rows_digest"] != json.loads(sinks.manifest(other, "t"))["rows_digest"]


def test_headed_reader_checks_header_width_and_patterns(spark, tmp_path):
    read = lambda text: pipe.read_headed(spark, write(tmp_path / f"{abs(hash(text))}.txt", text), ["a", "b"], {"b": r"\d+"})
    assert [tuple(r) for r in read("﻿a|b\r\nx|1\r\n|22\r\n").collect()] == [("x", "1"), ("", "22")]
    assert read("a|b\n").collect() == []
    for text in ("a|c\nx|1\n", "x|1\n", ""):
        with pytest.raises(ValueError, match="header"):
            read(text)
    for text in ("a|b\nx|1|2\n", "a|b\nx\n", "a|b\nx|1a\n", "a|b\nx|\n"):
        with pytest.raises(Exception, match="malformed row 2"):
            read(text).collect()


def test_probed_counts(spark):
    said = {
        '[{"count": "12"}]': 12, '[{"count": 12}]': 12, "count\n12\n": 12, '"count"\n"12"': 12, " [{\"count\": 0}] ": 0,
        '{"type": "FeatureCollection", "features": [{"properties": {"count": 3}}]}': 3,
        '{"count": 12}': None, '[{"count": "012"}]': None, '[{"count": -1}]': None, '[{"count": 1.0}]': None, '[{"count": true}]': None, '[{"n": 1}]': None,
        '[{"count": 1}, {"count": 2}]': None, "[]": None, "count\n1\n2\n": None, "count\n101\n": None, "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: r.n for r in df.select("t", pipe.probed_count("t", 100).alias("n")).collect()} == said


def test_json_is_read_only_if_the_ledger_agrees(spark, tmp_path):
    write(tmp_path / "a.json", '{"k": 1}\n')
    listed = pipe.checksums(spark, str(tmp_path)).select("path", "sha256")
    assert pipe.read_verified_json(spark, str(tmp_path), "k long", listed).first().k == 1
    for ledger in (listed.withColumn("sha256", F.lit("0")), listed.limit(0)):
        with pytest.raises(ValueError, match="ledger"):
            pipe.read_verified_json(spark, str(tmp_path), "k long", ledger)
