"""Checked joins, the annotator, text formats and the stream, on nulls, ties, repeats and empty tables."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomline.functions import json_text
from loomline.operators import annotator, joins
from loomline.sources import files
from loomline.streaming.replay import hourly_events


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k long, x string")
    right = spark.createDataFrame([(1, 5), (3, 6)], "k long, y long")
    got = {(r["k"], r["x"], r["y"]) for r in joins.one_to_one(left, right, ["k"]).collect()}
    assert got == {(1, "a", 5), (2, None, None), (None, "c", None)}
    for a, b in ((left.unionByName(left), right), (left, right.unionByName(right))):
        with pytest.raises(PySparkException, match="key repeated"):
            joins.one_to_one(a, b, ["k"]).collect()
    assert {tuple(r) for r in joins.repeated_keys(left.unionByName(left), ["k"]).collect()} == {(1, 2), (2, 2)}
    assert joins.one_to_one(left.where("false"), right, ["k"]).count() == 0


def test_resolve_candidates(spark):
    right = [("k1", "t", 1), ("k2", "a", 1), ("k2", "b", 2), ("k3", "a", 1), ("k3", "b", 2), ("k3", "b", 2), ("k4", "s", 1), ("k4", "s", 9), ("k5", "a", 1), ("k5", "b", 1), ("k6", None, None), ("k7", None, 1), ("k7", None, 2), (None, "z", 1)]
    left = [(1, "k1", "other", 7), (2, "k2", "a", 9), (3, "k3", "x", 2), (4, "k4", "x", 7), (5, "k5", "x", 1), (6, "k6", "x", 1), (7, "k7", "x", 3), (8, "none", "x", 1), (9, None, "x", 1), (10, "k7", None, 1)]
    got = joins.resolve_candidates(spark.createDataFrame(left, "i long, k string, t string, s long"), spark.createDataFrame(right, "k string, t string, s long"), "i", "k", "t", "s")
    assert {r["i"]: (r["candidates"], r["method"], r["resolved"]) for r in got.collect()} == {
        1: (1, "single", "t"), 2: (2, "body_exact", "a"), 3: (3, "word_count_derived", "b"), 4: (2, "candidates_identical", "s"), 5: (2, "ambiguous", None), 6: (1, "single", None),
        7: (2, "candidates_identical", None), 8: (0, "no match", None), 9: (0, "no match", None), 10: (2, "body_exact", None),
    }


def test_annotator(spark):
    calls: dict[str, int] = {}

    def call(text):
        calls[text] = calls.get(text, 0) + 1
        if text == "never" or (text == "second" and calls[text] < 2):
            raise ValueError("busy")
        return "" if text == "" else text.upper()

    df = spark.createDataFrame([(1, "one"), (2, "second"), (3, "never"), (4, None), (5, "")], "id long, t string").coalesce(1)
    got = {r["id"]: (r["answer"], r["error"], r["attempts"]) for r in annotator.annotate(df, "id", "t", call, wait=0.0).collect()}
    assert got == {1: ("ONE", None, 1), 2: ("SECOND", None, 2), 3: (None, "ValueError: busy", 3), 4: (None, None, 0), 5: ("", None, 1)}
    assert annotator.annotate(df.where("false"), "id", "t", call).count() == 0
    rows = spark.createDataFrame([(1, 'x {"central": " YES", "reason": " r "} y', True), (2, "none", True), (3, "{}", True), (4, "x", False), (5, "x", None)], "id long, t string, ok boolean")
    flags = {r["id"]: (r["flag"], r["reason"]) for r in annotator.gate(rows, "id", "t", "ok", lambda t: t, wait=0.0).collect()}
    assert flags == {1: (True, "r"), 2: (None, "ERROR: no object"), 3: (False, ""), 4: (False, "excluded before"), 5: (False, "excluded before")}


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, " a|b ", ""), (2, None, "x\ny"), (3, "</script>", "é")], "i long, a string, b string")
    files.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, files.read_strings(spark, f"{tmp_path}/c", ["i", "a", "b"]).collect())) == [("1", "a|b", None), ("2", None, "x\ny"), ("3", "</script>", "é")]
    assert sorted(map(tuple, files.as_parquet(spark, f"{tmp_path}/c", f"{tmp_path}/p", "i long, a string, b string").collect())) == sorted(map(tuple, df.collect()))
    files.write_document(df, f"{tmp_path}/d")
    assert sorted(map(tuple, files.read_document(spark, f"{tmp_path}/d", "i long, a string, b string").collect())) == sorted(map(tuple, df.collect()))
    files.write_document(df.where("false"), f"{tmp_path}/e")
    assert files.read_document(spark, f"{tmp_path}/e", "i long, a string, b string").count() == 0
    assert files.shaped(df, ["b", "gone"], {"a": "z", "gone": "y"}).columns == ["i", "z"]
    assert [r["line"] for r in files.markdown(df.select("a")).orderBy("n").collect()] == ["| a |", "|---|", "|  |", "|  a\\|b  |", "| </script> |"]
    assert files.page("<script>x = __DATA__</script>", df.select("i", "a").where("i = 3")).first()["html"] == '<script>x = [{"i":3,"a":"<\\/script>"}]</script>'
    with pytest.raises(ValueError, match="schemas differ"):
        files.union_strict(df, df.withColumn("i", F.col("i").cast("int")))
    assert files.union_strict(df, df.select("b", "a", "i")).count() == 6
    lines = spark.createDataFrame([('{"id": 1}',), ('{"id": 2',), ("",), ('{"x": 1}',)], "value string")
    assert {r["value"] for r in files.malformed_lines(lines, "id").collect()} == {'{"id": 2', '{"x": 1}'}


def test_stream_goes_on_and_leaves_out_late_events(spark, tmp_path):
    """Two drops give what one batch over both gives; a third has an event that is too late, and one hour again."""
    (tmp_path / "in").mkdir()
    at = dt.datetime.fromisoformat
    schema = "event_id long, ts timestamp, event_type string, value double"

    def drop(name, rows):
        spark.createDataFrame([(i, at(s), "a", v) for i, (s, v) in enumerate(rows)], schema).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/in/events{name}.parquet")

    def run():
        out = hourly_events(spark, f"{tmp_path}/in", "t", "2 days", base=f"file://{tmp_path}/work")
        return {(r["hour"].isoformat(sep=" "), r["n"], r["cents"]) for r in out.collect()}

    drop("1", [("2020-01-01 10:05:00", 1.0), ("2020-01-01 10:55:00", 2.5), ("2020-01-03 00:00:00", 1.0)])
    assert run() == {("2020-01-01 10:00:00", 2, 350), ("2020-01-03 00:00:00", 1, 100)}
    drop("2", [("2020-01-01 10:59:59", 0.5), ("2020-01-09 12:00:00", 1.0)])
    both = {("2020-01-01 10:00:00", 3, 400), ("2020-01-03 00:00:00", 1, 100), ("2020-01-09 12:00:00", 1, 100)}
    assert run() == both and run() == both
    drop("3", [("2020-01-01 11:00:00", 9.0), ("2020-01-09 12:30:00", 1.0)])
    assert run() == both - {("2020-01-09 12:00:00", 1, 100)} | {("2020-01-09 12:00:00", 2, 200)}


def test_labels_of():
    text = '{"a": [{"frames": {"x": {"present": "Yes", "indicators": {"q2": "no", "q1": true}, "kind": "k", "n": 3}, "y": null, "z": {"indicators": []}}}], "b": 1}'
    x, y, z = json_text.labels_of(text)
    assert x == {"frame": "x", "stated": "Yes", "marks": [{"question": "q2", "answer": "no"}, {"question": "q1", "answer": "True"}], "indicators": '{"q2": "no", "q1": true}', "extra": {"kind": "k"}}
    assert y["stated"] is None and y["marks"] == [] and z["indicators"] is None
    assert json_text.labels_of('{"x": 1}') is None and json_text.labels_of(None) is None and json_text.labels_of('{"frames": {}}') == []
