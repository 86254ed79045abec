import json
import os

import pytest
from pyspark.sql import functions as F

from joinlens.operators import compaction as K

GOOD = {"name": "n", "template_name": "t", "sql": "select 1", "subset_graph": "{}"}


def table(spark, payloads):
    return spark.createDataFrame([(i, p, "clash", None) for i, p in enumerate(payloads)], "file_id long, payload string, __id string, sql string")


def run(spark, df, **more):
    return K.compact(df, "file_id", "payload", ["sql", "subset_graph"], ["name", "template_name"], F.col("template_name"), **more)


def test_what_is_a_record(spark):
    good = json.dumps(GOOD)
    bad = [None, "", "  ", good[:-1], good + " x", good + good, good + "," + good, "[" + good + "]", "null", '"x"', "{'a': 1}", good[:-1] + ",}", good.replace("select", "sel\tect"), good + "]", good[:40]]
    odd = [good, " \n\t" + good + "\r\n", json.dumps(GOOD, indent=4), json.dumps(dict(reversed(GOOD.items()))), json.dumps(GOOD | {"sql": "other"}), "{}", '{"sql": null}', json.dumps(GOOD | {"sql": "é日 \""}), json.dumps(GOOD | {"sql": ""})]
    found = run(spark, table(spark, bad + odd))
    n = len(bad)
    assert {tuple(r) for r in found.copies.collect()} == {(n, n + 1), (n, n + 2), (n, n + 3), (n + 5, n + 6)}
    assert {r.file_id: r.sql for r in found.records.collect()} == {n: "select 1", n + 4: "other", n + 5: None, n + 7: "é日 \"", n + 8: ""}
    assert found.report["records"] == 5 and found.report["copies"] == 4


def test_files_are_ranges_and_hold_everything(spark, tmp_path):
    hot = [json.dumps(GOOD | {"sql": f"select {i} " + "x" * 200}) for i in range(600)]
    copies = [json.dumps(GOOD)] * 500  # a third of the rows are one record
    rest = [json.dumps(GOOD | {"template_name": f"t{i % 7}", "sql": f"choose {i}"}) for i in range(400)]
    target = f"file://{tmp_path}/out"
    found = run(spark, table(spark, hot + copies + rest), target_bytes=20_000, target=target)
    assert found.records.count() == 1001 and found.copies.count() == 499
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]
    assert len(files) == found.report["files"] >= 5
    spans = spark.read.parquet(target).select(F.concat_ws("\x01", "template_name", F.hex("__id")).alias("k"), F.col("_metadata.file_name").alias("f"))
    ranges = sorted(tuple(r) for r in spans.groupBy("f").agg(F.min("k").alias("a"), F.max("k").alias("b")).select("a", "b").collect())
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    again = run(spark, table(spark, rest), target=target)  # takes the old folder's place
    assert again.records.count() == 400 and not os.path.exists(tmp_path / "out.old") and not os.path.exists(tmp_path / "out.staging")


def test_empty(spark):
    found = run(spark, table(spark, [None]))
    assert found.records.count() == found.copies.count() == 0


def test_what_the_built_in_parser_refuses(spark):
    twice = '{"sql": "a", "name": "x", "sql": "b", "subset_graph": "{}"}'
    bad = [twice[:-1], twice + "x}", '{"sql": "a", "sql": NaN}', twice + "}", '[' + twice + "]", '{"sql": "a", "sql": "b\tc"}']
    found = run(spark, table(spark, [twice, *bad, json.dumps({"sql": "b", "subset_graph": "{}", "big": "z" * (17 << 20)})]))
    assert {r.file_id: (r.sql, r.name) for r in found.records.collect()} == {0: ("b", "x")}
    assert {tuple(r) for r in found.copies.collect()} == {(0, 7)}
    assert (found.report["input"], found.report["records"], found.report["copies"], found.report["rejected"]) == (8, 1, 1, 6)


def test_strict_reader():
    assert K._read('{"a": 1, "b": {"c": [1.50, "x"]}, "d": null}', ["a", "b", "d", "e"]) == ["1", '{"c": ["1.50", "x"]}', None, None]
    assert K._read("[1]", ["a"]) is None and K._read('{"a": Infinity}', ["a"]) is None and K._read('{"a": 1} {', ["a"]) is None
    with pytest.raises(RecursionError):
        K._read('{"a":' * 100_000 + "1" + "}" * 100_000, ["a"])


@pytest.mark.parametrize("lost", ["compact-ids", "compact-copies"])
def test_lost_records_are_noticed(spark, tmp_path, monkeypatch, lost):
    target = f"file://{tmp_path}/keep"
    run(spark, table(spark, [json.dumps(GOOD)]), target=target)
    real = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, label: real(df.limit(0) if label == lost else df, label))
    with pytest.raises(RuntimeError, match="came in"):
        run(spark, table(spark, [json.dumps(GOOD | {"sql": "b"})] * 2), target=target)
    assert spark.read.parquet(target).first().sql == "select 1"


def test_changed_fields_are_noticed(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/keep"
    run(spark, table(spark, [json.dumps(GOOD)]), target=target)
    real = K.with_range
    monkeypatch.setattr(K, "with_range", lambda rows, *more: real(rows.withColumn("name", F.lit("changed")), *more))
    with pytest.raises(RuntimeError, match="left as it is"):
        run(spark, table(spark, [json.dumps(GOOD | {"sql": "b"})]), target=target)
    assert spark.read.parquet(target).first().sql == "select 1" and not os.path.exists(tmp_path / "keep.staging")


def test_swap_puts_an_only_copy_back(spark, tmp_path):
    for name, text in (("t.old", "old"), ("new", "new")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(text)
    with pytest.raises(RuntimeError):
        K.swap_directory(spark, f"file://{tmp_path}/missing", f"file://{tmp_path}/t")
    assert (tmp_path / "t" / "f").read_text() == "old"
    K.swap_directory(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/t")
    assert (tmp_path / "t" / "f").read_text() == "new" and not (tmp_path / "t.old").exists()


def test_ranges(spark):
    keys = [f"k{i:02}" for i in range(0, 40, 3)]
    df = spark.createDataFrame([(f"k{i:02}",) for i in range(45)] + [("",), ("z",)], "k string")
    for some in ([], keys[:1], keys[:2], keys):
        cuts = spark.createDataFrame(list(enumerate(some)), "no long, cut string")
        for most in (1, 2, 5, 100):
            for r in K.with_range(df, "k", cuts, len(some), "i", most).collect():
                assert r.i == sum(c <= r.k for c in some)


def test_boundaries_have_no_cap(spark):
    rows = spark.createDataFrame([(f"{i:05}", 10) for i in range(3000)], "k string, s long")
    assert [tuple(r) for r in K.boundaries(rows, "k", "s", 3).orderBy("no").collect()] == [(0, "00999"), (1, "01999")]
    assert K.boundaries(rows, "k", "s", 2500).count() >= 2400
    assert K.boundaries(rows.limit(0), "k", "s", 5).count() == 0
