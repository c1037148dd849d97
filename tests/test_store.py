"""Batches that are replayed, break off or meet; partitions that are changed beside others."""

from __future__ import annotations

import os

import pytest

from sparkwright.sources import store

SHAPE = "k long, part string, v string"


def table(spark, path):
    return store.Batches(spark, f"file://{path}", spark.createDataFrame([], SHAPE).schema, ["k", "part"])


def test_replays_add_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0
    first = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (None, "a", "z")], SHAPE)
    assert t.append(first, "b1") == 3
    assert t.append(first, "b1") == 0 and t.append(first, "b2") == 0
    assert t.append(first.union(spark.createDataFrame([(3, "b", "w"), (1, "a", "other")], SHAPE)), "b3") == 1
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted([(1, "a", "x"), (2, "a", "y"), (None, "a", "z"), (3, "b", "w")], key=str)
    with pytest.raises(ValueError):
        t.append(first, "../b")


def test_what_broke_off_does_not_count(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    half = spark.createDataFrame([(9, "a", "half")], SHAPE)
    half.write.parquet(f"file://{tmp_path}/t/rows/batch=b1")  # rows without a mark
    assert t.read().count() == 0
    assert t.append(spark.createDataFrame([(9, "a", "whole"), (8, "a", "w")], SHAPE), "b1") == 2
    assert sorted(r.v for r in t.read().collect()) == ["w", "whole"]


def test_two_writers_lose_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    # both looked at the empty table before either wrote
    for name, value in (("w2", "second"), ("w1", "first")):
        spark.createDataFrame([(1, "a", value), (2 if name == "w1" else 3, "a", value)], SHAPE).write.parquet(f"file://{tmp_path}/t/rows/batch={name}")
        spark.createDataFrame([(name,)], "made string").write.parquet(f"file://{tmp_path}/t/marks/batch={name}")
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "first"), (2, "first"), (3, "second")]


def files(path):
    return {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(k, f"p{k % 3}", f"v{k}") for k in range(9)], SHAPE).write.partitionBy("part").parquet(path)
    before = files(tmp_path)
    changes = spark.createDataFrame([(1, "p1", "new"), (4, "p1", None), (99, "p1", "nobody"), (2, "p1", "elsewhere")], "k long, part string, v string")
    store.change_partitions(spark, path, changes, ["k"], "part")
    got = {r.k: (r.part, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {k: (f"p{k % 3}", f"v{k}") for k in range(9)} | {1: ("p1", "new"), 4: ("p1", None)}
    after = files(tmp_path)
    assert {x: t for x, t in before.items() if "part=p1" not in x} == {x: t for x, t in after.items() if "part=p1" not in x}
    store.change_partitions(spark, path, changes.limit(0), ["k"], "part")
    assert files(tmp_path) == after
