"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from sparkwright.llm import decontaminate, near_dedup, queries, repetition, source_mix, storage
from tests.helpers import connect, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    same(queries.queries()[name](spark, data), connect(data), queries.oracle_sql()[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_one_by_one(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, data).write.parquet(path := f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(path)
        assert docs.columns == first.columns
        kept.append(docs.count())
    assert first.count() >= kept[0] >= kept[1] >= kept[2] > 0
    read = lambda i: spark.read.parquet(f"file://{tmp_path}/{i}")
    good = {r.doc_id for r in repetition.measure(first).where("kept").collect()}
    assert {r.doc_id for r in read(0).collect()} == good
    one = {r.doc_id for r in near_dedup.cluster(read(0)).where("kept").collect()}
    assert {r.doc_id for r in read(1).collect()} == one
    bad = {r.doc_id for r in decontaminate.matches(read(1), spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in read(2).collect()} == one - bad
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert len(last) == kept[3] and sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())




def left(spark):
    """The scratch folders that are there."""
    root = storage.shared_root(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sparkwright").getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sparkwright")
    return {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()


def test_run_is_repeatable_and_leaves_its_result(spark, data):
    before = left(spark)
    a, b = (sorted(corpus_pipeline.run(spark, data).collect()) for _ in range(2))
    assert a == b and len(a) > 0
    assert [x.split("-")[1] for x in left(spark) - before] == ["token"] * 2  # each result's own table


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row_key long, row string, times int, copy string, file string, m map<string, int>"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 100 + k, f"r{k}", -1, "c", "f", {"k": k}) for k, (i, t, s) in enumerate(rows)], ODD)


def test_rows_not_ids(spark, data, tmp_path):
    words = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first().text
    rows = [(1, words(1), "a"), (1, words(1), "a"), (2, words(1), "b"), (None, words(2), "a"), (None, words(2), None), (None, words(3) + " " + item, "a"), (5, words(4) + " " + item, "b"), (7, words(5), "a"), (7, words(6), "b"), (8, None, "a"), (9, "", None), (None, None, "b")]
    docs = odd(spark, rows).repartition(3)
    docs.write.parquet(f"file://{tmp_path}/odd")
    for frame in (docs, spark.read.parquet(f"file://{tmp_path}/odd")):
        one = near_dedup.keep_one(frame)
        assert one.schema == frame.schema
        got = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
        assert got == sorted([(1, words(1)), (None, words(2)), *[(i, t) for i, t, _ in rows[5:]]], key=str)
        clean = decontaminate.keep_clean(frame, spark.read.parquet(f"{data}/benchmark.parquet"))
        assert sorted(r._row_key for r in clean.collect()) == [100 + k for k in range(12) if k not in (5, 6)] and clean.schema == frame.schema
        mixed = source_mix.resample(frame, source_mix.Params(weights=(1, 1, 1)))
        assert mixed.schema == frame.schema
        for r in mixed.collect():  # whole rows, with their own values
            k = r._row_key - 100
            assert (r.doc_id, r.text, r.source) == rows[k] and (r.row, r.times, r.copy, r.file, r.m) == (f"r{k}", -1, "c", "f", {"k": k})


def test_stages_chained_without_writes(spark, data):
    docs = whole = spark.read.parquet(f"{data}/documents.parquet")
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        frames.append(docs)
    counts = [x.count() for x in frames]
    other = corpus_pipeline.STAGES[1][1](spark, whole, data)  # another pipeline in between takes nothing from the first
    assert [x.count() for x in frames] == counts and 0 < other.count() < whole.count()
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.STAGES[3][1](spark, frames[2], data).collect()))


def test_empty_table(spark, data):
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, data).collect() == []
