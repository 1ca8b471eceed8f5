"""Bucketed document store: merges, replays, lost writers."""

from pathlib import Path

import pytest

from netquarry.operators.scoring import upsert_documents
from netquarry.sources.store import DocumentStore


def docs(spark, rows):
    return spark.createDataFrame(rows, "cluster_id int, name string, score double")


def rows_of(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def data_files(store):
    return set(Path(store.path).glob("data/**/*.parquet"))


def test_two_merges_and_a_replay_equal_the_join(spark):
    first = docs(spark, [(i, f"n{i}", i / 2) for i in range(40)])
    second = spark.createDataFrame([(3, "new", ["a"]), (77, "late", [])], "cluster_id int, name string, tags array<string>")
    store = DocumentStore(spark, buckets=8)
    assert store.upsert(1, first)
    before = data_files(store)
    named = {r[0] for r in store.read().selectExpr("input_file_name()").distinct().collect()}
    assert store.upsert(2, second)
    columns = ["cluster_id", "name", "score", "tags"]
    want = rows_of(upsert_documents(first, second), columns)
    assert rows_of(store.read(), columns) == want
    assert before <= data_files(store)  # nothing is rewritten in place
    after = {r[0] for r in store.read().selectExpr("input_file_name()").distinct().collect()}
    assert len(named - after) <= 2 and len(named & after) >= 6  # only touched buckets moved
    assert not store.upsert(2, second) and not store.upsert(1, first)
    assert rows_of(DocumentStore(spark, store.path).read(), columns) == want


def test_a_writer_lost_before_its_manifest_changes_nothing(spark, monkeypatch):
    store = DocumentStore(spark, buckets=4)
    store.upsert(1, docs(spark, [(1, "a", 1.0), (2, "b", 2.0)]))
    with monkeypatch.context() as lost:
        def gone(*_):
            raise OSError("lost")
        lost.setattr("netquarry.sources.store.write_once", gone)
        with pytest.raises(OSError):
            store.upsert(2, docs(spark, [(1, "changed", 9.0)]))
    columns = ["cluster_id", "name", "score"]
    assert rows_of(store.read(), columns) == [(1, "a", 1.0), (2, "b", 2.0)]
    Path(store.path, "manifests", "000000000001.json").write_text('{"batch": 2, "fold')  # cut off while written
    assert rows_of(store.read(), columns) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert store.upsert(2, docs(spark, [(1, "changed", 9.0)]))
    assert rows_of(store.read(), columns) == [(1, "changed", 9.0), (2, "b", 2.0)]
    assert len(store.vacuum_candidates()) >= 1


def test_lookup_reads_only_its_bucket(spark):
    store = DocumentStore(spark, buckets=16)
    store.upsert(1, docs(spark, [(i, "x", 0.0) for i in range(200)]))
    found = store.lookup(17)
    assert [r["cluster_id"] for r in found.collect()] == [17]
    assert len(found.inputFiles()) < len(store.read().inputFiles()) / 4


def test_odd_batches(spark):
    store = DocumentStore(spark, buckets=4)
    with pytest.raises(ValueError):
        store.read()
    assert store.upsert(1, docs(spark, []))
    assert store.read().count() == 0
    for bad in ([(1, "a", 1.0), (1, "b", 1.0)], [(None, "a", 1.0)]):
        with pytest.raises(ValueError):
            store.upsert(2, docs(spark, bad))
    with pytest.raises(ValueError):
        store.upsert(2, spark.createDataFrame([(1, 5)], "cluster_id int, name int"))
    assert store.upsert(2, docs(spark, [(1, None, None)]))
    assert rows_of(store.read(), ["cluster_id", "name", "score"]) == [(1, None, None)]
