"""A store rewrites the buckets that a batch touches, and a failed batch changes nothing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.operators import graph
from tablewise.operators.store import BucketStore

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "relationship")]).add("properties", graph.PROPERTIES)
KEYS = ["source", "target", "relationship"]


def edges(spark, ids, note):
    rows = [(f"s{i}", f"t{i % 7}", "R", {"note": note, "n": str(i)}) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return sorted((r.source, r.target, r.relationship, tuple(sorted(r.properties.items()))) for r in df.collect())


def test_batches_equal_upsert(spark, tmp_path):
    store = BucketStore.create(spark, str(tmp_path / "s"), SCHEMA, KEYS, buckets=16)
    assert told(store.rows()) == []
    first = edges(spark, range(300), "a")
    assert store.upsert(first) == 16
    before = store.manifest()[1]
    # Repeated keys within a batch, a new record, and rows without a key.
    batch = edges(spark, [5, 5, 900], "b").union(edges(spark, [5], "c")).union(
        spark.createDataFrame([("", "t", "R", {}), (None, "t", "R", {})], SCHEMA))
    assert 1 <= store.upsert(batch) <= 2
    version, after = store.manifest()
    assert version == 2 and 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert told(store.rows()) == told(graph.upsert_edges(first, batch))
    assert told(store.find("s5", "t5", "R")) == [("s5", "t5", "R", (("n", "5"), ("note", "c")))]
    assert store.find("s5", "t6", "R").count() == 0 and store.upsert(batch.limit(0)) == 0
    # Another reader sees the same.
    assert told(BucketStore(spark, str(tmp_path / "s"), SCHEMA, KEYS).rows()) == told(store.rows())


def test_interrupted_write(spark, tmp_path, monkeypatch):
    store = BucketStore.create(spark, str(tmp_path / "s"), SCHEMA, KEYS, buckets=4)
    store.upsert(edges(spark, range(20), "a"))
    old = told(store.rows())

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_write_manifest", fails)
        with pytest.raises(OSError):
            store.upsert(edges(spark, range(30), "b"))
    assert told(store.rows()) == old and store.manifest()[0] == 1
    # A batch that fails while its rows are computed writes no manifest either.
    broken = edges(spark, range(30), "b").withColumn("source", F.when(F.col("source") == "s29", F.raise_error(F.lit("bad row"))).otherwise(F.col("source")))
    with pytest.raises(Exception, match="bad row"):
        store.upsert(broken)
    assert told(store.rows()) == old
    store.upsert(edges(spark, range(10, 30), "c"))
    assert len(told(store.rows())) == 30


def test_two_writers_are_noticed(spark, tmp_path):
    store = BucketStore.create(spark, str(tmp_path / "s"), SCHEMA, KEYS, buckets=2)
    version, copies = store.manifest()
    store._write_manifest(version + 1, copies)
    store._write_manifest(version + 1, copies)
    with pytest.raises(RuntimeError, match="two writers"):
        store.rows()
    with pytest.raises(ValueError):
        BucketStore(spark, "x", T.StructType().add("store_copy", "int"), ["store_copy"])
