"""A keyed table that batches are merged into, bucket by bucket, without rewriting the rest.

A record lies in the bucket that the hash of its key names. A batch is merged with the buckets that its keys fall in; these
are written anew beside the old ones, and a manifest then says which copy of each bucket counts. A manifest is one
file, so that it is there or is not: a batch that fails leaves the last state as it was.

One writer at a time; two that end with the same version are told apart when the table is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewise.operators.joins import latest_per_key
from tablewise.session import reliable_checkpoint

MANIFEST = "version bigint, writer string, bucket int, copy string"
#: Partition folders of the data; columns of a stored table have other names.
COPY, BUCKET = "store_copy", "store_bucket"


class BucketStore:
    """Records of ``schema``, one for each value of ``keys``, under ``path`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> None:
        if {COPY, BUCKET} & {name.lower() for name in schema.names}:
            raise ValueError(f"{COPY} and {BUCKET} are names of the store")
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 256) -> BucketStore:
        """An empty store; choose ``buckets`` so that one is a few hundred MB at most."""
        store = cls(spark, path, schema, keys)
        store._write_manifest(0, dict.fromkeys(range(buckets)))
        return store

    def _write_manifest(self, version: int, copies: dict[int, str | None]) -> None:
        writer = uuid.uuid4().hex
        rows = [(version, writer, bucket, copy) for bucket, copy in sorted(copies.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def manifest(self) -> tuple[int, dict[int, str | None]]:
        """The last version and the copy of each bucket that counts; one row for each bucket comes to the driver."""
        written = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        version = written.agg(F.max("version")).first()[0]
        rows = written.where(F.col("version") == version).collect()
        if len({r.writer for r in rows}) > 1:
            raise RuntimeError(f"two writers made version {version} of {self.path}")
        return version, {r.bucket: r.copy for r in rows}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(buckets)).cast("int")

    def _read(self, copies: dict[int, str | None]) -> DataFrame:
        paths = [f"{self.path}/data/{COPY}={copy}/{BUCKET}={bucket}" for bucket, copy in copies.items() if copy]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*[f"`{c}`" for c in self.schema.names])

    def rows(self) -> DataFrame:
        """All records of the last version."""
        return self._read(self.manifest()[1])

    def find(self, *key) -> DataFrame:
        """The record of one key, read from its bucket alone."""
        copies = self.manifest()[1]
        typed = self.spark.createDataFrame([key], StructType([self.schema[k] for k in self.keys]))
        bucket = typed.select(self._bucket(len(copies))).first()[0]
        found = self._read({bucket: copies[bucket]})
        for name, value in zip(self.keys, key):
            found = found.where(F.col(f"`{name}`") == F.lit(value))
        return found

    def upsert(self, batch: DataFrame) -> int:
        """Insert or replace by key and return the number of buckets that were rewritten.

        Rows with a null or empty key are ignored; of a batch's rows with one key the one whose other fields, as JSON, are greatest stays.
        """
        version, copies = self.manifest()
        for key in self.keys:
            batch = batch.where(F.col(f"`{key}`").isNotNull() & (F.col(f"`{key}`").cast("string") != ""))
        # Read for its buckets and for its rows.
        batch = reliable_checkpoint(batch.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]))
        touched = [r[0] for r in batch.select(self._bucket(len(copies)).alias("b")).distinct().collect()]
        if not touched:
            return 0
        old = self._read({bucket: copies[bucket] for bucket in touched})
        both = old.withColumn(COPY, F.lit(0)).unionByName(batch.withColumn(COPY, F.lit(1))).withColumn(BUCKET, self._bucket(len(copies)))
        rest = F.to_json(F.struct(*[f"`{c}`" for c in self.schema.names if c not in self.keys]))
        # One shuffle by bucket serves the merge and the files.
        merged = latest_per_key(both.repartition(BUCKET), [BUCKET, *self.keys], [F.col(COPY), rest]).drop(COPY)
        copy = uuid.uuid4().hex
        merged.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{COPY}={copy}")
        self._write_manifest(version + 1, copies | dict.fromkeys(touched, copy))
        return len(touched)
