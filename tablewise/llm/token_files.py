"""Token ids of documents in ORC files, in ascending ``doc_id`` order, and reads of them.

ORC keeps the ids with integer run-length encoding in stripes that separate tasks read, with
row indexes and a Bloom filter on ``doc_id``. Each row has its place among its file's ids, so
that any task can tell a document's global start from the sums of the files before.

With ``added_tokens`` an added token of the tokenizer file that stands in a text gets its own id, as the library
does by default; without, it is plain text.

Null and empty texts hold only the end id. A null ``doc_id`` sorts first; rows with equal ids
follow each other. Columns beside ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewise.llm.common import text_buffer, text_slices
from tablewise.llm.pretokens import file_encoder
from tablewise.session import shared_folder

END_ID = 0
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 * 1024 * 1024),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


def _encode_sorted(path: str, end_id: int, added_tokens: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder, part, before = file_encoder(path, added_tokens), TaskContext.get().partitionId(), 0
        for rows in text_slices(batches):
            data, offsets = text_buffer(rows.column(1))
            ids, cuts = encoder.ids(data, offsets)
            ids = np.insert(ids, cuts[1:], end_id)
            cuts = cuts + np.arange(len(cuts))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array(before + cuts[:-1]), pa.array(np.diff(cuts)),
                 pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            before += int(cuts[-1])

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, added_tokens: bool = False) -> None:
    """Encode by the tokenizer file ``path`` and write ORC files in ``folder``."""
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(_encode_sorted(path, end_id, added_tokens), FILE_SCHEMA)
        .write.options(**ORC_OPTIONS).orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files; conditions on ``doc_id`` reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(folder)


def with_start(rows: DataFrame) -> DataFrame:
    """``start``: the ids of all documents before. There is one part for each written file."""
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    base = sizes.select("part", (F.sum("_size").over(W.orderBy("part")) - F.col("_size")).alias("_base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("_base") + F.col("part_start")).drop("_base")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        lists = rows.column(3)
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(), "<u4")).cast("B")
        sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_report(docs: DataFrame, path: str, end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """Write the files in the shared folder, read them back, and say what each document has there."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tablewise/{uuid.uuid4().hex}"
    write_token_files(docs, path, folder, end_id, added_tokens)
    rows = with_start(read_token_files(spark, folder)).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
