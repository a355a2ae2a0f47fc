"""Token ids in ORC files: documents in ascending id order, run-length coded ids, row indexes and Bloom filters.

Writing deals documents to files by ranges of the id, so files, stripes and rows are in id order and a file's number
is its place. ORC's second integer run-length encoding packs ids, row indexes let a reader skip rows of a stripe by
their least and largest id, and Bloom filters on the id answer point look-ups; stripes are read in parallel.

Rows: null text is written as the end id alone; a null id sorts first; rows with the same id stay apart, in the order
of their text; an empty table gives a table without rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .common import batches

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, partitions: int | None = None, stripe_bytes: int = 16 << 20, index_stride: int = 1000, special_in_text: bool = False) -> None:
    """Encodes every whole text and writes the table; special tokens' names in a text are those tokens, or else plain text."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = byte_bpe.load(tokenizer_path, special_in_text), TaskContext.get().partitionId(), 0
        for keys, texts in batches(rows, "doc_id", "text"):
            for lo in range(0, len(keys), 500):
                raws = encoder.encode_many(texts[lo : lo + 500], end_id)
                counts = np.fromiter((len(r) // 4 for r in raws), dtype=np.int64, count=len(raws))
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raws), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo : lo + 500], pa.int64()), pa.array(np.full(len(raws), part, np.int32)), pa.array(start + ends - counts), pa.array(counts), ids],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table; a filter on doc_id reaches the files' statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def positions(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, all from the files that were read.

    Starts are a file's own running counts plus the total of the files before it: one row for each file is broadcast.
    """

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column(3)
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[lo:hi].tobytes()) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = sums.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = tokens.select("doc_id", "part", "local_start", "ids").mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
