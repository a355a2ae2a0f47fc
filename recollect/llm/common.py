"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpoint, shared_dir  # noqa: F401

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more.

    The cleaner learns of them when the driver's garbage is collected, which may be long after a step has ended; asked
    for between the steps of an operator, it keeps disks from holding all steps' files at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(modulus: int, remainder: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    crc = F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return (crc % modulus) == remainder


def batches(rows: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """The named columns of each batch as Python lists."""
    for b in rows:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
