"""Tables by name from a folder of Parquet files, and the chunk store as a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "content_hash string, raw string, summary string, ts bigint, hits bigint, last_used bigint, wall_ts bigint"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store; an empty one where the path does not exist. Columns that older stores lack are null."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)
    return spark.createDataFrame([], STORE).unionByName(found, allowMissingColumns=True)


def write_store(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def clock(store: DataFrame) -> DataFrame:
    return store.agg(F.max(F.greatest("ts", "last_used")).alias("clock"))
