"""Stored versions of a table: rows in a folder per block of ids, and beside them a digest of each block."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "id_block"
BLOCK_BITS = 14  # ids of a block, as a power of two; choose it so that a block fills a file


@dataclass(frozen=True)
class Version:
    rows: DataFrame
    digests: DataFrame


def write_version(rows: DataFrame, path: str, key: str, digest: Callable[[DataFrame, str], DataFrame], bits: int = BLOCK_BITS) -> Version:
    """Store `rows` by block of `key` and `digest(rows, block column)` of what was stored; returns the stored version."""
    blocked = rows.withColumn(BLOCK, F.shiftright(key, bits))
    blocked.repartitionByRange(BLOCK, key).write.mode("errorifexists").partitionBy(BLOCK).parquet(os.path.join(path, "rows"))
    spark = rows.sparkSession
    stored = spark.read.schema(blocked.schema).parquet(os.path.join(path, "rows"))
    digests = digest(stored, BLOCK)
    digests.write.mode("errorifexists").parquet(os.path.join(path, "digests"))
    return read_version(spark, path, blocked.schema, digests.schema)


def read_version(spark: SparkSession, path: str, rows_schema, digests_schema) -> Version:
    return Version(spark.read.schema(rows_schema).parquet(os.path.join(path, "rows")),
                   spark.read.schema(digests_schema).parquet(os.path.join(path, "digests")))
