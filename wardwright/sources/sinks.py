"""Sinks: JSON records, date-partitioned Parquet and batch appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.session import settle


def json_records(rows: DataFrame) -> DataFrame:
    """One JSON document per row, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_lines(rows: DataFrame, path: str, column: str, partition: str) -> None:
    """A text column as lines of plain files, in a folder per value of `partition`."""
    rows.select(column, partition).write.mode("errorifexists").partitionBy(partition).text(path)


def write_by_date(rows: DataFrame, path: str, date_column: str, key: str, mode: str = "errorifexists") -> None:
    """Partition by date. The range shuffle on (date, key) lets a busy day fill several files
    and keeps quiet days together in one task."""
    rows.repartitionByRange(date_column, key).write.mode(mode).partitionBy(date_column).parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Batch insert: new rows become new files; existing files are not rewritten."""
    rows.write.mode("append").parquet(path)


def with_new_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Table plus inserted rows; columns the rows lack are NULL."""
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]),
                             allowMissingColumns=True)


# --- access paths other than the date ------------------------------------------

def write_bucketed(rows: DataFrame, table: str, key: str, path: str, buckets: int, sort: tuple[str, ...] = (),
                   partition: str | None = None, spread: str | None = None, files_per_bucket: int = 1) -> DataFrame:
    """A catalogue table whose files are cut by a hash of `key`, and the table read back.

    A lookup by the key reads one bucket, and tables with equally many buckets join on the key without a shuffle.
    `partition` adds folders per value, for a column of few values such as a status. Rows are dealt by bucket before
    writing; with `spread`, a unique column, and several files per bucket, the bucket of a hot key is written by several tasks.
    """
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    if files_per_bucket > 1:
        rows = rows.repartition(buckets * files_per_bucket, bucket, F.pmod(F.xxhash64(spread), F.lit(files_per_bucket)))
    else:
        rows = rows.repartition(buckets, F.col(key))
    writer = rows.write.mode("errorifexists").bucketBy(buckets, key).sortBy(*(sort or (key,))).option("path", path)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
    return rows.sparkSession.table(table)


# --- keyed updates of a partitioned table -----------------------------------------

def rewrite_partitions(spark: SparkSession, path: str, schema: str, partition: str, key: str, ids: DataFrame,
                       update: Callable[[DataFrame], DataFrame]) -> list:
    """Update a table in place, partition by partition: only the partitions that hold one of `ids` are read whole and written
    anew; the files of all others stay. Returns the partitions written.

    `update` maps the rows of the partitions to their new state; it must keep the partition column and leave no partition empty. A scan of the key and
    partition columns finds the partitions. Their values come to the driver, which lists the folders of them all anyway. The new
    rows are settled before the first old file goes, so a lost job can be run again from there.
    """
    stored = spark.read.schema(schema).parquet(path)
    touched = [r[0] for r in stored.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi").select(partition).distinct().collect()]
    if touched:
        held = F.col(partition).isin([v for v in touched if v is not None])
        if None in touched:
            held = held | F.col(partition).isNull()
        rows = settle(update(stored.filter(held)), "rewritten-partitions")
        (rows.repartitionByRange(partition, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition).parquet(path))
    return touched
