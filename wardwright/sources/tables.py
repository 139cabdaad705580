"""Canonical tables at rest: one Parquet folder per table, read with its declared schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from wardwright.schemas import KEYS, TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(os.path.join(root, name))


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in TABLES}


def full_scan(table: DataFrame, name: str, newest_first: bool = False) -> DataFrame:
    """Every row in key order."""
    key = table[KEYS[name]]
    return table.orderBy(key.desc() if newest_first else key.asc())


def upload_manifest(uploads: DataFrame) -> DataFrame:
    """Newest upload first; the id breaks ties and lets the range sort split a busy instant."""
    return uploads.orderBy(uploads.uploaded_at.desc(), uploads.upload_id.desc())


def files_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The same listing over real files; file contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return (files.select("path", "length", "modificationTime")
                 .orderBy(files.modificationTime.desc(), files.path.desc()))
