"""From documents to token ids: toxicity, near-duplicates, benchmark leaks, secrets, encoding."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from wardwright.llm.common import prepare, table
from wardwright.session import scratch_path, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut. The model learns from these documents and their labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.withColumn("_text", F.col("text")), model, text="_text")
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id, null ids last.

    Rows are known to the operator by a hash of id and text, so a row goes only if its own text has a near copy that stays, whatever
    other rows have its id. Rows that repeat id and text are one document, of which one row stays: the first by its other columns.
    """
    mark = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keyed = docs.withColumn("_mark", mark)
    classes = settle(simhash.near_duplicates(keyed, shingle=3, radius=2, doc_id="_mark"), "near-duplicate-classes")
    members = classes.select(F.col("doc_id").alias("_mark"), "component_id").join(keyed.select("_mark", "doc_id"), "_mark")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_mark"))["_mark"].alias("_best"))
    best = settle(best, "best-of-groups")
    losers = settle(classes.join(best, "component_id").where(F.col("doc_id") != F.col("_best")).select(F.col("doc_id").alias("_mark")).distinct(), "near-copies")
    repeated = settle(classes.groupBy(F.col("doc_id").alias("_mark")).count().where("count > 1").select("_mark"), "repeated-rows")
    kept = keyed.join(losers, "_mark", "left_anti")
    order = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])
    again = kept.join(repeated, "_mark", "left_semi").groupBy("_mark").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return kept.join(repeated, "_mark", "left_anti").select(*docs.columns).unionByName(again.select("_row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, and with them packed runs too large to look into."""
    return secret_scan.redact(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to the text again; of the other columns, id, language and source."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode_texts),
]

#: Models, iterations and decoders have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet in the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
