"""Row-change events as a stream: each event becomes the audit row its table's rule asks for.

Events carry the row before and after the change, so the job keeps no state and
needs no watermark. The file sink commits each micro-batch once, and the query
restarts from its checkpoint after a failure.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardwright.functions.ordering import positions
from wardwright.operators.audit import BED_ASSIGNED, DELETE, STATUS_CHANGE, bed_label, patient_label
from wardwright.session import scratch_path, settle

EVENT_SCHEMA = (
    "event_seq BIGINT, table_name STRING, op STRING, record_id BIGINT, changed_columns ARRAY<STRING>, "
    "event_time TIMESTAMP_NTZ, "
    "before STRUCT<status: STRING, name: STRING, patient_id: BIGINT>, "
    "after STRUCT<status: STRING, name: STRING, patient_id: BIGINT>")


def audit_from_events(events: DataFrame) -> DataFrame:
    """Works on a stream and on a batch alike. Events no rule is interested in yield nothing."""
    status_set = (F.col("op") == "UPDATE") & F.array_contains("changed_columns", "status")
    on_appointment = (F.col("table_name") == "appointments") & status_set
    on_patient = (F.col("table_name") == "patients") & (F.col("op") == "DELETE")
    on_bed = ((F.col("table_name") == "beds") & status_set & (F.col("after.status") == "Occupied")
              & (F.col("before.status") != "Occupied"))
    action = F.when(on_appointment, STATUS_CHANGE).when(on_patient, DELETE).when(on_bed, BED_ASSIGNED)
    old = F.when(on_patient, patient_label(F.col("before.name"), "record_id")).otherwise(F.col("before.status"))
    new = F.when(on_appointment, F.col("after.status")).when(on_bed, bed_label(F.col("after.patient_id")))
    return events.withColumn("action", action).filter("action IS NOT NULL").select(
        "event_seq", "table_name", "record_id", "action", old.alias("old_value"), new.alias("new_value"),
        F.col("event_time").alias("timestamp"), F.lit("System").alias("performed_by"))


def read_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_audit_stream(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                       files_per_batch: int | None = None) -> StreamingQuery:
    """Process all events present, append their audit rows to `sink`, and stop."""
    rows = audit_from_events(read_events(spark, source, files_per_batch))
    return (rows.writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", checkpoint or scratch_path(spark, "audit-stream"))
            .trigger(availableNow=True).start())


# --- the numbered log ----------------------------------------------------------

AUDITED_TABLES = ("appointments", "beds", "patients")
NUMBERED_SCHEMA = ("log_id BIGINT, table_name STRING, record_id BIGINT, action STRING, old_value STRING, new_value STRING, "
                   "timestamp TIMESTAMP_NTZ, performed_by STRING, event_seq BIGINT")


def append_numbered(rows: DataFrame, batch_id: int, log: str) -> None:
    """Give a micro-batch's audit rows the next ids and write them to the batch's folder.

    Ids go on behind the high-water mark that the batches before left in `log`. Rows and mark are written by batch id, so a
    batch that runs again writes the same ids over its own. Rows are in the order of `event_seq`, unique within a table,
    then of the table's name.
    """
    spark = rows.sparkSession
    place = F.array_position(F.array(*map(F.lit, AUDITED_TABLES)), F.col("table_name")) - 1
    rows = settle(rows.withColumn("_order", F.col("event_seq") * len(AUDITED_TABLES) + place), "audit-batch")
    marks = spark.read.schema("last_id BIGINT, batch BIGINT").parquet(os.path.join(log, "marks"))
    mark = marks.filter(F.col("batch") < batch_id).agg(F.max("last_id")).first()[0]
    numbered = rows.join(positions(rows.select("_order"), "_order", "_place"), "_order").withColumn("log_id", F.lit(mark) + F.col("_place"))
    numbered.select(*[part.split()[0] for part in NUMBERED_SCHEMA.split(", ")]).write.mode("overwrite").parquet(os.path.join(log, "rows", f"batch={batch_id}"))
    _write_mark(spark, mark + rows.count(), batch_id, log)


def _write_mark(spark: SparkSession, last_id: int, batch_id: int, log: str) -> None:
    spark.range(1).select(F.lit(last_id).cast("long").alias("last_id")).write.mode("overwrite").parquet(os.path.join(log, "marks", f"batch={batch_id}"))


def read_numbered(spark: SparkSession, log: str) -> DataFrame:
    """The rows of all batches that left a mark; a batch that failed half-way does not show."""
    rows = spark.read.schema(NUMBERED_SCHEMA + ", batch BIGINT").parquet(os.path.join(log, "rows"))
    marks = spark.read.schema("last_id BIGINT, batch BIGINT").parquet(os.path.join(log, "marks"))
    return rows.join(marks.select("batch"), "batch", "left_semi")


def start_numbered_log(spark: SparkSession, source: str, log: str, checkpoint: str, high_water: int,
                       files_per_batch: int | None = None) -> StreamingQuery:
    """Process all events present, append their audit rows with gapless ids after `high_water` to `log`, and stop.
    A later start with the same checkpoint goes on where this one ended; `high_water` counts for a new log only."""
    spark.range(1).select(F.lit(high_water).cast("long").alias("last_id")).write.mode("ignore").parquet(os.path.join(log, "marks", "batch=-1"))
    rows = audit_from_events(read_events(spark, source, files_per_batch))
    return (rows.writeStream.foreachBatch(lambda batch, batch_id: append_numbered(batch, batch_id, log))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- events from change sets -------------------------------------------------

def _events(audit: DataFrame, before, after, table: str, op: str, columns: tuple[str, ...] = ("status",)) -> DataFrame:
    nothing = F.lit(None)
    def image(status=None, name=None, patient=None):
        return F.struct((status if status is not None else nothing.cast("string")).alias("status"),
                        (name if name is not None else nothing.cast("string")).alias("name"),
                        (patient if patient is not None else nothing.cast("bigint")).alias("patient_id"))
    return audit.select(
        F.col("request_seq").alias("event_seq"), F.lit(table).alias("table_name"), F.lit(op).alias("op"), "record_id",
        (F.array(*map(F.lit, columns)) if op == "UPDATE" else F.array().cast("array<string>")).alias("changed_columns"),
        F.col("timestamp").alias("event_time"), image(**before).alias("before"), image(**after).alias("after"))


def status_events(status_audit: DataFrame) -> DataFrame:
    """Change events of a status batch."""
    return _events(status_audit, {"status": F.col("old_value")}, {"status": F.col("new_value")}, "appointments",
                   "UPDATE")


def update_events(rows: DataFrame, table: str, key: str, columns: list[str], as_of: str) -> DataFrame:
    """Change events of updates that set `columns` and leave status, name and patient as `rows` have them."""
    image = {part: F.col(c) for part, c in (("status", "status"), ("name", "name"), ("patient", "patient_id"))
             if c in rows.columns}
    events = rows.select("*", F.col(key).alias("request_seq"), F.col(key).alias("record_id"),
                         F.lit(as_of).cast("timestamp_ntz").alias("timestamp"))
    return _events(events, image, image, table, "UPDATE", tuple(columns))


def delete_events(gone: DataFrame, as_of: str) -> DataFrame:
    """Change events of deleted patients (request_seq, patient_id, name)."""
    rows = gone.select("request_seq", F.col("patient_id").alias("record_id"), "name",
                       F.lit(as_of).cast("timestamp_ntz").alias("timestamp"))
    return _events(rows, {"name": F.col("name"), "patient": F.col("record_id")}, {}, "patients", "DELETE")


def bed_events(assigned: DataFrame, as_of: str) -> DataFrame:
    """Change events of assigned beds (request_seq, bed_id, patient_id)."""
    rows = assigned.select("request_seq", F.col("bed_id").alias("record_id"), "patient_id",
                           F.lit(as_of).cast("timestamp_ntz").alias("timestamp"))
    return _events(rows, {"status": F.lit("Available")}, {"status": F.lit("Occupied"), "patient": F.col("patient_id")},
                   "beds", "UPDATE")
