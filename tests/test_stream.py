import os

from conftest import rows_of

from wardwright.operators import audit
from wardwright.session import scratch_path
from wardwright.sources.sinks import append_rows
from wardwright.streaming import audit_stream

STAMP = "2024-04-15 08:00:00"


def feed(make, spark):
    appointments = make("appointments", [{"appointment_id": i, "status": "Scheduled"} for i in range(4)])
    changes = make("status_changes", [{"request_seq": s, "appointment_id": s % 3, "status": st}
                                      for s, st in enumerate(["Confirmed", "Scheduled", "Completed", "Cancelled", "Cancelled"])])
    status = audit.status_audit(appointments, changes, STAMP)
    gone = spark.createDataFrame([(10, 1, "Ann"), (11, 2, None)], "request_seq BIGINT, patient_id BIGINT, name STRING")
    assigned = make("bed_assignments", [{"request_seq": 20, "bed_id": 1, "patient_id": 7}, {"request_seq": 21, "bed_id": 2}])
    events = [audit_stream.status_events(status), audit_stream.delete_events(gone, STAMP),
              audit_stream.bed_events(assigned, STAMP)]
    from pyspark.sql import functions as F
    batch = status.unionByName(audit.delete_audit(gone, STAMP)).unionByName(
        audit.bed_audit(assigned.withColumn("old_status", F.lit("Available")), STAMP))
    return events, batch


COLUMNS = ("seq", "table_name", "record_id", "action", "old_value", "new_value", "timestamp", "performed_by")


def test_stream_equals_batch_and_resumes(spark, make):
    events, batch = feed(make, spark)
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    os.makedirs(source)
    append_rows(events[0], source)
    for late in events[1:]:
        audit_stream.start_audit_stream(spark, source, sink, checkpoint, files_per_batch=1).awaitTermination()
        append_rows(late, source)
    for _ in range(2):  # the second run finds nothing new
        audit_stream.start_audit_stream(spark, source, sink, checkpoint, files_per_batch=1).awaitTermination()
    got = rows_of(spark.read.parquet(sink).withColumnRenamed("event_seq", "seq"), *COLUMNS)
    assert got == rows_of(batch.withColumnRenamed("request_seq", "seq"), *COLUMNS) and len(got) == 9


def test_events_without_a_rule_are_dropped(spark):
    def event(table, op, changed, before, after):
        return (1, table, op, 5, changed, None, before, after)
    rows = spark.createDataFrame([
        event("appointments", "UPDATE", ["fees"], ("A", None, None), ("A", None, None)),
        event("appointments", "UPDATE", ["status"], ("A", None, None), ("A", None, None)),
        event("beds", "UPDATE", ["status"], ("Occupied", None, 1), ("Occupied", None, 2)),
        event("beds", "UPDATE", ["status"], (None, None, None), ("Occupied", None, 2)),
        event("beds", "UPDATE", ["status"], ("Occupied", None, 1), ("Available", None, None)),
        event("patients", "UPDATE", ["status"], ("A", "n", None), ("B", "n", None)),
        event("doctors", "DELETE", [], ("A", "n", None), None)], audit_stream.EVENT_SCHEMA)
    # An update that sets the status to the same value still counts.
    assert rows_of(audit_stream.audit_from_events(rows), "table_name", "old_value", "new_value") == [("appointments", "A", "A")]


def test_numbered_log_is_gapless_over_batches_and_replays(spark, make):
    events, batch = feed(make, spark)
    source, log, checkpoint = (scratch_path(spark, n) for n in ("in", "log", "check"))
    for late in events:
        append_rows(late, source)
        audit_stream.start_numbered_log(spark, source, log, checkpoint, 100, files_per_batch=1).awaitTermination()
    audit_stream.start_numbered_log(spark, source, log, checkpoint, 500).awaitTermination()  # nothing new; the mark counts
    found = audit_stream.read_numbered(spark, log)
    rows = rows_of(found.withColumnRenamed("event_seq", "seq"), *COLUMNS)
    assert rows == rows_of(batch.withColumnRenamed("request_seq", "seq"), *COLUMNS)
    ids = sorted((r.batch, r.log_id, r.event_seq) for r in found.collect())
    assert [n for _, n, _ in ids] == list(range(101, 110)) and len({b for b, _, _ in ids}) > 1
    # A batch that runs again, as after a failure behind its rows, writes the same ids.
    last = max(b for b, _, _ in ids)
    again = found.filter(found.batch == last).drop("batch", "log_id")
    again = spark.createDataFrame(again.collect(), again.schema)
    audit_stream.append_numbered(again, last, log)
    assert sorted((r.batch, r.log_id, r.event_seq) for r in audit_stream.read_numbered(spark, log).collect()) == ids
    audit_stream.append_numbered(again, last + 1, log)
    assert audit_stream.read_numbered(spark, log).agg({"log_id": "max"}).first()[0] == 109 + again.count()
    # Rows without a mark belong to a batch that did not finish.
    again.selectExpr("1000 AS log_id", "*").write.parquet(os.path.join(log, "rows", "batch=99"))
    assert audit_stream.read_numbered(spark, log).filter("batch = 99").isEmpty()
