"""A key with a third of all rows is split by the adaptive skew join, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from wardwright.operators import audit, booking
from wardwright.operators.changes import exists_flag

ROWS = 600_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
}


def hot():
    return F.col("id") % 3 == 0


@pytest.fixture()
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def consume(df):
    """Number of rows and number of split joins, with every column kept alive."""
    kept = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns) % 7).alias("h"))
    n = kept.collect()[0].n
    final = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return n, final.count("skew=true")


def test_reference_check_on_a_hot_patient(spark, small_partitions):
    requests = spark.range(ROWS).select("id", F.when(hot(), 7).otherwise(F.col("id")).cast("long").alias("patient_id"),
                                        F.rand(1).alias("load"))
    patients = spark.range(0, ROWS, 2).select(F.col("id").alias("patient_id"))
    flagged = exists_flag(requests, "patient_id", patients, "patient_id", "known")
    n, split = consume(flagged)
    assert n == ROWS and split == 1
    # The hot patient 7 is odd, hence unknown.
    assert flagged.filter("known").count() == ROWS // 3


def test_refusals_on_a_hot_slot(spark, small_partitions):
    slot = [F.when(hot(), 1).otherwise(F.col("id") % 500).cast("long").alias("doctor_id"),
            F.when(hot(), F.lit("2024-05-01")).otherwise(F.concat(F.lit("2024-06-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
             .alias("appointment_date"), F.lit("09:00").alias("time_slot")]
    requests = spark.range(ROWS).select(F.col("id").alias("request_seq"), *slot)
    held = spark.range(ROWS).select(F.col("id").alias("appointment_id"), *slot, F.lit("Completed").alias("status")).filter(hot())
    checked = requests.select("*", F.lit(True).alias("present"), F.rand(2).cast("string").alias("absence"),
                              F.lit(True).alias("complete"), F.lit(True).alias("valid"))
    state = booking._slot_state(checked, booking._held_slots(requests, held))
    n, split = consume(booking._refusals(checked, state))
    winners = booking._winners(state).count()
    assert winners == state.count() - 1 and n == ROWS - winners and split >= 1


def test_audit_chain_of_a_hot_appointment(spark, small_partitions):
    changes = spark.range(ROWS).select(
        F.col("id").alias("request_seq"), F.when(hot(), 0).otherwise(F.col("id")).cast("long").alias("appointment_id"),
        F.col("id").cast("string").alias("status"))
    stored = spark.range(ROWS).select(F.col("id").alias("appointment_id"), F.lit("first").alias("status"))
    trail = audit.status_audit(stored, changes, "2024-01-01 00:00:00")
    n, split = consume(trail)
    assert n == ROWS and split >= 1
    wrong = trail.filter((F.col("record_id") == 0) & (F.col("request_seq") > 0)
                         & (F.col("old_value").cast("long") != F.col("request_seq") - 3))
    assert wrong.count() == 0
