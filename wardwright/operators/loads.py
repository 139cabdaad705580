"""Appointment counts and sums per doctor and department, the base of most reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwright.functions.scalars import money

Tables = dict[str, DataFrame]


def status_load(appointments: DataFrame) -> DataFrame:
    """Counts and sums per doctor and status: a handful of rows per doctor from which every
    dashboard figure about appointments follows."""
    wait = F.col("wait_time_minutes").cast("long")
    return appointments.groupBy("doctor_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fees").alias("fees"), F.sum(wait).alias("wait_sum"),
        F.count(wait).alias("waits"))


def doctor_load(appointments: DataFrame) -> DataFrame:
    """One row per doctor with appointments. Partial aggregation runs before the shuffle,
    so a doctor with a third of all rows costs one row per map task."""
    done = F.col("status") == "Completed"
    wait = F.col("wait_time_minutes").cast("long")
    return appointments.groupBy("doctor_id").agg(
        F.count(F.lit(1)).alias("appointments"),
        F.count_if(done).alias("completed_rows"),
        F.count_if(F.col("status") == "Cancelled").alias("cancelled"),
        F.sum(F.when(done, F.col("fees"))).alias("revenue"),
        F.sum(F.when(done, wait)).alias("wait_sum"),
        F.count(F.when(done, wait)).alias("waits"))


def fold_statuses(load: DataFrame) -> DataFrame:
    """`status_load` brought to the shape of `doctor_load`."""
    done = F.col("status") == "Completed"
    return load.groupBy("doctor_id").agg(
        F.sum("n").alias("appointments"),
        F.sum(F.when(done, F.col("n")).otherwise(0)).alias("completed_rows"),
        F.sum(F.when(F.col("status") == "Cancelled", F.col("n")).otherwise(0)).alias("cancelled"),
        *[F.sum(F.when(done, F.col(c))).alias(out) for c, out in (
            ("fees", "revenue"), ("wait_sum", "wait_sum"), ("waits", "waits"))])


def department_load(t: Tables, load: DataFrame | None = None) -> DataFrame:
    """One row per department, with zeros where it has no doctors or appointments.
    `load` is a doctor load made before; by default it is made from the appointments."""
    load = doctor_load(t["appointments"]) if load is None else load
    per_doctor = t["doctors"].select("doctor_id", "dept_id").join(load, "doctor_id", "left")
    per_dept = per_doctor.groupBy("dept_id").agg(
        F.count(F.lit(1)).alias("doctor_count"),
        F.sum("appointments").alias("total_appointments"),
        F.sum("cancelled").alias("cancellations"),
        F.sum("revenue").alias("revenue"),
        F.sum("wait_sum").alias("wait_sum"), F.sum("waits").alias("completed"))
    return t["departments"].join(per_dept, "dept_id", "left").select(
        "dept_id", "dept_name", "location",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("doctor_count", "total_appointments", "cancellations")],
        F.coalesce(money("revenue"), money(F.lit(0))).alias("revenue"), "wait_sum",
        F.nullif("completed", F.lit(0)).alias("completed"))
