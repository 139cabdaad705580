"""The four stored views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.operators.filters import latest_order
from wardwright.operators.loads import department_load

Tables = dict[str, DataFrame]
DETAIL_COLUMNS = ("appointment_id", "patient_name", "patient_phone", "doctor_name", "dept_name", "appointment_date",
                  "time_slot", "status", "fees", "symptoms", "diagnosis", "duration_minutes")


def doctor_dept(t: Tables) -> DataFrame:
    """v_doctor_dept, with the department id and phone that its readers filter on and show."""
    d, dp = t["doctors"], t["departments"]
    return d.join(dp, "dept_id").select(
        d.doctor_id, d.name, d.specialization, d.status, "dept_id", dp.dept_name, dp.location, d.phone, d.salary)


def appointment_details(t: Tables) -> DataFrame:
    """v_appointment_details: the appointment star."""
    a, p, d, dp = t["appointments"], t["patients"], t["doctors"], t["departments"]
    # The dimension arm first: it stays small, and the wide table joins it once per key.
    staff = d.join(dp, "dept_id").select(d.doctor_id, d.name.alias("doctor_name"), dp.dept_name)
    people = p.select(p.patient_id, p.name.alias("patient_name"), p.phone.alias("patient_phone"))
    return a.join(staff, "doctor_id").join(people, "patient_id").select(*DETAIL_COLUMNS)


def leading_appointments(t: Tables, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of the appointment view in `order` (columns of the appointments), fetched late.

    Semi joins leave the appointments that are in the view, by keys and order columns alone; the first k of them are found as each
    task's own first k. Only then are these k rows looked up by their ids, in scans that the ids prune: names in the
    people's tables, the wide columns in a second scan of the appointments. As k rows at most go back to it, they are
    broadcast whatever the limits, and no wide column is ever shuffled. The k ids come to the driver, so a job runs at the call.
    """
    staff = t["doctors"].join(t["departments"], "dept_id", "left_semi").select("doctor_id")
    leaders = (t["appointments"].join(staff, "doctor_id", "left_semi")
               .join(t["patients"].select("patient_id"), "patient_id", "left_semi")
               .orderBy(*order).limit(k).select("appointment_id", "doctor_id", "patient_id"))
    found = leaders.collect()
    rows = leaders.sparkSession.createDataFrame(found, leaders.schema)

    def fetch(name: str, key: str, keys: str) -> DataFrame:
        return t[name].filter(F.col(key).isin(sorted({r[keys] for r in found})))

    staff = fetch("doctors", "doctor_id", "doctor_id").join(t["departments"], "dept_id").select(
        "doctor_id", F.col("name").alias("doctor_name"), "dept_name")
    people = fetch("patients", "patient_id", "patient_id").select(
        "patient_id", F.col("name").alias("patient_name"), F.col("phone").alias("patient_phone"))
    names = rows.join(staff, "doctor_id").join(people, "patient_id").drop("doctor_id", "patient_id")
    wide = fetch("appointments", "appointment_id", "appointment_id").join(F.broadcast(names), "appointment_id")
    return wide.orderBy(*order).limit(k).select(*DETAIL_COLUMNS)


def recent_appointments(t: Tables, k: int = 8) -> DataFrame:
    return leading_appointments(t, latest_order(), k)


def appointment_sample(t: Tables, k: int = 5) -> DataFrame:
    """A k-row sample of the view, defined by the lowest ids."""
    return leading_appointments(t, [F.col("appointment_id")], k)


def bed_occupancy(t: Tables) -> DataFrame:
    """v_bed_occupancy: every bed, with its patient's name if it has one."""
    b, p = t["beds"], t["patients"]
    people = p.select(p.patient_id, p.name.alias("patient_name"))
    return b.join(people, "patient_id", "left").select(
        "bed_id", "ward_name", "bed_number", "bed_type", "status", "hourly_rate", "patient_name", "admitted_date")


def dept_stats(t: Tables, load: DataFrame | None = None) -> DataFrame:
    """v_dept_stats: doctors, appointments, revenue and mean wait per department, empty departments kept.

    Appointments are folded to one row per doctor before they meet the
    dimensions, so the distinct counts of the tree doctors -> appointments
    become plain sums and no join sees a fan-out.
    """
    return department_load(t, load).select(
        "dept_id", "dept_name", "location", "doctor_count", "total_appointments", "revenue",
        F.round(F.col("wait_sum") / F.col("completed"), 1).alias("avg_wait"))


VIEWS = {
    "v_doctor_dept": doctor_dept,
    "v_appointment_details": appointment_details,
    "v_bed_occupancy": bed_occupancy,
    "v_dept_stats": dept_stats,
}


def register_views(spark: SparkSession, t: Tables) -> None:
    """Make tables and views available to `spark.sql`. A view is re-evaluated by each query."""
    for name, table in t.items():
        table.createOrReplaceTempView(name)
    for name, build in VIEWS.items():
        build(t).createOrReplaceTempView(name)
