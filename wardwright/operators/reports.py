"""Joined, grouped, ranked and subquery reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardwright.functions.scalars import money, occupancy_percent
from wardwright.operators.loads import department_load, doctor_load
from wardwright.session import settle

Tables = dict[str, DataFrame]


# --- joins -------------------------------------------------------------------

def top_completed(t: Tables, k: int = 5) -> DataFrame:
    """Doctors with the most completed appointments; ids break ties."""
    load = doctor_load(t["appointments"]).filter("completed_rows > 0")
    return (load.join(t["doctors"], "doctor_id").join(t["departments"], "dept_id")
                .select("doctor_id", F.col("name").alias("doctor"), "dept_name",
                        F.col("completed_rows").alias("completed_appts"))
                .orderBy(F.desc("completed_appts"), "doctor_id").limit(k))


def appointments_per_doctor(t: Tables) -> DataFrame:
    """Every doctor with the number of appointments, zero included, by name."""
    return (t["doctors"].join(t["departments"], "dept_id", "left")
            .join(doctor_load(t["appointments"]), "doctor_id", "left")
            .select("doctor_id", F.col("name").alias("doctor"), "dept_name",
                    F.coalesce("appointments", F.lit(0)).alias("total_appts"))
            .orderBy("doctor", "doctor_id"))


def availability_roster(t: Tables) -> DataFrame:
    """All availability entries with doctor and department, by date and name."""
    staff = t["doctors"].join(t["departments"], "dept_id").select(
        "doctor_id", F.col("name").alias("doctor_name"), "specialization", "dept_name")
    return (t["doctor_availability"].join(staff, "doctor_id")
            .select(*t["doctor_availability"].columns, "doctor_name", "specialization", "dept_name")
            .orderBy("avail_date", "doctor_name", "avail_id"))


def bill_list(t: Tables) -> DataFrame:
    """Bills with patient name and insurer, newest id first."""
    people = t["patients"].select("patient_id", F.col("name").alias("patient_name"), "insurance_provider")
    return (t["bills"].join(people, "patient_id")
            .select(*t["bills"].columns, "patient_name", "insurance_provider")
            .orderBy(F.desc("bill_id")))


def patients_with_bills(t: Tables) -> DataFrame:
    """Patients with at least one bill, by name. Bills collapse to distinct patients before the shuffle."""
    billed = t["bills"].select("patient_id").distinct()
    return (t["patients"].join(billed, "patient_id", "left_semi")
            .select("patient_id", "name", "phone").orderBy("name", "patient_id"))


# --- aggregates --------------------------------------------------------------

def row_count(table: DataFrame, name: str = "cnt") -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias(name))


def filtered_count(table: DataFrame, status: str, name: str = "cnt") -> DataFrame:
    return table.agg(F.count_if(F.col("status") == status).alias(name))


def total_revenue(bills: DataFrame) -> DataFrame:
    """Sum over all bills, pending ones included; 0 when there are none."""
    return bills.agg(F.round(F.coalesce(F.sum("total_amount"), money(F.lit(0))), 2).alias("total_revenue"))


def appointments_by_status(appointments: DataFrame) -> DataFrame:
    return appointments.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


def beds_by_type(beds: DataFrame) -> DataFrame:
    """Beds per type, spread over the statuses."""
    return beds.groupBy("bed_type").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Available", "Occupied", "Maintenance")])


def mean_wait_by_department(t: Tables, load: DataFrame | None = None) -> DataFrame:
    """Mean wait of completed appointments, longest first."""
    load = doctor_load(t["appointments"]) if load is None else load
    load = load.filter("completed_rows > 0").select("doctor_id", "wait_sum", "waits")
    per_dept = (load.join(t["doctors"].select("doctor_id", "dept_id"), "doctor_id")
                    .groupBy("dept_id").agg(F.sum("wait_sum").alias("wait_sum"), F.sum("waits").alias("waits")))
    return (per_dept.join(t["departments"], "dept_id")
            .groupBy("dept_name").agg(F.sum("wait_sum").alias("wait_sum"), F.sum("waits").alias("waits"))
            .select("dept_name",
                    F.round(F.col("wait_sum") / F.nullif("waits", F.lit(0)), 1).alias("avg_wait"))
            .orderBy(F.desc("avg_wait"), "dept_name"))


def department_report(t: Tables) -> DataFrame:
    """Departments that have appointments, by revenue."""
    return (department_load(t).filter("total_appointments > 0")
            .select("dept_name", F.col("doctor_count").alias("doctors"),
                    F.col("total_appointments").alias("appointments"), "revenue",
                    F.round(F.col("wait_sum") / F.col("completed"), 1).alias("avg_wait"), "cancellations")
            .orderBy(F.desc("revenue"), "dept_name"))


def exact_mean(total, rows):
    """Mean of a decimal sum, kept to ten digits so that rounding it again is harmless."""
    return (total / rows).cast("decimal(28,10)")


def mean_salary(doctors: DataFrame) -> DataFrame:
    return doctors.agg(exact_mean(F.sum("salary"), F.count("salary")).alias("avg_salary"))


def appointment_count_mean(appointments: DataFrame) -> DataFrame:
    """Mean number of appointments over the doctors that have any."""
    return doctor_load(appointments).agg(
        (F.sum("appointments") / F.count(F.lit(1))).alias("mean_count"))


def billing_kpis(bills: DataFrame) -> DataFrame:
    paid = F.col("status") == "Paid"

    def total(amount, name):
        return F.coalesce(F.sum(amount), money(F.lit(0))).alias(name)

    return bills.agg(total(F.col("total_amount"), "total_billed"), total(F.col("insurance_coverage"), "total_insurance"),
                     total(F.when(paid, F.col("patient_payable")), "collected"),
                     F.count_if(F.col("status") == "Pending").alias("pending_bills"))


def bed_kpis(beds: DataFrame) -> DataFrame:
    counted = beds.agg(F.count(F.lit(1)).alias("total"),
                       *[F.count_if(F.col("status") == s).alias(s.lower())
                         for s in ("Available", "Occupied", "Maintenance")])
    return counted.withColumn("occupancy_pct", occupancy_percent("occupied", "total"))


def ward_summary(beds: DataFrame) -> DataFrame:
    """One row per ward: the type of its first bed and the number of beds. Settled, so that the beds of a hot
    ward can be split where they join it."""
    return settle(beds.groupBy("ward_name").agg(F.min_by("bed_type", "bed_number").alias("ward_type"),
                                                F.count(F.lit(1)).alias("bed_count")), "ward-summary")


def ward_beds(occupancy: DataFrame, beds: DataFrame) -> DataFrame:
    """Beds under their ward, with the ward's type, in ward and bed order."""
    wards = ward_summary(beds).select("ward_name", "ward_type")
    return (occupancy.join(wards, "ward_name")
            .select("ward_name", "ward_type", "bed_number", "bed_id", "status", "patient_name")
            .orderBy("ward_name", "bed_number"))


def placed_in_ward(occupancy: DataFrame) -> DataFrame:
    """Add `place`, the bed's number in its ward by bed number, from 0, and of the ward the type of its first bed and the
    number of its beds as `ward_type` and `bed_count`.

    The beds are sorted by range into parts, which cut a large ward, and numbered within their part; the beds
    of a ward in earlier parts are added from the counts per ward and part, which also tell the ward's type and count.
    """
    order = ["ward_name", "bed_number", "bed_id"]
    parted = settle(occupancy.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ward-parts")
    counts = parted.groupBy("ward_name", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min_by("bed_type", "bed_number").alias("_type"))
    whole = Window.partitionBy("ward_name").orderBy("_part")
    earlier, all_parts = (whole.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.unboundedFollowing))
    offsets = settle(counts.select("ward_name", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                                   F.first("_type").over(all_parts).alias("ward_type"), F.sum("_n").over(all_parts).alias("bed_count")), "ward-offsets")
    inside = F.row_number().over(Window.partitionBy("ward_name", "_part").orderBy("bed_number", "bed_id"))
    return (parted.withColumn("_row", inside).join(offsets, ["ward_name", "_part"])
            .withColumn("place", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before"))


def ward_rollup(occupancy: DataFrame, beds_per_row: int = 1024) -> DataFrame:
    """Ward -> type and ordered list of beds.

    The list is by bed number. It is cut by place into rows of `beds_per_row`, so a row is bounded however large
    the ward, and a ward with no more beds than that is one row; `list_place` orders the rows of a ward.
    """
    bed = F.struct("place", "bed_number", "bed_id", "status", "patient_name")
    return (placed_in_ward(occupancy).groupBy("ward_name", "ward_type", "bed_count", F.floor(F.col("place") / beds_per_row).alias("list_place"))
            .agg(F.array_sort(F.collect_list(bed)).alias("beds")).orderBy("ward_name", "list_place"))


# --- top-k and samples -------------------------------------------------------

def first_rows(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """A k-row sample, defined by the lowest keys."""
    return rows.orderBy(key).limit(k)


def scheduled_sample(appointments: DataFrame, k: int = 5) -> DataFrame:
    scheduled = appointments.filter(F.col("status") == "Scheduled")
    return first_rows(scheduled.select("appointment_id", "doctor_id", "appointment_date", "time_slot", "status"),
                      "appointment_id", k)


def audit_history(audit_log: DataFrame) -> DataFrame:
    return audit_log.orderBy(F.desc("timestamp"), F.desc("log_id"))


# --- subqueries --------------------------------------------------------------

def salary_against_mean(doctors: DataFrame, k: int = 5) -> DataFrame:
    """The k best paid with the overall mean and their distance from it."""
    mean = mean_salary(doctors).scalar()
    return (doctors.orderBy(F.desc("salary"), "doctor_id").limit(k)
            .select("doctor_id", "name", "salary", F.round(mean, 2).alias("avg_salary"),
                    F.round(F.col("salary") - mean, 2).alias("diff_from_avg")))


def above_mean_salary(doctors: DataFrame) -> DataFrame:
    return (doctors.filter(F.col("salary") > mean_salary(doctors).scalar())
            .select("doctor_id", "name", "specialization", "salary")
            .orderBy(F.desc("salary"), "doctor_id"))


def above_mean_load(t: Tables) -> DataFrame:
    """Doctors with more appointments than the mean over doctors that have any."""
    load = doctor_load(t["appointments"]).select("doctor_id", F.col("appointments").alias("appt_count"))
    busy = load.filter(F.col("appt_count") > appointment_count_mean(t["appointments"]).scalar())
    return (busy.join(t["doctors"], "doctor_id").join(t["departments"], "dept_id")
            .select("doctor_id", "name", "dept_name", "appt_count"))
