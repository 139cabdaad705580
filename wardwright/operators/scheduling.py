"""Open slots, availability checks and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwright.functions.scalars import day_label, matrix_cell
from wardwright.operators.changes import only_wanted
from wardwright.operators.filters import equal_where_given, in_hours, occupying
from wardwright.operators.loads import doctor_load
from wardwright.schemas import DAY_END, DAY_START, DEFAULT_NOTE, DEFAULT_WAIT, HORIZON_DAYS, SLOT_GRID
from wardwright.session import settle
from wardwright.sources.calendar import days_ahead, slot_grid

Tables = dict[str, DataFrame]
SLOT_KEY = ["doctor_id", "appointment_date", "time_slot"]


def occupied_slots(appointments: DataFrame) -> DataFrame:
    """Distinct taken (doctor, date, slot); duplicates collapse before the shuffle."""
    return appointments.filter(occupying()).select(*SLOT_KEY).distinct()


def slot_conflicts(appointments: DataFrame) -> DataFrame:
    """Number of occupying appointments per (doctor, date, slot)."""
    return appointments.filter(occupying()).groupBy(*SLOT_KEY).agg(F.count(F.lit(1)).alias("n"))


def availability_by_day(availability: DataFrame) -> DataFrame:
    """One entry per (doctor, date) under the names the joins use."""
    return availability.select("doctor_id", F.col("avail_date").alias("appointment_date"), "start_time", "end_time",
                               "is_available")


def check_availability(requests: DataFrame, availability: DataFrame) -> DataFrame:
    """Add `availability_verdict`: open, leave or outside hours. No entry means open."""
    days = availability_by_day(availability)
    verdict = (F.when(F.col("is_available").isNull(), "open")
                .when(~F.col("is_available"), "leave")
                .when(~in_hours("time_slot", "start_time", "end_time"), "outside hours")
                .otherwise("open"))
    return (requests.join(days, ["doctor_id", "appointment_date"], "left")
                    .withColumn("availability_verdict", verdict))


def open_slots(doctor_days: DataFrame, appointments: DataFrame, availability: DataFrame) -> DataFrame:
    """Free grid slots for each (doctor_id, appointment_date) asked for.

    Only appointments of the days asked for are read on. Their slots are folded to
    one set per doctor and day (at most the twelve grid slots) and subtracted from
    the grid in place; only the answer is expanded to slots.
    """
    day = ["doctor_id", "appointment_date"]
    taken = only_wanted(appointments.filter(occupying() & F.col("time_slot").isin(*SLOT_GRID))
                        .groupBy(*day).agg(F.collect_set("time_slot").alias("taken")), day, doctor_days)
    asked = doctor_days.select(*day).join(availability_by_day(availability), day, "left").join(taken, day, "left")
    at_work = F.coalesce("is_available", F.lit(True))
    free = F.array_except(slot_grid(), F.coalesce("taken", F.array().cast("array<string>")))
    start, end = F.coalesce("start_time", F.lit("")), F.col("end_time")
    within = F.filter(free, lambda s: (s >= start) & (end.isNull() | (s < end)))
    return asked.filter(at_work).select(*day, F.explode(within).alias("time_slot"))


def predicted_wait(doctors: DataFrame, appointments: DataFrame) -> DataFrame:
    """Rounded mean wait of a doctor's completed appointments, 15 without history."""
    load = doctor_load(appointments).select("doctor_id", "wait_sum", "waits")
    mean = F.round(F.col("wait_sum") / F.nullif("waits", F.lit(0)))
    return doctors.select("doctor_id").join(load, "doctor_id", "left").select(
        "doctor_id", F.coalesce(mean, F.lit(DEFAULT_WAIT)).cast("int").alias("predicted_wait"))


def patient_by_phone(patients: DataFrame) -> DataFrame:
    """Phones are not unique: the lowest id answers for a phone."""
    return patients.filter(F.col("phone").isNotNull()).groupBy("phone").agg(
        F.min("patient_id").alias("patient_id"))


def known_phones(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """The requests' phones that are on file, with `known_patient_id`; a settled table."""
    called = only_wanted(patient_by_phone(patients), ["phone"], requests)
    return settle(called.withColumnRenamed("patient_id", "known_patient_id"), "known-phones")


def resolve_patients(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """Add `known_patient_id`, NULL for phones not on file."""
    return requests.join(known_phones(requests, patients), "phone", "left")


def _entry_per_day(availability: DataFrame, days: list[str]) -> DataFrame:
    """One row per doctor, one struct column per day: a pivot with fixed columns."""
    entry = F.struct("is_available", "start_time", "end_time", "notes")
    wanted = availability.filter(F.col("avail_date").isin(*days))
    return wanted.groupBy("doctor_id").agg(*[
        F.min_by(entry, F.when(F.col("avail_date") == day, F.col("avail_id"))).alias(day) for day in days])


def availability_calendar(t: Tables, as_of: str, dept: int = 0, days: int = HORIZON_DAYS) -> DataFrame:
    """Active doctors with a nested list of the next days, default hours where there is no entry.

    The list has exactly `days` elements, filled from a per-doctor pivot; neither a
    cross join with the calendar nor a collected group is needed.
    """
    dates = days_ahead(as_of, days)

    def element(day: str) -> Column:
        given = F.col(f"`{day}`")
        default = F.struct(F.lit(True).alias("is_available"), F.lit(DAY_START).alias("start_time"),
                           F.lit(DAY_END).alias("end_time"), F.lit(DEFAULT_NOTE).alias("notes"))
        chosen = F.coalesce(given.withField("notes", F.coalesce(given["notes"], F.lit(""))), default)
        return F.struct(F.lit(day).alias("date"), day_label(F.lit(day)).alias("label"),
                        *[chosen[f].alias(f) for f in ("is_available", "start_time", "end_time", "notes")])

    active = equal_where_given(t["doctors"].filter(F.col("status") == "Active"), dept_id=dept)
    staff = active.join(t["departments"], "dept_id").select(
        "doctor_id", "name", "specialization", "dept_id", "dept_name")
    return (staff.join(_entry_per_day(t["doctor_availability"], dates), "doctor_id", "left")
            .select(*staff.columns, F.array(*[element(d) for d in dates]).alias("availability"))
            .orderBy("dept_name", "name", "doctor_id"))


def working_days(calendar: DataFrame) -> DataFrame:
    """The calendar without days on leave."""
    return calendar.withColumn("availability", F.filter("availability", lambda a: a["is_available"]))


def availability_matrix(t: Tables, as_of: str, days: int = HORIZON_DAYS) -> DataFrame:
    """Doctor by day matrix; a cell says Leave, the hours, or Default."""
    dates = days_ahead(as_of, days)
    cells = [matrix_cell(*[F.col(f"`{d}`.{f}") for f in ("is_available", "start_time", "end_time")])
             .alias("d_" + d.replace("-", "_")) for d in dates]
    return (t["doctors"].join(t["departments"], "dept_id")
            .select("doctor_id", "name", "dept_name")
            .join(_entry_per_day(t["doctor_availability"], dates), "doctor_id", "left")
            .select("doctor_id", "name", "dept_name", *cells).orderBy("doctor_id"))
