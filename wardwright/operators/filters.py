"""Filters, searches and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwright.functions.scalars import col, extension, like_any_case
from wardwright.schemas import IMAGE_EXTENSIONS, OCCUPYING_STATUSES, UPLOAD_EXTENSIONS


def occupying(status: Column | str = "status") -> Column:
    """Does an appointment with this status hold its slot?"""
    return col(status).isin(*OCCUPYING_STATUSES)


def in_hours(slot: Column | str, start: Column | str, end: Column | str) -> Column:
    """start <= slot < end; zero-padded times compare as text."""
    return (col(slot) >= col(start)) & (col(slot) < col(end))


def equal_where_given(rows: DataFrame, **wanted) -> DataFrame:
    """Equality on every non-empty parameter; '', 0 and None mean no predicate."""
    for name, value in wanted.items():
        if value not in ("", 0, None):
            rows = rows.filter(F.col(name) == value)
    return rows


def latest_order() -> list[Column]:
    """Date and slot descending. The id makes the order total and splits busy slots over sort tasks."""
    return [F.desc("appointment_date"), F.desc("time_slot"), F.desc("appointment_id")]


def latest_first(details: DataFrame) -> DataFrame:
    return details.orderBy(*latest_order())


def appointment_list(details: DataFrame, status: str = "", date: str = "") -> DataFrame:
    return latest_first(equal_where_given(details, status=status, appointment_date=date))


def pending_queue(details: DataFrame) -> DataFrame:
    """Scheduled appointments, oldest first."""
    return (details.filter(F.col("status") == "Scheduled")
                   .orderBy("appointment_date", "time_slot", "appointment_id"))


def search_patients(patients: DataFrame, term: str = "") -> DataFrame:
    """Any-case contains on name, phone or insurance id; wildcards pass through; newest first."""
    if term:
        patients = patients.filter(like_any_case("name", term) | like_any_case("phone", term)
                                   | like_any_case("insurance_id", term))
    return patients.orderBy(F.desc("patient_id"))


def search_patients_literal(patients: DataFrame, term: str) -> DataFrame:
    """As-you-type filter: no wildcards, phone compared as typed (lower-cased)."""
    needle = term.lower()
    return patients.filter(F.lower("name").contains(needle) | F.col("phone").contains(needle)
                           | F.lower(F.coalesce("insurance_id", F.lit(""))).contains(needle))


def doctor_list(doctor_dept: DataFrame, dept: int = 0) -> DataFrame:
    return equal_where_given(doctor_dept, dept_id=dept).orderBy("doctor_id")


def availability_between(availability: DataFrame, doctor_id: int, first: str, last: str) -> DataFrame:
    """One doctor's entries in an inclusive date range."""
    mine = (F.col("doctor_id") == doctor_id) & F.col("avail_date").between(first, last)
    return availability.filter(mine).orderBy("avail_date")


def departments_with_revenue(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("revenue") > 0).select("dept_name", "revenue")


def allowed_upload(file_name: Column | str) -> Column:
    return F.coalesce(extension(file_name).isin(*UPLOAD_EXTENSIONS), F.lit(False))


def is_image(file_type: Column | str) -> Column:
    return F.coalesce(col(file_type).isin(*IMAGE_EXTENSIONS), F.lit(False))
