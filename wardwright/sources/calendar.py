"""Inline sources: the slot grid and the days ahead. The start day is always a parameter."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwright.functions.scalars import day_label
from wardwright.schemas import HORIZON_DAYS, SLOT_GRID


def days_ahead(as_of: str, days: int = HORIZON_DAYS) -> list[str]:
    """ISO dates from `as_of` on, for plans that need one column per day."""
    start = date.fromisoformat(as_of)
    return [(start + timedelta(days=i)).isoformat() for i in range(days)]


def slot_grid() -> Column:
    return F.array(*[F.lit(slot) for slot in SLOT_GRID])


def with_days(rows: DataFrame, as_of: str, days: int = HORIZON_DAYS) -> DataFrame:
    """One row per input row and day ahead: date and label. A generator, so no join."""
    start = F.lit(as_of).cast("date")
    ahead = rows.withColumn("_day", F.explode(F.sequence(start, F.date_add(start, days - 1))))
    return (ahead.withColumn("date", F.date_format("_day", "yyyy-MM-dd"))
                 .withColumn("label", day_label("_day")).drop("_day"))


def with_slots(rows: DataFrame) -> DataFrame:
    """One row per input row and slot of the grid."""
    return rows.withColumn("time_slot", F.explode(slot_grid()))
