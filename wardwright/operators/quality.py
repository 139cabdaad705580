"""Constraint audits: rows that break a rule, as (rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwright.operators.scheduling import slot_conflicts
from wardwright.schemas import FOREIGN_KEYS, KEYS, REQUIRED, UNIQUE

Tables = dict[str, DataFrame]


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _violation(rows: DataFrame, rule, key) -> DataFrame:
    return rows.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), key.cast("string").alias("key"))


def nulls_in(table: DataFrame, name: str, key: str, required: tuple[str, ...]) -> DataFrame:
    """One row per NULL in a required column; a single pass over the table."""
    flags = [F.when(F.col(c).isNull(), F.lit(f"{name}.{c}")) for c in required]
    return _violation(table.withColumn("_rule", F.explode(F.array_compact(F.array(*flags)))), F.col("_rule"),
                      F.col(key))


def not_null(t: Tables) -> DataFrame:
    return _union(nulls_in(t[name], name, KEYS[name], columns) for name, columns in REQUIRED.items() if name in t)


def duplicates(t: Tables) -> DataFrame:
    """Key values that occur more than once; NULLs are distinct."""
    parts = []
    for rule, name, columns in UNIQUE:
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        groups = t[name].filter(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(_violation(groups, rule, F.concat_ws(",", *[F.col(c).cast("string") for c in columns])))
    return _union(parts)


def orphans(t: Tables) -> DataFrame:
    """Rows whose reference is set but leads nowhere.

    Each child is read once and gives a row (rule, key, parent, ref) per reference. One join per parent
    takes out the references it satisfies; what is left after the last leads nowhere. All of them work on (parent, ref), so the
    references are shuffled at most once. The joins are outer ones of which the rows without a match are kept: an anti
    join would be moved below the union and would read each parent once per child.
    """
    parts = []
    for child in dict.fromkeys(c for c, _, _ in FOREIGN_KEYS):
        given = [F.struct(F.lit(f"{child}.{column}").alias("rule"), F.lit(parent).alias("parent"), F.col(column).cast("long").alias("ref"))
                 for c, column, parent in FOREIGN_KEYS if c == child]
        parts.append(t[child].select(F.col(KEYS[child]).cast("long").alias("key"), F.explode(F.array(*given)).alias("x"))
                     .select("key", "x.*").filter("ref IS NOT NULL"))
    lost = _union(parts)
    for parent in dict.fromkeys(p for _, _, p in FOREIGN_KEYS):
        known = t[parent].select(F.lit(parent).alias("parent"), F.col(KEYS[parent]).cast("long").alias("ref"), F.lit(True).alias("_known"))
        lost = lost.join(known, ["parent", "ref"], "left").filter("_known IS NULL").drop("_known")
    return _violation(lost, F.col("rule"), F.col("key"))


def double_bookings(appointments: DataFrame) -> DataFrame:
    """Slots held by more than one occupying appointment."""
    clashes = slot_conflicts(appointments).filter("n > 1")
    return _violation(clashes, "appointments.slot",
                      F.concat_ws("|", F.col("doctor_id").cast("string"), "appointment_date", "time_slot"))


def bed_consistency(beds: DataFrame) -> DataFrame:
    """Occupied exactly when a patient is present."""
    occupied, held = F.coalesce(F.col("status") == "Occupied", F.lit(False)), F.col("patient_id").isNotNull()
    rule = F.when(occupied, "beds.occupied_without_patient").otherwise("beds.patient_without_occupancy")
    return _violation(beds.filter(occupied != held), rule, F.col("bed_id"))


def bill_arithmetic(bills: DataFrame) -> DataFrame:
    """total = sum of charges; payable = total - coverage. One row per broken rule."""
    charges = F.col("bed_charges") + F.col("consultation_fees") + F.col("medicine_charges") + F.col("test_charges")
    rules = F.array_compact(F.array(
        F.when(F.col("total_amount") != charges, "bills.total"),
        F.when(F.col("patient_payable") != F.col("total_amount") - F.col("insurance_coverage"), "bills.payable")))
    return _violation(bills.withColumn("_rule", F.explode(rules)), F.col("_rule"), F.col("bill_id"))
