"""Audit rows for row changes, from change sets or from two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwright.functions.ordering import previous_in_key
from wardwright.functions.scalars import stamp
from wardwright.operators.changes import SEQ, audit_rows
from wardwright.sources.versions import BLOCK, Version

# Audit texts.
STATUS_CHANGE, DELETE, BED_ASSIGNED = "STATUS_CHANGE", "DELETE", "BED_ASSIGNED"
CREATED, USER_BOOKED = "CREATED", "USER_BOOKED"


def patient_label(name: Column | str, patient_id: Column | str) -> Column:
    """`name (ID:n)`; NULL without a name."""
    return F.concat(name, F.lit(" (ID:"), F.col(patient_id).cast("string"), F.lit(")"))


def bed_label(patient_id: Column | str) -> Column:
    """`Patient ID:n`, or `?` without a patient."""
    number = F.col(patient_id) if isinstance(patient_id, str) else patient_id
    return F.concat(F.lit("Patient ID:"), F.coalesce(number.cast("string"), F.lit("?")))


def status_audit(appointments: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """One row per status change of an existing appointment, even when nothing changes.

    `changes` has request_seq, appointment_id and status. Several changes to one
    appointment chain: the old value is the status the change before left.
    """
    current = appointments.select("appointment_id", F.col("status").alias("_stored"))
    # The chain needs the changes alone; the table joins once, at the end.
    chained = previous_in_key(changes.select(SEQ, "appointment_id", "status"), "appointment_id", SEQ, "status",
                              "_before").join(current, "appointment_id")
    old = F.when(F.col("_before").isNull(), F.col("_stored")).otherwise(F.col("_before.value"))
    return audit_rows(chained, "appointments", "appointment_id", STATUS_CHANGE, old, F.col("status"), as_of)


def delete_audit(deleted: DataFrame, as_of: str) -> DataFrame:
    """One row per deleted patient (request_seq, patient_id, name)."""
    return audit_rows(deleted, "patients", "patient_id", DELETE, patient_label("name", "patient_id"), None, as_of)


def bed_audit(assigned: DataFrame, as_of: str) -> DataFrame:
    """One row per bed that becomes Occupied (request_seq, bed_id, old_status, patient_id).
    A bed without an old status does not count."""
    newly = assigned.filter(F.col("old_status") != "Occupied")
    return audit_rows(newly, "beds", "bed_id", BED_ASSIGNED, F.col("old_status"), bed_label("patient_id"), as_of)


def booking_audit(booked: DataFrame, as_of: str, by_patient: bool) -> DataFrame:
    """One row per booking (request_seq, appointment_id, patient_id, doctor_id)."""
    patient, doctor = F.col("patient_id").cast("string"), F.col("doctor_id").cast("string")
    note = F.concat(F.lit("Patient:"), patient) if by_patient else \
        F.concat(F.lit("P:"), patient, F.lit(" D:"), doctor)
    return audit_rows(booked, "appointments", "appointment_id", USER_BOOKED if by_patient else CREATED, None, note,
                      as_of)


# --- snapshot differences ----------------------------------------------------

def _versions(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that both versions hold, side by side as the structs `b` and `a`."""
    old = before.select(key, F.struct(*columns).alias("b"))
    new = after.select(key, F.struct(*columns).alias("a"))
    return old.join(new, key)


def _net(rows: DataFrame, table: str, key: str, action: str, old, new, as_of: str) -> DataFrame:
    return rows.select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"), F.lit(action).alias("action"),
                       old.alias("old_value"), new.alias("new_value"), stamp(as_of).alias("timestamp"),
                       F.lit("System").alias("performed_by"))


def snapshot_audit(before: dict[str, DataFrame], after: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Audit rows for the net change between two versions of appointments, patients and beds.

    Without a change feed, updates that change nothing and values in between are not visible.
    """
    a = _versions(before["appointments"], after["appointments"], "appointment_id", ["status"])
    status = a.filter(~F.col("b.status").eqNullSafe(F.col("a.status")))
    p = before["patients"].select("patient_id", "name").join(after["patients"].select("patient_id"), "patient_id", "left_anti")
    b = _versions(before["beds"], after["beds"], "bed_id", ["status", "patient_id"])
    beds = b.filter((F.col("a.status") == "Occupied") & (F.col("b.status") != "Occupied"))
    return (_net(status, "appointments", "appointment_id", STATUS_CHANGE, F.col("b.status"), F.col("a.status"), as_of)
            .unionByName(_net(p, "patients", "patient_id", DELETE, patient_label(F.col("name"), "patient_id"),
                              F.lit(None).cast("string"), as_of))
            .unionByName(_net(beds, "beds", "bed_id", BED_ASSIGNED, F.col("b.status"),
                              bed_label(F.col("a.patient_id")), as_of)))


# --- differences by digests ----------------------------------------------------

#: Columns of each table that its audit rule looks at.
AUDITED = {"appointments": ("status",), "patients": ("name",), "beds": ("status", "patient_id")}


def block_digests(rows: DataFrame, block: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(block, n, total, mixed): order-free checksums of each block's rows: how many, the sum and the exclusive
    or of two 64-bit hashes of key and columns, NULL told from every value."""
    parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    one, two = F.xxhash64(F.col(key), *parts), F.xxhash64(F.lit(1), F.col(key), *parts)
    return rows.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("total"),
                                   F.bit_xor(two).alias("mixed"))


def changed_blocks(before: DataFrame, after: DataFrame, block: str) -> DataFrame:
    """The blocks whose digests differ, or that only one version has."""
    marks = lambda d, name: d.select(block, F.struct("n", "total", "mixed").alias(name))
    return (marks(before, "_b").join(marks(after, "_a"), block, "full")
            .filter(~F.col("_b").eqNullSafe(F.col("_a"))).select(block))


def digest_audit(before: dict[str, Version], after: dict[str, Version], as_of: str) -> DataFrame:
    """`snapshot_audit` of two stored versions. Their digests are read whole; of the rows, only blocks that differ, a
    partition each. The numbers of these blocks come to the driver, which lists all partitions anyway, so a job runs at the call."""
    old, new = {}, {}
    for name, version in before.items():
        blocks = [r[0] for r in changed_blocks(version.digests, after[name].digests, BLOCK).collect()]
        for side, rows in ((old, version.rows), (new, after[name].rows)):
            side[name] = rows.filter(F.col(BLOCK).isin(blocks)) if blocks else rows.filter(F.lit(False))
    return snapshot_audit(old, new, as_of)
