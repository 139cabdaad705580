"""Bed assignment and release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwright.operators import audit
from wardwright.operators.changes import SEQ, Outcome, admission, first_valid, split_known, update_by_key, wanted_flag
from wardwright.session import settle

Tables = dict[str, DataFrame]
NOT_AVAILABLE = "bed not available"


def assign_beds(t: Tables, requests: DataFrame, as_of: str) -> Outcome:
    """The first valid request for an Available bed wins; a patient may hold several beds.
    A request without a patient passes the reference check."""
    checked = wanted_flag(requests.select(SEQ, "bed_id", "patient_id"), "patient_id", t["patients"], "patient_id",
                          "_patient")
    checked = checked.withColumn("valid", F.col("_patient") | F.col("patient_id").isNull()).drop("_patient")
    free = t["beds"].filter(F.col("status") == "Available").select("bed_id", F.lit(True).alias("free"))
    # One row per requested bed; the accepted requests are read off it.
    per_bed = settle(first_valid(checked, ["bed_id"], "valid").join(free, "bed_id", "left"), "bed-requests")
    winners = per_bed.filter("free AND winner IS NOT NULL").select(F.col("winner").alias(SEQ))
    accepted = settle(requests.select(SEQ, "bed_id", "patient_id").join(winners, SEQ), "bed-assignments")
    reason = admission(F.col("free").isNull(), F.col(SEQ), F.col("winner"), F.col("valid"), NOT_AVAILABLE)
    rejected = (checked.join(per_bed, "bed_id", "left").withColumn("reason", reason)
                .filter("reason IS NOT NULL").select(SEQ, "reason"))
    state = update_by_key(t["beds"], "bed_id", accepted.select("bed_id", "patient_id"), {
        "status": F.lit("Occupied"), "patient_id": F.col("c.patient_id"), "admitted_date": F.lit(as_of)})
    trail = audit.bed_audit(accepted.withColumn("old_status", F.lit("Available")), as_of)
    return Outcome({"beds": state}, accepted, rejected, trail)


def release_beds(t: Tables, requests: DataFrame) -> Outcome:
    """Empty the beds whatever their status (a bed in maintenance becomes Available). No audit."""
    wanted = settle(requests.select("bed_id").distinct(), "bed-releases")
    nothing = F.lit(None)
    state = update_by_key(t["beds"], "bed_id", wanted, {
        "status": F.lit("Available"), "patient_id": nothing.cast("long"), "admitted_date": nothing.cast("string")})
    return Outcome({"beds": state}, *split_known(requests, t["beds"], "bed_id"))
