"""Bill generation and payment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwright.functions.scalars import coverage, insured, money
from wardwright.operators.changes import (FOREIGN_KEY, NOT_NULL, SEQ, Outcome, exists_flag, known_keys, only_wanted, split_known,
                                          update_by_key, with_new_ids)
from wardwright.session import settle
from wardwright.sources.sinks import with_new_rows

Tables = dict[str, DataFrame]
CHARGES = ["bed_charges", "consultation_fees", "medicine_charges", "test_charges"]
UNKNOWN_PATIENT = "unknown patient"


def generate_bills(t: Tables, requests: DataFrame, as_of: str, high_water: int | None = None) -> Outcome:
    """Bill the sum of four charges; insurance carries 70% of it for insured patients."""
    # Only the patients asked for, found in the scan; settled, so their true size decides the join.
    people = settle(only_wanted(t["patients"].select("patient_id", insured("insurance_id").alias("_insured")),
                                ["patient_id"], requests), "billed-patients")
    total = money(sum((F.col(c) for c in CHARGES[1:]), F.col(CHARGES[0])))
    priced = requests.join(people, "patient_id", "left").withColumn("total_amount", total)
    visits = known_keys(requests, t["appointments"], "appointment_id")
    priced = exists_flag(priced, "appointment_id", visits, "appointment_id", "_appointment")
    reason = (F.when(F.col("total_amount").isNull(), NOT_NULL)
               .when(F.col("_insured").isNull(), UNKNOWN_PATIENT)
               .when(F.col("appointment_id").isNotNull() & ~F.col("_appointment"), FOREIGN_KEY))
    decided = settle(priced.withColumn("reason", reason).select(
        SEQ, "patient_id", "appointment_id", *CHARGES, "total_amount", "_insured", "reason"), "bill-requests")
    covered = coverage("total_amount", F.col("_insured"))
    passed = decided.filter("reason IS NULL").withColumn("insurance_coverage", covered).select(
        SEQ, "patient_id", "appointment_id", *CHARGES, "total_amount", "insurance_coverage",
        money(F.col("total_amount") - F.col("insurance_coverage")).alias("patient_payable"),
        F.lit(as_of[:10]).alias("bill_date"), F.lit("Pending").alias("status"))
    accepted = with_new_ids(passed, t["bills"], "bills", high_water)
    return Outcome({"bills": with_new_rows(t["bills"], accepted)}, accepted,
                   decided.filter("reason IS NOT NULL").select(SEQ, "reason"))


def pay_bills(t: Tables, payments: DataFrame) -> Outcome:
    """Mark bills Paid; paying twice changes nothing more."""
    paid = settle(payments.select("bill_id").distinct(), "payments")
    state = update_by_key(t["bills"], "bill_id", paid, {"status": F.lit("Paid")})
    return Outcome({"bills": state}, *split_known(payments, t["bills"], "bill_id"))
