"""Appointment bookings and status changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwright.functions.pointers import settle_negations
from wardwright.functions.scalars import money
from wardwright.operators import audit
from wardwright.operators.changes import (FOREIGN_KEY, NOT_NULL, SEQ, Outcome, admission, default_for, exists_flag,
                                           first_valid, known_rows, last_per_key, only_wanted, split_by, update_by_key,
                                           with_new_ids, wanted_flag)
from wardwright.operators.scheduling import (SLOT_KEY, check_availability, known_phones, occupied_slots,
                                             predicted_wait)
from wardwright.schemas import DEFAULT_DURATION, DEFAULT_FEE
from wardwright.session import settle
from wardwright.sources.sinks import with_new_rows

Tables = dict[str, DataFrame]
TAKEN = "slot taken"


def _held_slots(requests: DataFrame, appointments: DataFrame) -> DataFrame:
    """The requested slots that an appointment holds already."""
    return only_wanted(occupied_slots(appointments), SLOT_KEY, requests).withColumn("held", F.lit(True))


def _slot_state(checked: DataFrame, held: DataFrame) -> DataFrame:
    """Per requested slot: the lowest `request_seq` that may win it, and whether it was held before.

    One row per slot, settled. The accepted requests are read off it directly;
    requests meet it again only to learn why they were refused.
    """
    return settle(first_valid(checked, SLOT_KEY, F.col("present") & F.col("complete") & F.col("valid"))
                  .join(held, SLOT_KEY, "left"), "slots")


def _winners(state: DataFrame) -> DataFrame:
    return state.filter("held IS NULL AND winner IS NOT NULL").select(F.col("winner").alias(SEQ))


def _refusals(checked: DataFrame, state: DataFrame) -> DataFrame:
    """Every request that did not win, with its reason."""
    usable = F.col("complete") & F.col("valid")
    reason = admission(F.col("held"), F.col(SEQ), F.col("winner"), usable, TAKEN)
    # Not-null checks go before reference checks on insert.
    reason = F.when((reason == FOREIGN_KEY) & ~F.col("complete"), NOT_NULL).otherwise(reason)
    return (checked.join(state, SLOT_KEY, "left")
            .withColumn("reason", F.when(F.col("present"), reason).otherwise(F.col("absence")))
            .filter("reason IS NOT NULL").select(SEQ, "reason"))


def _all_given(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def book_appointments(t: Tables, requests: DataFrame, as_of: str, high_water: int | None = None) -> Outcome:
    """Staff bookings: the first valid request for a free slot wins; doctors' hours are not looked at.

    Decisions are made on the key columns only; the full request rows are joined
    to the winners once, by `request_seq`.
    """
    # One small row per doctor asked for; its presence is the reference check on doctors. A small batch prunes the scan of
    # the appointments below their aggregation.
    asked = requests.select("doctor_id").filter("doctor_id IS NOT NULL")
    waits = settle(predicted_wait(only_wanted(t["doctors"], ["doctor_id"], asked), only_wanted(t["appointments"], ["doctor_id"], asked)), "waits")
    checked = wanted_flag(requests.select(SEQ, "patient_id", *SLOT_KEY), "patient_id", t["patients"], "patient_id",
                          "_patient")
    checked = exists_flag(checked, "doctor_id", waits, "doctor_id", "_doctor").select(
        SEQ, *SLOT_KEY, F.lit(True).alias("present"), F.lit(None).cast("string").alias("absence"),
        _all_given("patient_id", *SLOT_KEY).alias("complete"), (F.col("_patient") & F.col("_doctor")).alias("valid"))
    state = _slot_state(checked, _held_slots(requests, t["appointments"]))
    ids = with_new_ids(_winners(state), t["appointments"], "appointments", high_water)
    accepted = (requests.join(ids, SEQ).join(waits, "doctor_id")
                .select(SEQ, "appointment_id", "patient_id", "doctor_id", "appointment_date", "time_slot",
                        F.lit("Scheduled").alias("status"), default_for(requests, "symptoms", F.lit("")).alias("symptoms"),
                        money(default_for(requests, "fees", F.lit(DEFAULT_FEE))).alias("fees"),
                        F.col("predicted_wait").alias("wait_time_minutes"),
                        F.lit(DEFAULT_DURATION).alias("duration_minutes"), F.lit(as_of).alias("created_at")))
    return Outcome({"appointments": with_new_rows(t["appointments"], accepted)}, accepted,
                   _refusals(checked, state), audit.booking_audit(accepted, as_of, by_patient=False))


def _registrations(contenders: DataFrame) -> DataFrame:
    """Per phone new to the files, the `request_seq` that registers it, as `registered_at`; settled.

    `contenders` ask for free slots of existing doctors. `sure` ones are complete as they stand; the others wait for an
    earlier registration of their phone, by a `registers` request that wins its slot. Of a slot's sure requests only the first can
    win, so these heads are all that can register; a head wins if no request that waits before it in its slot gets its phone registered.

    In a round a waiting request is let in by a head that has won, and given up if no head of its phone is left before it. A head with
    none left before it wins, one with a let-in request before it loses, and one that has a single request left before it, which
    can hope for a single head only, wins exactly if that one loses. Such heads form chains, which are settled by doubling
    pointers. Only heads that hang on several others are left for the next round, which decides at least the first.
    """
    contenders = settle(contenders.select(SEQ, "phone", *SLOT_KEY, "sure", "registers"), "callers")
    first = settle(contenders.filter("sure").groupBy(*SLOT_KEY).agg(F.min(SEQ).alias("head")), "slot-heads")
    heads = settle(contenders.join(first, SLOT_KEY).filter((F.col(SEQ) == F.col("head")) & F.col("registers"))
                   .select("head", "phone", *SLOT_KEY, F.lit(None).cast("boolean").alias("won")), "heads")
    waiting = settle(contenders.filter("NOT sure").join(heads.select("head", *SLOT_KEY), SLOT_KEY)
                     .filter(F.col(SEQ) < F.col("head")).select(SEQ, "phone", "head"), "waiting")
    heads = heads.drop(*SLOT_KEY)
    while not heads.filter("won IS NULL").isEmpty():
        open_ = F.when(F.col("won").isNull(), F.col("head"))
        calls = settle(heads.groupBy("phone").agg(F.min(F.when(F.col("won"), F.col("head"))).alias("_registered"), F.min(open_).alias("_hoped")), "phones")
        further = settle(heads.filter("won IS NULL").join(calls.select("phone", "_hoped"), "phone").filter(F.col("head") > F.col("_hoped"))
                         .groupBy("phone").agg(F.min("head").alias("_second")), "second-heads")
        before = lambda c: F.coalesce(F.col(c) < F.col(SEQ), F.lit(False))
        hopes = (waiting.join(heads.filter("won IS NULL").select("head"), "head", "left_semi").join(calls, "phone", "left").join(further, "phone", "left")
                 .filter(before("_registered") | before("_hoped"))
                 .select("head", before("_registered").alias("in"), F.when(before("_second"), None).otherwise(F.col("_hoped")).alias("hope")))
        per_head = settle(hopes.groupBy("head").agg(F.bool_or("in").alias("beaten"), F.count(F.lit(1)).alias("n"), F.min("hope").alias("hope")), "hopes")
        judged = heads.join(per_head, "head", "left")
        nodes = judged.select("head", F.coalesce("won", F.when(F.col("n").isNull(), F.lit(True)).when(F.col("beaten"), F.lit(False))).alias("known"),
                              F.when(F.col("n") == 1, F.col("hope")).alias("ahead"))
        decided = settle_negations(nodes, "head").withColumnRenamed("known", "won")
        heads = settle(heads.drop("won").join(decided, "head"), "heads")
    return settle(heads.filter("won").groupBy("phone").agg(F.min("head").alias("registered_at")), "registrations")


def book_as_patient(t: Tables, requests: DataFrame, as_of: str, high_water: int | None = None,
                    patient_high_water: int | None = None) -> Outcome:
    """Patient bookings: leave, working hours and slot are checked in that order; callers are
    looked up by phone and registered with their first accepted request.

    A request must carry name, age, gender and phone unless its phone is on file, from the start or since an
    earlier accepted request of the batch.
    """
    checked = requests.select(SEQ, "phone", *SLOT_KEY, _all_given("name", "age", "gender", "phone").alias("details"))
    on_file = known_phones(requests, t["patients"])
    checked = checked.join(on_file, "phone", "left")
    checked = exists_flag(checked, "doctor_id", t["doctors"], "doctor_id", "valid")
    verdict = F.col("availability_verdict")
    # A doctor's absence comes before the slot: such requests neither win nor lose it.
    on_record = F.col("known_patient_id").isNotNull()
    checked = settle(check_availability(checked, t["doctor_availability"]).select(
        SEQ, "phone", *SLOT_KEY, (verdict == "open").alias("present"), verdict.alias("absence"), "valid",
        (on_record | F.col("details")).alias("sure"), (~on_record & F.col("details")).alias("registers"),
        _all_given(*SLOT_KEY).alias("_slot")), "checked-callers")
    held = settle(_held_slots(requests, t["appointments"]), "held-slots")
    callers = checked.filter(F.col("present") & F.col("valid") & F.col("_slot") & F.col("phone").isNotNull())
    registrations = _registrations(callers.join(held, SLOT_KEY, "left_anti"))
    checked = checked.join(registrations, "phone", "left").withColumn(
        "complete", (F.col("sure") | F.coalesce(F.col("registered_at") < F.col(SEQ), F.lit(False))) & F.col("_slot"))
    state = _slot_state(checked, held)
    admitted = settle(_winners(state).join(requests.select(SEQ, "phone"), SEQ).join(on_file, "phone", "left"), "admitted")

    first_calls = admitted.filter("known_patient_id IS NULL").groupBy("phone").agg(F.min(SEQ).alias(SEQ))
    registered = with_new_ids(first_calls, t["patients"], "patients", patient_high_water)
    by_phone = registered.select("phone", F.col("patient_id").alias("_new_patient_id"))
    ids = with_new_ids(admitted, t["appointments"], "appointments", high_water).drop("phone")
    accepted = (requests.join(ids, SEQ).join(by_phone, "phone", "left")
                .select(SEQ, "appointment_id", F.coalesce("known_patient_id", "_new_patient_id").alias("patient_id"),
                        "doctor_id", "appointment_date", "time_slot", F.lit("Scheduled").alias("status"),
                        default_for(requests, "symptoms", F.lit("")).alias("symptoms"),
                        money(F.lit(DEFAULT_FEE)).alias("fees"), F.lit(0).alias("wait_time_minutes"),
                        F.lit(DEFAULT_DURATION).alias("duration_minutes"), F.lit(as_of).alias("created_at")))
    new_patients = (requests.select(SEQ, "name", "age", "gender").join(registered, SEQ)
                    .select("patient_id", "name", "age", "gender", "phone",
                            F.lit(as_of[:10]).alias("registration_date"), F.lit("Active").alias("status")))
    return Outcome({"appointments": with_new_rows(t["appointments"], accepted),
                    "patients": with_new_rows(t["patients"], new_patients)},
                   accepted, _refusals(checked, state), audit.booking_audit(accepted, as_of, by_patient=True),
                   {"new_patients": new_patients})


def _set_status(t: Tables, changes: DataFrame, columns: list[str], label: str, as_of: str) -> Outcome:
    """Set `columns`, status among them, of the appointments asked for; the last change wins. The table is read twice: once for the
    stored status of the appointments asked for, from which acceptance and audit follow, once for the new state."""
    known = known_rows(changes, t["appointments"], "appointment_id", "status")
    accepted, unknown = split_by(changes, known, "appointment_id")
    latest = settle(last_per_key(changes, "appointment_id", columns), label)
    state = update_by_key(t["appointments"], "appointment_id", latest, {c: F.col(f"c.{c}") for c in columns})
    return Outcome({"appointments": state}, accepted, unknown, audit.status_audit(known, changes, as_of))


def change_status(t: Tables, changes: DataFrame, as_of: str) -> Outcome:
    """Set statuses, last change wins, no state machine; unknown ids change nothing."""
    return _set_status(t, changes, ["status"], "status-changes", as_of)


def accept_appointments(t: Tables, acceptances: DataFrame, as_of: str) -> Outcome:
    """Confirm appointments and set their duration."""
    confirmed = acceptances.withColumn("status", F.lit("Confirmed"))
    return _set_status(t, confirmed, ["status", "duration_minutes"], "acceptances", as_of)
