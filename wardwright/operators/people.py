"""Inserts with defaults, sparse updates and referential deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwright.functions.pointers import settle_negations
from wardwright.functions.scalars import stamp
from wardwright.operators import audit
from wardwright.operators.changes import FOREIGN_KEY, NOT_FOUND, NOT_NULL, SEQ, Outcome, default_for, exists_flag, only_wanted, wanted_flag, with_new_ids
from wardwright.schemas import PATCHABLE_PATIENT_COLUMNS, REQUIRED
from wardwright.session import scratch_path, settle
from wardwright.sources.sinks import with_new_rows

Tables = dict[str, DataFrame]
UNIQUE_KEY = "unique"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _missing(table: str) -> Column:
    return _any(F.col(c).isNull() for c in REQUIRED[table])


# --- U1: inserts -------------------------------------------------------------

def _insert(table: DataFrame, name: str, rows: DataFrame, reason: Column, high_water: int | None) -> Outcome:
    decided = settle(rows.withColumn("reason", reason), "insert-requests")
    accepted = with_new_ids(decided.filter("reason IS NULL").drop("reason"), table, name, high_water)
    return Outcome({name: with_new_rows(table, accepted)}, accepted,
                   decided.filter("reason IS NOT NULL").select(SEQ, "reason"))


def add_patients(t: Tables, requests: DataFrame, as_of: str, high_water: int | None = None) -> Outcome:
    """Register patients; contact fields that a request leaves out are empty text."""
    rows = requests.select(
        SEQ, "name", "age", "gender", "phone",
        *[default_for(requests, c, F.lit("")).alias(c) for c in ("email", "blood_group", "address")],
        F.lit(as_of[:10]).alias("registration_date"), "insurance_id", "insurance_provider",
        F.lit("Active").alias("status"))
    return _insert(t["patients"], "patients", rows, F.when(_missing("patients"), NOT_NULL), high_water)


def add_uploads(t: Tables, requests: DataFrame, as_of: str, high_water: int | None = None) -> Outcome:
    """Add entries to the upload manifest."""
    rows = requests.select(SEQ, "filename", "original_name", "file_type", stamp(as_of).alias("uploaded_at"))
    return _insert(t["uploads"], "uploads", rows, F.when(_missing("uploads"), NOT_NULL), high_water)


def add_doctors(t: Tables, requests: DataFrame, as_of: str, high_water: int | None = None) -> Outcome:
    """Register doctors. Phone and email are unique: of equal values the first accepted request wins."""
    doctors = t["doctors"]
    rows = requests.select(
        SEQ, "name", "specialization", "dept_id", "phone", default_for(requests, "email", F.lit("")).alias("email"),
        F.lit(as_of[:10]).alias("hire_date"), "salary", F.lit("Active").alias("status"))
    checked = exists_flag(rows, "dept_id", t["departments"], "dept_id", "_dept")
    checked = exists_flag(checked, "phone", doctors.filter("phone IS NOT NULL"), "phone", "_phone_used")
    # Empty emails may repeat on file, so the parent side is made unique first; settled, as many requests may have one.
    used = settle(only_wanted(doctors.select("email").distinct(), ["email"], rows), "used-emails")
    checked = exists_flag(checked, "email", used, "email", "_email_used")
    reason = (F.when(_missing("doctors"), NOT_NULL)
               .when(F.col("_phone_used") | F.col("_email_used"), UNIQUE_KEY)
               .when(~F.col("_dept"), FOREIGN_KEY))
    decided = settle(checked.select(SEQ, "phone", "email", reason.alias("reason")), "new-doctors")
    admitted = first_come(decided.filter("reason IS NULL").select(SEQ, "phone", "email"), ["phone", "email"])
    accepted = with_new_ids(rows.join(admitted, SEQ), doctors, "doctors", high_water)
    rejected = (decided.join(admitted.withColumn("_in", F.lit(True)), SEQ, "left").filter("_in IS NULL")
                .select(SEQ, F.coalesce("reason", F.lit(UNIQUE_KEY)).alias("reason")))
    return Outcome({"doctors": with_new_rows(doctors, accepted)}, accepted, rejected)


def _per_value(rows: DataFrame, *sums: Column) -> DataFrame:
    """`sums` over the requests of each value of each column, settled so that joins can split a hot value."""
    entry = F.posexplode("entries").alias("column", "entry")
    return settle(rows.select(SEQ, "ahead", entry).where("entry.value IS NOT NULL")
                  .groupBy("column", F.col("entry.value").alias("value")).agg(*sums), "admission-values")


def _with_values(rows: DataFrame, values: DataFrame, columns: int, names: tuple[str, ...]) -> DataFrame:
    """Add to each entry of a request what is known of its value."""
    for k in range(columns):
        own = values.where(F.col("column") == k).select(F.col("value").alias("_value"), F.struct(*names).alias(f"_found{k}"))
        rows = rows.join(own, F.col("entries")[k]["value"] == F.col("_value"), "left").drop("_value")
    entries = F.array(*[F.struct(F.col("entries")[k]["value"].alias("value"), *[
        F.col(f"_found{k}")[n].alias(n) if n in names else F.col("entries")[k][n].alias(n) for n in ("first", "second", "sure")]) for k in range(columns)])
    return rows.withColumn("entries", entries).drop(*[f"_found{k}" for k in range(columns)])


def first_come(requests: DataFrame, unique: list[str]) -> DataFrame:
    """`request_seq` of the requests that get in when each of the text columns must stay unique (NULLs never clash).

    With several unique columns a refusal on one can let a later request in on another. In a round
    * a request that comes first on all its values gets in;
    * a request that comes first on all its values but one leaves that one taken, whether it gets in or an earlier one has:
      whatever comes later on the value is out;
    * a request that is first on all its values but one, and second on that, gets in exactly if the first does not. Such
      requests form chains, which are settled by doubling pointers: a chain of n takes log n jobs.
    What shares a value with a request that got in is out. Only requests that hang on several others are left for the next round,
    which decides at least the first of them. Winners are appended to one table, so plans do not grow with the rounds.
    """
    nothing = F.lit(None).cast("long")
    undecided = requests.select(SEQ, *unique)
    path = scratch_path(requests.sparkSession, "admitted")
    while True:
        entries = F.array(*[F.struct(F.col(c).alias("value"), nothing.alias("first"), nothing.alias("second"), nothing.alias("sure")) for c in unique])
        rows = undecided.select(SEQ, entries.alias("entries"), F.lit(0).alias("ahead"))
        firsts = _per_value(rows, F.min(SEQ).alias("first"))
        # `ahead`: on how many values another request comes before it.
        behind = F.size(F.filter("entries", lambda e: e["first"] < F.col(SEQ)))
        rows = settle(_with_values(rows, firsts, len(unique), ("first",)).withColumn("ahead", behind), "admission-order")
        late = F.col("entry.first") < F.col(SEQ)
        seconds = _per_value(rows, F.min(F.when(late, F.col(SEQ))).alias("second"),
                             F.min(F.when(F.col("ahead") - late.cast("int") == 0, F.col(SEQ))).alias("sure"))
        rows = _with_values(rows, seconds, len(unique), ("second", "sure"))
        before = F.filter("entries", lambda e: e["first"] < F.col(SEQ))[0]
        known = (F.when(F.col("ahead") == 0, F.lit(True))
                 .when(F.exists("entries", lambda e: e["sure"] < F.col(SEQ)), F.lit(False)))
        leader = F.when((F.col("ahead") == 1) & (before["second"] == F.col(SEQ)), before["first"])
        decided = settle_negations(rows.select(SEQ, known.alias("known"), leader.alias("ahead")), SEQ)
        winners = undecided.join(decided.where("known"), SEQ, "left_semi")
        winners.select(SEQ, *unique).write.mode("append").parquet(path)
        rest = undecided.join(decided.where("known IS NULL"), SEQ, "left_semi")
        if rest.isEmpty():
            return requests.sparkSession.read.schema(undecided.schema).parquet(path).select(SEQ)
        admitted = requests.sparkSession.read.schema(undecided.schema).parquet(path)
        for c in unique:
            rest = rest.join(admitted.select(c), c, "left_anti")
        undecided = settle(rest.select(SEQ, *unique), "admission-rest")


# --- U2: sparse updates ------------------------------------------------------

def patch_rows(table: DataFrame, name: str, key: str, patches: DataFrame, columns: tuple[str, ...]) -> Outcome:
    """Set only the columns a patch names; a named NULL sets NULL, unknown names are ignored, and the
    last patch to name a column wins. A patch that breaks NOT NULL or a type is refused as a whole.
    """
    types = dict(table.dtypes)
    required = [c for c in columns if c in REQUIRED[name]]
    typed = [c for c in columns if types[c] != "string"]
    entries = F.map_entries("patch")
    blank = F.exists(entries, lambda e: e["key"].isin(required) & e["value"].isNull())

    def unreadable(c: str) -> Column:
        return F.exists(entries, lambda e: (e["key"] == c) & e["value"].isNotNull()
                        & e["value"].try_cast(types[c]).isNull())

    checked = wanted_flag(patches, "id", table, key, "_known").withColumn(
        "reason", F.when(~F.col("_known"), NOT_FOUND).when(blank, NOT_NULL).when(_any(map(unreadable, typed)), "bad value"))
    accepted = checked.filter("reason IS NULL").select(SEQ, "id", "patch")

    given = accepted.select(SEQ, "id", F.explode("patch").alias("_column", "_text")).filter(
        F.col("_column").isin(*columns))
    # One struct per column: NULL if no patch names it, otherwise the value given last.
    latest = settle(given.groupBy("id").agg(*[
        F.max_by(F.struct(F.col("_text").alias("v")), F.when(F.col("_column") == c, F.col(SEQ))).alias(c)
        for c in columns]), "patches")
    joined = table.alias("t").join(latest.alias("p"), F.col(f"t.{key}") == F.col("p.id"), "left")
    state = joined.select(*[
        F.when(F.col(f"p.{c}").isNotNull(), F.col(f"p.{c}.v").cast(types[c])).otherwise(F.col(f"t.{c}")).alias(c)
        if c in columns else F.col(f"t.{c}") for c in table.columns])
    return Outcome({name: state}, accepted, checked.filter("reason IS NOT NULL").select(SEQ, "reason"))


def patch_patients(t: Tables, patches: DataFrame) -> Outcome:
    return patch_rows(t["patients"], "patients", "patient_id", patches, PATCHABLE_PATIENT_COLUMNS)


def patch_doctor_status(t: Tables, patches: DataFrame) -> Outcome:
    return patch_rows(t["doctors"], "doctors", "doctor_id", patches, ("status",))


# --- U3: deletes -------------------------------------------------------------

BILLED = "has bills"


def delete_patients(t: Tables, deletions: DataFrame, as_of: str) -> Outcome:
    """Delete patients with their appointments and empty their beds' patient column.

    Patients billed directly or through one of their appointments stay. A bed
    keeps its Occupied status, which the bed consistency rule then reports.
    """
    wanted = settle(deletions.groupBy(F.col("id").alias("patient_id")).agg(F.min(SEQ).alias("_first")), "asked")
    ids = wanted.select("patient_id")
    named = t["patients"].select("patient_id", "name", F.lit(True).alias("_known"))
    targets = wanted.join(named, "patient_id", "left")
    visits = t["appointments"].select("patient_id", "appointment_id").join(ids, "patient_id", "left_semi")
    # Visits are unique; the billed ones are made so before the join, in case one visit has many bills.
    billed_visits = visits.join(t["bills"].filter("appointment_id IS NOT NULL").select("appointment_id").distinct(),
                                "appointment_id", "left_semi")
    billed = t["bills"].select("patient_id").join(ids, "patient_id", "left_semi").unionByName(
        billed_visits.select("patient_id")).distinct().withColumn("_billed", F.lit(True))
    # One row per id asked for; all outputs follow from it.
    verdicts = settle(targets.join(billed, "patient_id", "left"), "deletions")
    known, blocked = F.col("_known").isNotNull(), F.col("_billed").isNotNull()
    gone = verdicts.filter(known & ~blocked).select(F.col("_first").alias(SEQ), "patient_id", "name")
    gone_ids = gone.select("patient_id")

    beds = t["beds"]
    emptied = beds.alias("b").join(gone_ids.withColumnRenamed("patient_id", "_gone").alias("g"),
                                   F.col("b.patient_id") == F.col("_gone"), "left")
    new_beds = emptied.select(*[
        F.when(F.col("_gone").isNull(), F.col("b.patient_id")).alias(c) if c == "patient_id" else F.col(f"b.{c}")
        for c in beds.columns])
    requests = deletions.select(SEQ, F.col("id").alias("patient_id"))
    reason = F.when(known & blocked, BILLED).when(~known | (F.col(SEQ) != F.col("_first")), NOT_FOUND)
    refused = (requests.join(verdicts, "patient_id").withColumn("reason", reason)
               .filter("reason IS NOT NULL").select(SEQ, "reason"))
    return Outcome(
        {"patients": t["patients"].join(gone_ids, "patient_id", "left_anti"),
         "appointments": t["appointments"].join(gone_ids, "patient_id", "left_anti").select(
             *t["appointments"].columns),
         "beds": new_beds},
        gone, refused, audit.delete_audit(gone, as_of))
