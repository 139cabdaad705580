"""Canonical tables and change sets derived from the given test tables.

Only column expressions over one or two source tables; sizes that enter an
expression (number of doctors, patients, beds) are scalar subqueries.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardwright.functions.scalars import coverage, iso_date, iso_stamp, money
from wardwright.schemas import SLOT_GRID, TABLES

AS_OF = "2024-01-15"
AS_OF_STAMP = "2024-01-15 08:00:00"


class _LazyTables(Mapping):
    """Table name -> DataFrame, bound on first use so that a query opens only the files it reads."""

    def __init__(self, bindings: "Bindings"):
        self._bindings = bindings

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return getattr(self._bindings, name)

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


class Bindings:
    """Lazily built tables over one scale-factor folder."""

    _schemas: dict[str, StructType] = {}  # file footers are read once per path

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            path = os.path.join(self.sf_dir, f"{name}.parquet")
            schema = self._schemas.get(path)
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            self._raw[name] = reader.parquet(path)
            self._schemas[path] = self._raw[name].schema
        return self._raw[name]

    def _count(self, name: str) -> Column:
        return self.raw(name).agg(F.count(F.lit(1))).scalar()

    # --- tables ----------------------------------------------------------

    @cached_property
    def departments(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("long").alias("dept_id"), F.col("n_name").alias("dept_name"),
            F.col("r_name").alias("location"), F.lit(50).alias("capacity"))

    @cached_property
    def doctors(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS doctor_id", "s_name AS name",
            "concat('SPEC-', s_suppkey % 5) AS specialization",
            "CAST(s_nationkey AS BIGINT) AS dept_id",
            "format_string('8%09d', s_suppkey) AS phone",
            "CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 10 = 9 THEN '' "
            "ELSE concat('doctor', s_suppkey, '@example.org') END AS email",
            "CAST(date_add(DATE'2015-01-01', CAST(s_suppkey % 3000 AS INT)) AS STRING) AS hire_date",
            "CAST(s_acctbal AS DECIMAL(18,2)) AS salary",
            "IF(s_suppkey % 10 = 0, 'Inactive', 'Active') AS status")

    @cached_property
    def patients(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS patient_id", "c_name AS name", "CAST(18 + c_custkey % 70 AS INT) AS age",
            "element_at(array('Male', 'Female', 'Other'), CAST(c_custkey % 3 AS INT) + 1) AS gender",
            "format_string('9%09d', c_custkey) AS phone",
            "IF(c_custkey % 4 = 0, NULL, concat('p', c_custkey, '@example.org')) AS email",
            "element_at(array('A+', 'B+', 'AB+', 'O-'), CAST(c_custkey % 4 AS INT) + 1) AS blood_group",
            "concat('Area ', c_nationkey) AS address", "'2024-01-01' AS registration_date",
            "IF(c_custkey % 5 = 0, NULL, concat('INS', c_custkey)) AS insurance_id",
            "c_mktsegment AS insurance_provider", "'Active' AS status")

    @cached_property
    def beds(self) -> DataFrame:
        bed_status = "CASE WHEN p_size % 10 = 0 THEN 'Maintenance' WHEN p_size % 10 <= 4 THEN 'Occupied' " \
                     "ELSE 'Available' END"
        beds = self.raw("part").selectExpr(
            "p_partkey AS bed_id", "p_brand AS ward_name", "format_string('BED-%08d', p_partkey) AS bed_number",
            "p_type AS bed_type", f"{bed_status} AS status",
            "CAST(p_retailprice AS DECIMAL(18,2)) AS hourly_rate")
        occupied = F.col("status") == "Occupied"
        return beds.select(
            "bed_id", "ward_name", "bed_number", "bed_type", "status",
            F.when(occupied, F.col("bed_id") % self._count("customer")).alias("patient_id"),
            F.when(occupied, F.lit("2024-01-10 08:00")).alias("admitted_date"), "hourly_rate")

    def _slot_keys(self) -> DataFrame:
        """Events with the doctor, date and slot they stand for."""
        events = self.raw("events")
        n = self._count("supplier")
        place = F.col("event_id") % n
        doctor = F.when(F.col("event_id") % 2 == 0, place).otherwise(place * place % n)
        slots = F.array(*[F.lit(s) for s in SLOT_GRID])
        return events.select(
            "*", doctor.alias("doctor_id"), iso_date("ts").alias("appointment_date"),
            F.element_at(slots, F.hour("ts") % 12 + 1).alias("time_slot"))

    @cached_property
    def appointments(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self._slot_keys().select(
            F.col("event_id").alias("appointment_id"), F.col("user_id").alias("patient_id"), "doctor_id",
            "appointment_date", "time_slot",
            F.expr("CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'click' THEN 'Scheduled' "
                   "WHEN 'view' THEN 'Confirmed' WHEN 'error' THEN 'Cancelled' ELSE 'No-Show' END").alias("status"),
            F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("complaint "), F.col("event_type"))).alias("symptoms"),
            F.when(F.col("event_type") == "purchase", F.lit("treated")).alias("diagnosis"),
            F.lit(None).cast("string").alias("prescription"),
            money("value").alias("fees"), k.alias("wait_time_minutes"),
            F.lit(30).alias("duration_minutes"), iso_stamp("ts").alias("created_at"))

    @cached_property
    def bills(self) -> DataFrame:
        total = money("o_totalprice")
        bed = money(F.floor(total / 2))
        covered = coverage("total_amount", F.col("patient_id") % 5 != 0)
        # All orders; every third customer's go to the next one, so that some patients have no bill.
        payer = F.col("o_custkey") + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("bill_id"), payer.alias("patient_id"),
            F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey")).alias("appointment_id"),
            bed.alias("bed_charges"), money(total - bed).alias("consultation_fees"),
            money(F.lit(0)).alias("medicine_charges"),
            money(F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), 1)
                  .otherwise(0)).alias("test_charges"),
            total.alias("total_amount"), iso_date("o_orderdate").alias("bill_date"),
            F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Paid").alias("status"))
        return orders.withColumn("insurance_coverage", covered).select(
            "bill_id", "patient_id", "appointment_id", "bed_charges", "consultation_fees", "medicine_charges",
            "test_charges", "total_amount", "insurance_coverage",
            money(F.col("total_amount") - F.col("insurance_coverage")).alias("patient_payable"),
            "bill_date", "status")

    @cached_property
    def doctor_availability(self) -> DataFrame:
        # Three days each; those of odd doctors lie a week later, so that the days asked for need defaults.
        days = self.raw("supplier").select(
            "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("d"))
        return days.selectExpr(
            "s_suppkey * 3 + d AS avail_id", "s_suppkey AS doctor_id",
            f"CAST(date_add(DATE'{AS_OF}', CAST(d + s_suppkey % 2 * 7 AS INT)) AS STRING) AS avail_date",
            "IF(s_suppkey % 8 = 0, '10:00', '09:00') AS start_time",
            "IF(s_suppkey % 8 = 0, '13:00', '17:00') AS end_time",
            "NOT (s_suppkey % 6 = 0 AND d = 1) AS is_available",
            "IF(s_suppkey % 6 = 0 AND d = 1, 'Leave', NULL) AS notes")

    @cached_property
    def audit_log(self) -> DataFrame:
        log = self.appointments.filter("status != 'Scheduled'")
        return log.select(
            F.col("appointment_id").alias("log_id"), F.lit("appointments").alias("table_name"),
            F.col("appointment_id").alias("record_id"), F.lit("STATUS_CHANGE").alias("action"),
            F.lit("Scheduled").alias("old_value"), F.col("status").alias("new_value"),
            F.col("created_at").cast("timestamp_ntz").alias("timestamp"), F.lit("System").alias("performed_by"))

    @cached_property
    def uploads(self) -> DataFrame:
        ext = "element_at(array('png', 'PDF', 'exe', 'txt', 'webp', 'docx', 'bin'), CAST(doc_id % 7 AS INT) + 1)"
        return self.raw("documents").selectExpr(
            "doc_id AS upload_id", f"concat('f', doc_id, '.', {ext}) AS filename",
            f"concat(source, '_', doc_id, '.', {ext}) AS original_name", f"lower({ext}) AS file_type",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id % 500 AS INT)) AS uploaded_at")

    @cached_property
    def tables(self) -> Mapping[str, DataFrame]:
        return _LazyTables(self)

    # --- change sets -----------------------------------------------------

    @cached_property
    def admin_bookings(self) -> DataFrame:
        return self._slot_keys().filter("event_type = 'signup'").select(
            F.col("event_id").alias("request_seq"),
            F.when(F.col("event_id") % 50 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("patient_id"),
            "doctor_id", "appointment_date", "time_slot", F.lit(None).cast("string").alias("symptoms"),
            F.when(F.col("event_id") % 3 == 0, money("value")).alias("fees"))

    @cached_property
    def patient_bookings(self) -> DataFrame:
        """Callers: one in four is not on file, and one in three gives no name, which those on file need not."""
        caller = F.when(F.col("event_id") % 4 == 0, F.expr("user_id div 4") + 1000000).otherwise(F.col("user_id"))
        return self._slot_keys().filter("event_type = 'signup'").select(
            F.col("event_id").alias("request_seq"),
            F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("Caller "), F.col("user_id"))).alias("name"),
            (F.lit(18) + F.col("user_id") % 70).cast("int").alias("age"), F.lit("Other").alias("gender"),
            F.format_string("9%09d", caller).alias("phone"),
            "doctor_id", "appointment_date", "time_slot", F.lit(None).cast("string").alias("symptoms"))

    @cached_property
    def status_changes(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS request_seq", "o_custkey * 7 AS appointment_id",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Confirmed' WHEN '2-HIGH' THEN 'Completed' "
            "WHEN '3-MEDIUM' THEN 'Cancelled' WHEN '5-LOW' THEN 'No-Show' ELSE 'Scheduled' END AS status")

    @cached_property
    def acceptances(self) -> DataFrame:
        return self.raw("orders").filter("o_orderstatus = 'O'").selectExpr(
            "o_orderkey AS request_seq", "o_custkey * 7 AS appointment_id",
            "CAST(15 + o_orderkey % 4 * 15 AS INT) AS duration_minutes")

    @cached_property
    def bed_assignments(self) -> DataFrame:
        wanted = F.col("o_orderkey") % (self._count("part") + 50)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("request_seq"), wanted.alias("bed_id"),
            F.expr("CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN -1 ELSE o_custkey END")
             .cast("long").alias("patient_id"))

    @cached_property
    def bed_releases(self) -> DataFrame:
        return self.raw("orders").filter("o_orderstatus = 'F'").selectExpr(
            "o_orderkey AS request_seq", "o_custkey AS bed_id")

    @cached_property
    def bill_requests(self) -> DataFrame:
        part = F.col("l_linenumber") % 4
        price = money("l_extendedprice")

        def charge(place: int, name: str) -> Column:
            return money(F.sum(F.when(part == place, price).otherwise(money(F.lit(0))))).alias(name)

        charges = self.raw("lineitem").groupBy("l_orderkey").agg(
            charge(3, "bed_charges"), charge(0, "consultation_fees"), charge(1, "medicine_charges"),
            charge(2, "test_charges"))
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        return charges.join(orders, charges.l_orderkey == orders.o_orderkey).select(
            F.col("l_orderkey").alias("request_seq"),
            F.when(F.col("o_custkey") % 20 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("patient_id"),
            F.when(F.col("o_orderstatus") == "P", F.col("l_orderkey")).alias("appointment_id"),
            "bed_charges", "consultation_fees", "medicine_charges", "test_charges")

    @cached_property
    def payments(self) -> DataFrame:
        return self.raw("orders").filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").selectExpr(
            "o_orderkey AS request_seq", "o_orderkey AS bill_id")

    @cached_property
    def availability_upserts(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("request_seq"),
            (F.col("o_custkey") % self._count("supplier")).alias("doctor_id"),
            F.expr(f"CAST(date_add(DATE'{AS_OF}', CAST(o_orderkey % 5 AS INT)) AS STRING)").alias("avail_date"),
            F.when(F.col("o_orderstatus") == "O", "10:30").otherwise("09:00").alias("start_time"),
            F.when(F.col("o_orderstatus") == "P", "15:00").otherwise("17:00").alias("end_time"),
            (F.col("o_orderpriority") != "1-URGENT").alias("is_available"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Leave").alias("notes"))

    @cached_property
    def patient_patches(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("request_seq"), (F.col("o_custkey") * 2).alias("id"),
            F.expr("CASE o_orderpriority "
                   "WHEN '1-URGENT' THEN map('phone', format_string('7%09d', o_orderkey), 'ward', 'ignored') "
                   "WHEN '2-HIGH' THEN map('insurance_id', CAST(NULL AS STRING), 'address', concat('Lane ', o_orderkey)) "
                   "WHEN '3-MEDIUM' THEN map('age', CAST(20 + o_orderkey % 50 AS STRING), 'status', 'Inactive') "
                   "WHEN '5-LOW' THEN map('name', CAST(NULL AS STRING), 'email', 'lost@example.org') "
                   "ELSE CAST(map() AS MAP<STRING,STRING>) END").alias("patch"))

    @cached_property
    def doctor_patches(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("request_seq"),
            (F.col("o_custkey") % (self._count("supplier") + 5)).alias("id"),
            F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") == "F", "Inactive").otherwise("Active"))
             .alias("patch"))

    @cached_property
    def patient_deletions(self) -> DataFrame:
        return self.raw("customer").filter("c_mktsegment != 'BUILDING'").select(
            F.col("c_custkey").alias("request_seq"),
            F.expr("c_custkey + IF(c_nationkey = 3, 1000000000, 0)").alias("id"))

    @cached_property
    def new_patients(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'signup'").selectExpr(
            "event_id AS request_seq", "IF(user_id % 10 = 0, NULL, concat('Visitor ', event_id)) AS name",
            "CAST(18 + event_id % 60 AS INT) AS age", "IF(user_id % 11 = 0, NULL, 'Female') AS gender",
            "format_string('6%09d', user_id) AS phone", "CAST(NULL AS STRING) AS email",
            "CAST(NULL AS STRING) AS blood_group", "concat('Area ', user_id) AS address",
            "IF(event_id % 2 = 0, concat('INS', event_id), NULL) AS insurance_id",
            "CAST(NULL AS STRING) AS insurance_provider")

    @cached_property
    def new_doctors(self) -> DataFrame:
        """Applicants: some phones and emails repeat, some are on file, some departments are unknown."""
        return self.raw("customer").selectExpr(
            "c_custkey AS request_seq", "concat('Applicant ', c_custkey) AS name", "c_mktsegment AS specialization",
            "CAST(IF(c_nationkey = 7, 99, c_nationkey) AS BIGINT) AS dept_id",
            "format_string(IF(c_custkey % 9 = 0, '8%09d', '5%09d'), c_custkey - c_custkey % 3) AS phone",
            "IF(c_custkey % 6 = 5, NULL, concat('a', CAST(c_custkey / 4 AS BIGINT), '@example.org')) AS email",
            "CAST(c_acctbal AS DECIMAL(18,2)) AS salary")

    @cached_property
    def new_uploads(self) -> DataFrame:
        return self.raw("pages").selectExpr(
            "page_id AS request_seq", "concat('page', page_id, '.txt') AS filename",
            "IF(page_id % 13 = 0, NULL, url) AS original_name", "'txt' AS file_type")
