"""Every operator as a query over the bound test tables, next to SQL that must give the same rows.

Results are flattened for the comparison: money as DOUBLE, whole numbers as
BIGINT, timestamps as text. Lists are exploded.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.functions import scalars as fx
from wardwright.operators import (audit, billing, booking, filters, people, quality, reports, rosters, scheduling,
                                  wards)
from wardwright.operators.changes import SEQ, append_audit
from wardwright.plans import dashboard, views
from wardwright.plans.oracle_tables import OCC, with_tables
from wardwright.schemas import KEYS
from wardwright.session import scratch_path, settle, tune
from wardwright.sources import sinks, tables
from wardwright.sources.bindings import AS_OF, AS_OF_STAMP, Bindings
from wardwright.sources.calendar import with_days, with_slots
from wardwright.sources.versions import write_version
from wardwright.streaming import audit_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def flat(rows: DataFrame) -> DataFrame:
    def cell(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            return c.cast("double").alias(name)
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("long").alias(name)
        if kind.startswith("timestamp"):
            return fx.iso_stamp(c).alias(name)
        return c
    return rows.select(*[cell(name, kind) for name, kind in rows.dtypes])


def query(key: str, sql: str | None):
    """Register a query; `sql` is None where no plain SQL gives the answer (tests compare with a replay)."""
    def register(build: Callable[[Bindings], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(build(Bindings(tune(spark), sf_dir)))
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_tables(sql)
        return build
    return register


def money_columns(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


PATIENT = ("patient_id, name, age, gender, phone, email, blood_group, address, registration_date, insurance_id, "
           "insurance_provider, status")
APPOINTMENT = ("appointment_id, patient_id, doctor_id, appointment_date, time_slot, status, symptoms, diagnosis, "
               "prescription, " + money_columns("fees") + ", wait_time_minutes, duration_minutes, created_at")
DETAILS = ("appointment_id, patient_name, patient_phone, doctor_name, dept_name, appointment_date, time_slot, status, "
           + money_columns("fees") + ", symptoms, diagnosis, duration_minutes")
BED = ("bed_id, ward_name, bed_number, bed_type, status, patient_id, admitted_date, "
       + money_columns("hourly_rate"))
BILL_MONEY = ("bed_charges", "consultation_fees", "medicine_charges", "test_charges", "total_amount",
              "insurance_coverage", "patient_payable")
BILL = "bill_id, patient_id, appointment_id, " + money_columns(*BILL_MONEY) + ", bill_date, status"
AVAIL = "avail_id, doctor_id, avail_date, start_time, end_time, is_available, notes"
AUDIT = f"'System' AS performed_by, '{AS_OF_STAMP}' AS timestamp"

# --- scans, sources, sinks -----------------------------------------------------


@query("sc1_full_scan", "SELECT * FROM departments ORDER BY dept_id")
def _(b):
    return tables.full_scan(b.departments, "departments")


@query("sc1_patients_newest_first", f"SELECT {PATIENT} FROM patients ORDER BY patient_id DESC")
def _(b):
    return tables.full_scan(b.patients, "patients", newest_first=True)


@query("sc2_stored_view",
       "SELECT dept_name, count(*) AS active_doctors FROM v_doctor_dept WHERE status = 'Active' GROUP BY dept_name")
def _(b):
    views.register_views(b.spark, b.tables)
    return b.spark.sql("SELECT dept_name, count(*) AS active_doctors FROM v_doctor_dept "
                       "WHERE status = 'Active' GROUP BY dept_name")


@query("sc3_slot_calendar", f"""
    SELECT doctor_id, strftime(day, '%Y-%m-%d') AS date, strftime(day, '%a, %b %d') AS label, time_slot
    FROM doctors, (SELECT DATE '{AS_OF}' + CAST(i AS INTEGER) AS day FROM (SELECT unnest([0, 1, 2]) AS i)),
         (SELECT unnest(['09:00', '09:30', '10:00', '10:30', '11:00', '11:30', '14:00', '14:30', '15:00', '15:30',
                         '16:00', '16:30']) AS time_slot)""")
def _(b):
    return with_slots(with_days(b.doctors.select("doctor_id"), AS_OF))


@query("sc4_json_sink", "SELECT status, count(*) AS cnt FROM appointments GROUP BY status")
def _(b):
    path = scratch_path(b.spark, "json")
    sinks.write_json(reports.appointments_by_status(b.appointments), path)
    return b.spark.read.schema("status STRING, cnt BIGINT").json(path)


@query("sc4_json_records", f"""
    SELECT appointment_id, patient_name, CAST(fees AS DOUBLE) AS fees, symptoms
    FROM v_appointment_details""")
def _(b):
    """Rows to JSON documents and back."""
    rows = views.appointment_details(b.tables).select("appointment_id", "patient_name", "fees", "symptoms")
    parsed = sinks.json_records(rows).select(F.from_json(
        "record", "appointment_id BIGINT, patient_name STRING, fees DOUBLE, symptoms STRING").alias("r"))
    return parsed.select("r.*")


@query("sc5_upload_manifest", "SELECT * FROM uploads ORDER BY uploaded_at DESC, upload_id DESC")
def _(b):
    return tables.upload_manifest(b.uploads)


@query("sc5_files_manifest", """
    SELECT file_type, count(*) AS uploads, CAST(sum(strlen(original_name) + 1) AS BIGINT) AS bytes
    FROM uploads GROUP BY file_type""")
def _(b):
    """Write the uploads' names to a folder per file type, list the files there without reading them, and hold their sizes
    against the manifest, by the folder's name."""
    folder = scratch_path(b.spark, "upload-files")
    sinks.write_lines(b.uploads, folder, "original_name", "file_type")
    stored = (tables.files_manifest(b.spark, folder).withColumn("file_type", F.regexp_extract("path", "/file_type=([^/]*)/", 1))
              .groupBy("file_type").agg(F.sum("length").alias("bytes")))
    listed = b.uploads.groupBy("file_type").agg(F.count(F.lit(1)).alias("uploads"))
    return listed.join(stored, "file_type").select("file_type", "uploads", "bytes")


def _bucketed(rows: DataFrame, name: str, key: str, spread: str, **layout) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    return sinks.write_bucketed(rows, os.path.basename(path).replace("-", "_"), key, path, buckets=16, sort=(key, spread), spread=spread, **layout)


@query("sc6_bucketed_lookup", f"SELECT {APPOINTMENT} FROM appointments WHERE doctor_id = 4 AND status = 'Scheduled'")
def _(b):
    """One doctor's open appointments, from a table with a folder per status and buckets by doctor."""
    stored = _bucketed(b.appointments, "appointments-by-doctor", "doctor_id", "appointment_id", partition="status", files_per_bucket=2)
    return stored.filter("doctor_id = 4 AND status = 'Scheduled'").select(*b.appointments.columns)


@query("sc6_bucketed_join", """
    SELECT patient_id, visits, last_visit, bills, CAST(owed AS DOUBLE) AS owed
    FROM (SELECT patient_id, count(*) AS visits, max(appointment_date) AS last_visit FROM appointments GROUP BY patient_id)
    JOIN (SELECT patient_id, count(*) AS bills, coalesce(sum(patient_payable) FILTER (status = 'Pending'), 0) AS owed
          FROM bills GROUP BY patient_id) USING (patient_id)""")
def _(b):
    """Visits and debts of each patient, from two tables with buckets by patient: grouped and joined without a shuffle."""
    visits = _bucketed(b.appointments, "appointments-by-patient", "patient_id", "appointment_id").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("visits"), F.max("appointment_date").alias("last_visit"))
    pending = F.when(F.col("status") == "Pending", F.col("patient_payable"))
    bills = _bucketed(b.bills, "bills-by-patient", "patient_id", "bill_id").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("bills"), F.coalesce(F.sum(pending), F.lit(0)).alias("owed"))
    return visits.join(bills, "patient_id")


@query("sc6_date_pruned_lookup", f"SELECT {APPOINTMENT} FROM appointments WHERE appointment_date = '{AS_OF}'")
def _(b):
    path = scratch_path(b.spark, "appointments-by-date")
    sinks.write_by_date(b.appointments, path, "appointment_date", "appointment_id")
    stored = b.spark.read.schema(b.appointments.schema).parquet(path)
    return stored.filter(F.col("appointment_date") == AS_OF).select(*b.appointments.columns)


@query("sc7_batch_append", f"SELECT {PATIENT} FROM patients UNION ALL " + """
    SELECT (SELECT max(patient_id) FROM patients) + row_number() OVER (ORDER BY request_seq), name, age, gender, phone,
           '', '', address, '2024-01-15', insurance_id, NULL, 'Active'
    FROM new_patients WHERE name IS NOT NULL AND gender IS NOT NULL""")
def _(b):
    path = scratch_path(b.spark, "patients")
    sinks.append_rows(b.patients, path)
    added = people.add_patients(b.tables, b.new_patients, AS_OF).accepted
    sinks.append_rows(added.select(*b.patients.columns), path)
    return b.spark.read.schema(b.patients.schema).parquet(path)


# --- projections, filters, predicates --------------------------------------------

@query("p1_aliased_projection", """
    SELECT a.appointment_id, p.name AS patient_name, d.name AS doctor_name, a.status
    FROM appointments a JOIN patients p USING (patient_id) JOIN doctors d USING (doctor_id)""")
def _(b):
    return views.appointment_details(b.tables).select("appointment_id", "patient_name", "doctor_name", "status")


@query("p2_star_plus_columns", "SELECT " + ", ".join(
    f"CAST(b.{c} AS DOUBLE) AS {c}" for c in BILL_MONEY) + """, b.bill_id, b.patient_id, b.appointment_id,
    b.bill_date, b.status, p.name AS patient_name, p.insurance_provider
    FROM bills b JOIN patients p ON b.patient_id = p.patient_id""")
def _(b):
    people_ = b.patients.select("patient_id", F.col("name").alias("patient_name"), "insurance_provider")
    return b.bills.join(people_, "patient_id").select(*b.bills.columns, "patient_name", "insurance_provider")


@query("p3_optional_filter", f"""
    SELECT {DETAILS} FROM v_appointment_details WHERE status = 'Scheduled' AND appointment_date = '{AS_OF}'""")
def _(b):
    return filters.appointment_list(views.appointment_details(b.tables), "Scheduled", AS_OF)


@query("p3_no_filter", f"SELECT {DETAILS} FROM v_appointment_details")
def _(b):
    return filters.appointment_list(views.appointment_details(b.tables))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("p4_search", f"SELECT {PATIENT} FROM patients WHERE " + " OR ".join(
    f"translate({c}, {_LOWER}) LIKE '%s_1%5%'" for c in ("name", "phone", "insurance_id")))
def _(b):
    return filters.search_patients(b.patients, "S_1%5")


@query("p5_literal_search", f"""
    SELECT {PATIENT} FROM patients WHERE contains(lower(name), 'ins12') OR contains(phone, 'ins12')
        OR contains(lower(coalesce(insurance_id, '')), 'ins12')""")
def _(b):
    return filters.search_patients_literal(b.patients, "iNs12")


@query("p6_occupying", f"SELECT {APPOINTMENT} FROM appointments WHERE status IN {OCC}")
def _(b):
    return b.appointments.filter(filters.occupying())


@query("p7_date_range", f"""
    SELECT {AVAIL} FROM doctor_availability WHERE doctor_id = 6 AND avail_date BETWEEN '2024-01-16' AND '2024-01-17'""")
def _(b):
    return filters.availability_between(b.doctor_availability, 6, "2024-01-16", "2024-01-17")


@query("p8_half_open_hours", """
    SELECT x.request_seq, x.time_slot, v.start_time, v.end_time FROM patient_bookings x
    JOIN doctor_availability v ON v.doctor_id = x.doctor_id AND v.avail_date = x.appointment_date
    WHERE x.time_slot >= v.start_time AND x.time_slot < v.end_time""")
def _(b):
    days = scheduling.availability_by_day(b.doctor_availability)
    held = b.patient_bookings.join(days, ["doctor_id", "appointment_date"])
    return held.filter(filters.in_hours("time_slot", "start_time", "end_time")).select(
        SEQ, "time_slot", "start_time", "end_time")


@query("p9_constant_equality", """
    SELECT 'doctor' AS kind, doctor_id AS id FROM doctors WHERE status = 'Active' UNION ALL
    SELECT 'appointment', appointment_id FROM appointments WHERE status = 'Scheduled' UNION ALL
    SELECT 'bed', bed_id FROM beds WHERE status = 'Available'""")
def _(b):
    def ids(table, key, kind, status):
        return table.filter(F.col("status") == status).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return (ids(b.doctors, "doctor_id", "doctor", "Active")
            .unionByName(ids(b.appointments, "appointment_id", "appointment", "Scheduled"))
            .unionByName(ids(b.beds, "bed_id", "bed", "Available")))


@query("p10_department_filter", f"SELECT * EXCLUDE (salary), {money_columns('salary')} FROM v_doctor_dept WHERE dept_id = 15")
def _(b):
    return filters.doctor_list(views.doctor_dept(b.tables), 15)


@query("p11_insured", "SELECT patient_id, coalesce(insurance_id, 'NONE') <> 'NONE' AS insured FROM patients")
def _(b):
    return b.patients.select("patient_id", fx.insured("insurance_id").alias("insured"))


@query("p12_positive_revenue", f"SELECT dept_name, {money_columns('revenue')} FROM v_dept_stats WHERE revenue > 0")
def _(b):
    return filters.departments_with_revenue(views.dept_stats(b.tables))


@query("p13_allowed_extension", """
    SELECT upload_id, original_name, contains(original_name, '.')
           AND lower(regexp_extract(original_name, '[^.]*$')) IN ('png', 'jpg', 'jpeg', 'gif', 'pdf', 'doc', 'docx',
               'xls', 'xlsx', 'ppt', 'pptx', 'txt', 'svg', 'webp') AS allowed
    FROM uploads""")
def _(b):
    return b.uploads.select("upload_id", "original_name", filters.allowed_upload("original_name").alias("allowed"))


@query("p14_image_files", """
    SELECT upload_id, file_type, file_type IN ('png', 'jpg', 'jpeg', 'gif', 'svg', 'webp') AS is_image FROM uploads""")
def _(b):
    return b.uploads.select("upload_id", "file_type", filters.is_image("file_type").alias("is_image"))


@query("p15_pending_queue", f"SELECT {DETAILS} FROM v_appointment_details WHERE status = 'Scheduled'")
def _(b):
    return filters.pending_queue(views.appointment_details(b.tables))


# --- joins ------------------------------------------------------------------------

@query("v1_doctor_dept", f"SELECT * EXCLUDE (salary), {money_columns('salary')} FROM v_doctor_dept")
def _(b):
    return views.doctor_dept(b.tables)


@query("v2_appointment_details", f"SELECT {DETAILS} FROM v_appointment_details")
def _(b):
    return views.appointment_details(b.tables)


@query("v3_bed_occupancy", f"SELECT * EXCLUDE (hourly_rate), {money_columns('hourly_rate')} FROM v_bed_occupancy")
def _(b):
    return views.bed_occupancy(b.tables).orderBy("ward_name", "bed_number")


@query("v4_dept_stats", f"SELECT * EXCLUDE (revenue), {money_columns('revenue')} FROM v_dept_stats")
def _(b):
    return views.dept_stats(b.tables)


@query("j4_left_chain_count", """
    SELECT d.doctor_id, d.name AS doctor, dp.dept_name, count(a.appointment_id) AS total_appts
    FROM doctors d LEFT JOIN departments dp ON d.dept_id = dp.dept_id
    LEFT JOIN appointments a ON d.doctor_id = a.doctor_id GROUP BY d.doctor_id, d.name, dp.dept_name""")
def _(b):
    return reports.appointments_per_doctor(b.tables)


@query("j5_top_completed", """
    SELECT d.doctor_id, d.name AS doctor, dp.dept_name, count(a.appointment_id) AS completed_appts
    FROM doctors d JOIN departments dp ON d.dept_id = dp.dept_id
    JOIN appointments a ON d.doctor_id = a.doctor_id AND a.status = 'Completed'
    GROUP BY d.doctor_id, d.name, dp.dept_name ORDER BY completed_appts DESC, d.doctor_id LIMIT 5""")
def _(b):
    return reports.top_completed(b.tables)


@query("j6_availability_roster", """
    SELECT v.*, d.name AS doctor_name, d.specialization, dp.dept_name FROM doctor_availability v
    JOIN doctors d ON v.doctor_id = d.doctor_id JOIN departments dp ON d.dept_id = dp.dept_id""")
def _(b):
    return reports.availability_roster(b.tables)


@query("j7_bill_list", "SELECT " + ", ".join(f"CAST(b.{c} AS DOUBLE) AS {c}" for c in BILL_MONEY) + """,
    b.bill_id, b.patient_id, b.appointment_id, b.bill_date, b.status, p.name AS patient_name, p.insurance_provider
    FROM bills b JOIN patients p ON b.patient_id = p.patient_id ORDER BY b.bill_id DESC""")
def _(b):
    return reports.bill_list(b.tables)


@query("j8_availability_check", "SELECT request_seq, verdict AS availability_verdict FROM u6_decided")
def _(b):
    return scheduling.check_availability(b.patient_bookings, b.doctor_availability).select(SEQ, "availability_verdict")


@query("j9_patients_with_bills", """
    SELECT patient_id, name, phone FROM patients p
    WHERE EXISTS (SELECT 1 FROM bills b WHERE b.patient_id = p.patient_id) ORDER BY name""")
def _(b):
    return reports.patients_with_bills(b.tables)


def _asked_days(b: Bindings) -> DataFrame:
    return with_days(b.doctors.select("doctor_id"), AS_OF).select("doctor_id", F.col("date").alias("appointment_date"))


@query("j10_open_slots", f"""
    SELECT c.doctor_id, c.day AS appointment_date, c.time_slot
    FROM (SELECT doctor_id, strftime(DATE '{AS_OF}' + CAST(i AS INTEGER), '%Y-%m-%d') AS day, time_slot
          FROM doctors, (SELECT unnest([0, 1, 2]) AS i),
          (SELECT unnest(['09:00', '09:30', '10:00', '10:30', '11:00', '11:30', '14:00', '14:30', '15:00', '15:30',
                          '16:00', '16:30']) AS time_slot)) c
    LEFT JOIN doctor_availability v ON v.doctor_id = c.doctor_id AND v.avail_date = c.day
    WHERE (v.avail_id IS NULL OR (v.is_available AND c.time_slot >= v.start_time AND c.time_slot < v.end_time))
      AND NOT EXISTS (SELECT 1 FROM appointments a WHERE a.doctor_id = c.doctor_id AND a.appointment_date = c.day
                      AND a.time_slot = c.time_slot AND a.status IN {OCC})""")
def _(b):
    return scheduling.open_slots(_asked_days(b), b.appointments, b.doctor_availability)


@query("j11_availability_calendar", f"""
    SELECT d.doctor_id, d.name, d.specialization, d.dept_id, dp.dept_name, strftime(c.day, '%Y-%m-%d') AS date,
           strftime(c.day, '%a, %b %d') AS label, coalesce(v.is_available, TRUE) AS is_available,
           coalesce(v.start_time, '09:00') AS start_time, coalesce(v.end_time, '17:00') AS end_time,
           CASE WHEN v.avail_id IS NULL THEN 'Default schedule' ELSE coalesce(v.notes, '') END AS notes
    FROM doctors d JOIN departments dp ON d.dept_id = dp.dept_id,
         (SELECT DATE '{AS_OF}' + CAST(i AS INTEGER) AS day FROM (SELECT unnest([0, 1, 2]) AS i)) c
    LEFT JOIN doctor_availability v ON v.doctor_id = d.doctor_id AND v.avail_date = strftime(c.day, '%Y-%m-%d')
    WHERE d.status = 'Active'""")
def _(b):
    return scheduling.availability_calendar(b.tables, AS_OF).select(
        "doctor_id", "name", "specialization", "dept_id", "dept_name", F.inline("availability"))


def _matrix_sql(days: tuple[str, ...]) -> str:
    cells = ", ".join(f"""coalesce(max(CASE WHEN v.avail_date = '{d}' THEN
        CASE WHEN v.is_available THEN v.start_time || '-' || v.end_time ELSE 'Leave' END END), 'Default')
        AS d_{d.replace('-', '_')}""" for d in days)
    return f"""SELECT d.doctor_id, d.name, dp.dept_name, {cells}
        FROM doctors d JOIN departments dp ON d.dept_id = dp.dept_id
        LEFT JOIN doctor_availability v ON v.doctor_id = d.doctor_id GROUP BY d.doctor_id, d.name, dp.dept_name"""


@query("j12_availability_matrix", _matrix_sql(("2024-01-15", "2024-01-16", "2024-01-17")))
def _(b):
    return scheduling.availability_matrix(b.tables, AS_OF)


@query("j13_join_aggregated", """
    SELECT d.doctor_id, d.name, c.cnt AS appt_count
    FROM doctors d JOIN (SELECT doctor_id, count(*) AS cnt FROM appointments GROUP BY doctor_id) c
      ON d.doctor_id = c.doctor_id""")
def _(b):
    counts = b.appointments.groupBy("doctor_id").agg(F.count(F.lit(1)).alias("appt_count"))
    return b.doctors.join(counts, "doctor_id").select("doctor_id", "name", "appt_count")


@query("j14_lookup_by_phone", """
    SELECT x.request_seq, p.patient_id AS known_patient_id FROM patient_bookings x
    LEFT JOIN (SELECT phone, min(patient_id) AS patient_id FROM patients GROUP BY phone) p ON x.phone = p.phone""")
def _(b):
    return scheduling.resolve_patients(b.patient_bookings, b.patients).select(SEQ, "known_patient_id")


# --- aggregates --------------------------------------------------------------------

@query("a1_counts", "SELECT (SELECT count(*) FROM patients) AS patients, (SELECT count(*) FROM beds) AS beds")
def _(b):
    return b.spark.range(1).select(reports.row_count(b.patients).scalar().alias("patients"),
                                   reports.row_count(b.beds).scalar().alias("beds"))


@query("a2_filtered_counts", """
    SELECT (SELECT count(*) FROM doctors WHERE status = 'Active') AS active_doctors,
           (SELECT count(*) FROM appointments WHERE status = 'Scheduled') AS scheduled,
           (SELECT count(*) FROM beds WHERE status = 'Available') AS available_beds""")
def _(b):
    return b.spark.range(1).select(
        reports.filtered_count(b.doctors, "Active").scalar().alias("active_doctors"),
        reports.filtered_count(b.appointments, "Scheduled").scalar().alias("scheduled"),
        reports.filtered_count(b.beds, "Available").scalar().alias("available_beds"))


@query("a3_total_revenue",
       "SELECT CAST(round(coalesce(sum(total_amount), 0), 2) AS DOUBLE) AS total_revenue FROM bills")
def _(b):
    return reports.total_revenue(b.bills)


@query("a4_by_status", "SELECT status, count(*) AS cnt FROM appointments GROUP BY status")
def _(b):
    return reports.appointments_by_status(b.appointments)


@query("a5_bed_pivot", """
    SELECT bed_type, count(*) AS total, count(*) FILTER (status = 'Available') AS available,
           count(*) FILTER (status = 'Occupied') AS occupied, count(*) FILTER (status = 'Maintenance') AS maintenance
    FROM beds GROUP BY bed_type""")
def _(b):
    return reports.beds_by_type(b.beds)


@query("a6_flagship_dept_stats", f"SELECT * EXCLUDE (revenue), {money_columns('revenue')} FROM v_dept_stats")
def _(b):
    return views.dept_stats(b.tables)


_WAIT_SQL = """
    SELECT dp.dept_name, round(avg(a.wait_time_minutes), 1) AS avg_wait FROM appointments a
    JOIN doctors d ON a.doctor_id = d.doctor_id JOIN departments dp ON d.dept_id = dp.dept_id
    WHERE a.status = 'Completed' GROUP BY dp.dept_name ORDER BY avg_wait DESC"""


@query("a7_mean_wait", _WAIT_SQL)
def _(b):
    return reports.mean_wait_by_department(b.tables)


@query("a8_dept_having", """
    SELECT dp.dept_name, count(DISTINCT d.doctor_id) AS doctors, count(a.appointment_id) AS appointments,
           CAST(sum(CASE WHEN a.status = 'Completed' THEN a.fees ELSE 0 END) AS DOUBLE) AS revenue,
           round(avg(CASE WHEN a.status = 'Completed' THEN a.wait_time_minutes END), 1) AS avg_wait,
           count(CASE WHEN a.status = 'Cancelled' THEN 1 END) AS cancellations
    FROM departments dp LEFT JOIN doctors d ON dp.dept_id = d.dept_id
    LEFT JOIN appointments a ON d.doctor_id = a.doctor_id
    GROUP BY dp.dept_id, dp.dept_name HAVING count(a.appointment_id) > 0 ORDER BY revenue DESC""")
def _(b):
    return reports.department_report(b.tables)


@query("a9_dependent_columns", """
    SELECT dept_id, dept_name, location, doctor_count, total_appointments FROM v_dept_stats""")
def _(b):
    """The key's dependent columns join after the aggregation instead of widening its key."""
    return views.dept_stats(b.tables).select("dept_id", "dept_name", "location", "doctor_count", "total_appointments")


@query("a10_mean_salary", "SELECT CAST(round(sum(salary) / count(*), 2) AS DOUBLE) AS avg_salary FROM doctors")
def _(b):
    return reports.mean_salary(b.doctors).select(F.round("avg_salary", 2).alias("avg_salary"))


@query("a11_mean_of_counts", """
    SELECT avg(cnt) AS mean_count FROM (SELECT count(*) AS cnt FROM appointments GROUP BY doctor_id)""")
def _(b):
    return reports.appointment_count_mean(b.appointments)


@query("a12_predicted_wait", "SELECT * FROM predicted")
def _(b):
    return scheduling.predicted_wait(b.doctors, b.appointments)


_CONFLICT_SQL = f"""SELECT doctor_id, appointment_date, time_slot, count(*) AS n FROM appointments
    WHERE status IN {OCC} GROUP BY doctor_id, appointment_date, time_slot"""


@query("a13_conflict_count", _CONFLICT_SQL)
def _(b):
    return scheduling.slot_conflicts(b.appointments)


@query("a14_billing_kpis", """
    SELECT CAST(sum(total_amount) AS DOUBLE) AS total_billed, CAST(sum(insurance_coverage) AS DOUBLE) AS total_insurance,
           CAST(sum(patient_payable) FILTER (status = 'Paid') AS DOUBLE) AS collected,
           count(*) FILTER (status = 'Pending') AS pending_bills
    FROM bills""")
def _(b):
    return reports.billing_kpis(b.bills)


@query("a15_bed_kpis", """
    SELECT count(*) AS total, count(*) FILTER (status = 'Available') AS available,
           count(*) FILTER (status = 'Occupied') AS occupied, count(*) FILTER (status = 'Maintenance') AS maintenance,
           CAST(floor(count(*) FILTER (status = 'Occupied') / count(*) * 100 + 0.5) AS BIGINT) AS occupancy_pct
    FROM beds""")
def _(b):
    return reports.bed_kpis(b.beds)


_WARD_SQL = """
    SELECT v.ward_name, w.ward_type, w.bed_count, v.bed_number, v.bed_id, v.status, v.patient_name
    FROM v_bed_occupancy v JOIN (SELECT ward_name, arg_min(bed_type, bed_number) AS ward_type, count(*) AS bed_count
                                 FROM beds GROUP BY ward_name) w ON v.ward_name = w.ward_name"""


@query("a16_ward_rollup", f"""
    SELECT *, place // 1024 AS list_place, CAST(place % 1024 AS BIGINT) AS list_index
    FROM (SELECT *, row_number() OVER (PARTITION BY ward_name ORDER BY bed_number, bed_id) - 1 AS place FROM ({_WARD_SQL}))""")
def _(b):
    rolled = reports.ward_rollup(views.bed_occupancy(b.tables))
    return rolled.select("ward_name", "ward_type", "bed_count", "list_place", F.posexplode("beds").alias("list_index", "bed")).select(
        "ward_name", "ward_type", "bed_count", "list_place", F.col("list_index").cast("long").alias("list_index"), "bed.*")


@query("a16_ward_beds", f"SELECT * EXCLUDE (bed_count) FROM ({_WARD_SQL})")
def _(b):
    return reports.ward_beds(views.bed_occupancy(b.tables), b.beds)


@query("a17_dashboard_headline", """
    SELECT (SELECT count(*) FROM patients) AS total_patients,
           (SELECT count(*) FROM doctors WHERE status = 'Active') AS total_doctors,
           (SELECT count(*) FROM appointments WHERE status = 'Scheduled') AS scheduled_appts,
           (SELECT count(*) FROM beds WHERE status = 'Available') AS available_beds,
           (SELECT count(*) FROM beds) AS total_beds,
           (SELECT CAST(round(coalesce(sum(total_amount), 0), 2) AS DOUBLE) FROM bills) AS total_revenue""")
def _(b):
    return dashboard.headline_counts(b.spark, b.tables)


@query("a17_dashboard_sections", f"""
    SELECT 'appt_by_status' AS section, status AS label, CAST(count(*) AS DOUBLE) AS value FROM appointments GROUP BY status
    UNION ALL SELECT 'dept_stats', dept_name, CAST(revenue AS DOUBLE) FROM v_dept_stats
    UNION ALL SELECT 'bed_by_type', bed_type, CAST(count(*) FILTER (status = 'Occupied') AS DOUBLE) FROM beds GROUP BY bed_type
    UNION ALL (SELECT 'recent_appts', CAST(appointment_id AS VARCHAR), CAST(fees AS DOUBLE) FROM v_appointment_details
               ORDER BY appointment_date DESC, time_slot DESC, appointment_id DESC LIMIT 8)
    UNION ALL SELECT 'wait_times', dept_name, avg_wait FROM ({_WAIT_SQL})""")
def _(b):
    """The list sections in one long table; each is its own lazy DataFrame in the bundle."""
    bundle = dashboard.dashboard(b.spark, b.tables)
    shape = {"appt_by_status": ("status", "cnt"), "dept_stats": ("dept_name", "revenue"),
             "bed_by_type": ("bed_type", "occupied"), "recent_appts": ("appointment_id", "fees"),
             "wait_times": ("dept_name", "avg_wait")}
    parts = [bundle[s].select(F.lit(s).alias("section"), F.col(label).cast("string").alias("label"),
                              F.col(value).cast("double").alias("value")) for s, (label, value) in shape.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_DOCUMENT = ("total_patients BIGINT, total_doctors BIGINT, scheduled_appts BIGINT, available_beds BIGINT, total_beds BIGINT, "
             "total_revenue DECIMAL(18,2), appt_by_status ARRAY<STRUCT<status: STRING, cnt: BIGINT>>, "
             "dept_stats ARRAY<STRUCT<dept_id: BIGINT, dept_name: STRING, location: STRING, doctor_count: BIGINT, "
             "total_appointments: BIGINT, revenue: DECIMAL(18,2), avg_wait: DOUBLE>>, "
             "bed_by_type ARRAY<STRUCT<bed_type: STRING, total: BIGINT, available: BIGINT, occupied: BIGINT, maintenance: BIGINT>>, "
             "recent_appts ARRAY<STRUCT<appointment_id: BIGINT, patient_name: STRING, patient_phone: STRING, doctor_name: STRING, "
             "dept_name: STRING, appointment_date: STRING, time_slot: STRING, status: STRING, fees: DECIMAL(18,2), "
             "symptoms: STRING, diagnosis: STRING, duration_minutes: INT>>, wait_times ARRAY<STRUCT<dept_name: STRING, avg_wait: DOUBLE>>")
_HEADLINE = """SELECT (SELECT count(*) FROM patients) AS total_patients,
    (SELECT count(*) FROM doctors WHERE status = 'Active') AS total_doctors,
    (SELECT count(*) FROM appointments WHERE status = 'Scheduled') AS scheduled_appts,
    (SELECT count(*) FROM beds WHERE status = 'Available') AS available_beds, (SELECT count(*) FROM beds) AS total_beds,
    (SELECT round(coalesce(sum(total_amount), 0), 2) FROM bills) AS total_revenue"""
#: Sections of the document: SQL and order of the rows, text columns, numeric columns.
_SECTIONS = {
    "headline": (_HEADLINE, "total_beds", "", "total_patients total_doctors scheduled_appts available_beds total_beds total_revenue"),
    "appt_by_status": ("SELECT status, count(*) AS cnt FROM appointments GROUP BY status", "status", "status", "cnt"),
    "dept_stats": ("SELECT * FROM v_dept_stats", "dept_id", "dept_name location",
                   "dept_id doctor_count total_appointments revenue avg_wait"),
    "bed_by_type": ("""SELECT bed_type, count(*) AS total, count(*) FILTER (status = 'Available') AS available,
        count(*) FILTER (status = 'Occupied') AS occupied, count(*) FILTER (status = 'Maintenance') AS maintenance
        FROM beds GROUP BY bed_type""", "bed_type", "bed_type", "total available occupied maintenance"),
    "recent_appts": ("SELECT * FROM v_appointment_details ORDER BY appointment_date DESC, time_slot DESC, appointment_id DESC LIMIT 8",
                     "appointment_date DESC, time_slot DESC, appointment_id DESC",
                     "patient_name patient_phone doctor_name dept_name appointment_date time_slot status symptoms diagnosis",
                     "appointment_id fees duration_minutes"),
    "wait_times": (_WAIT_SQL, "dept_name", "dept_name", "avg_wait"),
}


def _section_sql(name: str) -> str:
    rows, order, texts, numbers = _SECTIONS[name]
    cells = [f"SELECT place, '{c}' AS field, {c} AS text, CAST(NULL AS DOUBLE) AS number FROM x" for c in texts.split()]
    cells += [f"SELECT place, '{c}' AS field, CAST(NULL AS VARCHAR) AS text, CAST({c} AS DOUBLE) AS number FROM x" for c in numbers.split()]
    return (f"SELECT '{name}' AS section, place, field, text, number FROM (WITH x AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place "
            f"FROM ({rows})) {' UNION ALL '.join(cells)})")


@query("a17_dashboard_document", " UNION ALL ".join(map(_section_sql, _SECTIONS)))
def _(b):
    """The one-row document, read back: a row per section, place in the list and field."""
    stored = settle(dashboard.dashboard_document(b.spark, b.tables), "dashboard-document")
    d = stored.select(F.from_json("document", _DOCUMENT).alias("d")).select("d.*")
    parts = []
    for name, (_sql, _order, texts, numbers) in _SECTIONS.items():
        row = F.struct(*numbers.split()) if name == "headline" else F.col("row")
        rows = d.select(F.lit(0).alias("place"), row.alias("row")) if name == "headline" else d.select(F.posexplode(name).alias("place", "row"))
        cells = [F.struct(F.lit(c).alias("field"), F.col("row")[c].alias("text"), F.lit(None).cast("double").alias("number")) for c in texts.split()]
        cells += [F.struct(F.lit(c).alias("field"), F.lit(None).cast("string").alias("text"), F.col("row")[c].cast("double").alias("number")) for c in numbers.split()]
        parts.append(rows.select("place", F.explode(F.array(*cells)).alias("c")).select(F.lit(name).alias("section"), "place", "c.*"))
    return reduce(DataFrame.unionByName, parts)


# --- sorts, top-k --------------------------------------------------------------------

@query("s1_single_key", f"SELECT * EXCLUDE (salary), {money_columns('salary')} FROM v_doctor_dept ORDER BY doctor_id")
def _(b):
    return filters.doctor_list(views.doctor_dept(b.tables))


@query("s2_multi_key", f"""
    SELECT * EXCLUDE (hourly_rate), {money_columns('hourly_rate')} FROM v_bed_occupancy
    ORDER BY ward_name, bed_number""")
def _(b):
    return views.bed_occupancy(b.tables).orderBy("ward_name", "bed_number")


@query("s3_recent8", f"""
    SELECT {DETAILS} FROM v_appointment_details
    ORDER BY appointment_date DESC, time_slot DESC, appointment_id DESC LIMIT 8""")
def _(b):
    return views.recent_appointments(b.tables)


@query("s4_view_sample", f"SELECT {DETAILS} FROM v_appointment_details ORDER BY appointment_id LIMIT 5")
def _(b):
    return views.appointment_sample(b.tables)


@query("s4_scheduled_sample", """
    SELECT appointment_id, doctor_id, appointment_date, time_slot, status FROM appointments
    WHERE status = 'Scheduled' ORDER BY appointment_id LIMIT 5""")
def _(b):
    return reports.scheduled_sample(b.appointments)


@query("s5_audit_history", "SELECT * FROM audit_log ORDER BY timestamp DESC, log_id DESC")
def _(b):
    return reports.audit_history(b.audit_log)


# --- scalar functions -------------------------------------------------------------------

@query("f1_null_default", "SELECT patient_id, coalesce(email, '') AS email FROM patients")
def _(b):
    return b.patients.select("patient_id", fx.or_default("email", "").alias("email"))


@query("f2_round", "SELECT appointment_id, CAST(round(fees, 1) AS DOUBLE) AS fee1 FROM appointments")
def _(b):
    return b.appointments.select("appointment_id", fx.half_up("fees", 1).alias("fee1"))


@query("f3_money_round", """
    SELECT bill_id, CAST(round(total_amount * 0.70, 2) AS DOUBLE) AS share FROM bills""")
def _(b):
    return b.bills.select("bill_id", fx.coverage("total_amount", F.lit(True)).alias("share"))


@query("f4_js_round", "SELECT appointment_id, CAST(floor(fees + 0.5) AS BIGINT) AS whole_fee FROM appointments")
def _(b):
    return b.appointments.select("appointment_id", fx.js_round(F.col("fees").cast("double")).alias("whole_fee"))


@query("f5_searched_case", """
    SELECT appointment_id, CASE WHEN status = 'Completed' THEN wait_time_minutes END AS wait,
           CAST(CASE WHEN status = 'Completed' THEN fees ELSE 0 END AS DOUBLE) AS earned FROM appointments""")
def _(b):
    done = F.col("status") == "Completed"
    return b.appointments.select("appointment_id", F.when(done, F.col("wait_time_minutes")).alias("wait"),
                                 F.when(done, F.col("fees")).otherwise(0).alias("earned"))


@query("f6_cast_concat", """
    SELECT bed_id, 'Patient ID:' || coalesce(CAST(patient_id AS VARCHAR), '?') AS bed_label,
           ward_name || ' (ID:' || CAST(patient_id AS VARCHAR) || ')' AS ward_label FROM beds""")
def _(b):
    return b.beds.select("bed_id", audit.bed_label("patient_id").alias("bed_label"),
                         audit.patient_label("ward_name", "patient_id").alias("ward_label"))


@query("f7_like", f"SELECT bed_id, translate(bed_number, {_LOWER}) LIKE '%d-_____1%' AS hit FROM beds")
def _(b):
    return b.beds.select("bed_id", fx.like_any_case("bed_number", "D-_____1").alias("hit"))


@query("f8_arithmetic", """
    SELECT bill_id, CAST(bed_charges + consultation_fees + medicine_charges + test_charges AS DOUBLE) AS charges,
           CAST(total_amount - insurance_coverage AS DOUBLE) AS payable FROM bills""")
def _(b):
    charges = sum((F.col(c) for c in billing.CHARGES[1:]), F.col(billing.CHARGES[0]))
    return b.bills.select("bill_id", charges.alias("charges"),
                          (F.col("total_amount") - F.col("insurance_coverage")).alias("payable"))


@query("f9_stamp_text", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def _(b):
    return b.raw("events").select("event_id", fx.iso_date("ts").alias("day"), fx.iso_stamp("ts").alias("stamp"))


@query("f10_day_label", """
    SELECT appointment_id, strftime(CAST(appointment_date AS DATE), '%a, %b %d') AS label,
           CAST(CAST(appointment_date AS DATE) + 2 AS VARCHAR) AS in_two_days FROM appointments""")
def _(b):
    return b.appointments.select("appointment_id", fx.day_label("appointment_date").alias("label"),
                                 F.date_add("appointment_date", 2).cast("string").alias("in_two_days"))


@query("f11_display_ids", """
    SELECT appointment_id, printf('A%04d', appointment_id) AS appointment, printf('P%04d', patient_id) AS patient,
           printf('D%04d', doctor_id) AS doctor, printf('BED-%03d', appointment_id) AS bed FROM appointments""")
def _(b):
    return b.appointments.select(
        "appointment_id", fx.display_id("A", "appointment_id").alias("appointment"),
        fx.display_id("P", "patient_id").alias("patient"), fx.display_id("D", "doctor_id").alias("doctor"),
        fx.display_id("BED-", "appointment_id", 3).alias("bed"))


@query("f12_cell_text", """
    SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'NULL' WHEN length(text) > 80
                        THEN substring(text, 1, 80) || '...' ELSE text END AS cell FROM documents""")
def _(b):
    return b.raw("documents").select("doc_id", fx.cell_text("text").alias("cell"))


@query("f13_lower_contains", "SELECT bed_id, contains(lower(bed_type), 'dar') AS hit FROM beds")
def _(b):
    return b.beds.select("bed_id", F.lower("bed_type").contains("dar").alias("hit"))


@query("f14_indian_grouping", """
    SELECT bill_id, '₹' || CASE WHEN length(whole) <= 3 THEN whole ELSE
               ltrim(reverse(regexp_replace(reverse(whole[:-4]), '([0-9]{2})', '\\1,', 'g')), ',') || ',' || whole[-3:]
           END || CASE WHEN cents = '' THEN '' ELSE '.' || cents END AS total
    FROM (SELECT bill_id, split_part(CAST(total_amount AS VARCHAR), '.', 1) AS whole,
                 rtrim(split_part(CAST(total_amount AS VARCHAR), '.', 2), '0') AS cents FROM bills)""")
def _(b):
    return b.bills.select("bill_id", fx.rupees("total_amount").alias("total"))


@query("f15_flags_minutes", """
    SELECT appointment_id, CAST(wait_time_minutes AS BOOLEAN) AS has_wait,
           CASE WHEN wait_time_minutes <> 0 THEN wait_time_minutes || ' min' ELSE '--' END AS wait FROM appointments""")
def _(b):
    return b.appointments.select("appointment_id", F.col("wait_time_minutes").cast("boolean").alias("has_wait"),
                                 fx.minutes_text("wait_time_minutes").alias("wait"))


@query("f16_working_days", f"""
    SELECT d.doctor_id, strftime(c.day, '%Y-%m-%d') AS date, coalesce(v.start_time, '09:00') AS start_time,
           coalesce(v.end_time, '17:00') AS end_time
    FROM doctors d, (SELECT DATE '{AS_OF}' + CAST(i AS INTEGER) AS day FROM (SELECT unnest([0, 1, 2]) AS i)) c
    LEFT JOIN doctor_availability v ON v.doctor_id = d.doctor_id AND v.avail_date = strftime(c.day, '%Y-%m-%d')
    WHERE d.status = 'Active' AND coalesce(v.is_available, TRUE)""")
def _(b):
    days = scheduling.working_days(scheduling.availability_calendar(b.tables, AS_OF))
    return days.select("doctor_id", F.inline("availability")).select("doctor_id", "date", "start_time", "end_time")


@query("f17_badges", """
    SELECT avail_id, CASE WHEN NOT is_available THEN 'Leave' WHEN start_time <> '09:00' OR end_time <> '17:00'
                          THEN start_time || '-' || end_time ELSE 'Available' END AS badge FROM doctor_availability""")
def _(b):
    return b.doctor_availability.select(
        "avail_id", fx.availability_badge("is_available", "start_time", "end_time").alias("badge"))


# --- subqueries ---------------------------------------------------------------------------

@query("q1_salary_vs_avg", """
    SELECT doctor_id, name, CAST(salary AS DOUBLE) AS salary,
           round((SELECT sum(salary) / count(*) FROM doctors), 2) AS avg_salary,
           round(salary - (SELECT sum(salary) / count(*) FROM doctors), 2) AS diff_from_avg
    FROM doctors ORDER BY salary DESC, doctor_id LIMIT 5""")
def _(b):
    return reports.salary_against_mean(b.doctors)


@query("q2_above_mean_salary", """
    SELECT doctor_id, name, specialization, CAST(salary AS DOUBLE) AS salary FROM doctors
    WHERE salary > (SELECT sum(salary) / count(*) FROM doctors) ORDER BY salary DESC""")
def _(b):
    return reports.above_mean_salary(b.doctors)


@query("q3_above_avg_load", """
    SELECT d.doctor_id, d.name, dp.dept_name, c.cnt AS appt_count FROM doctors d
    JOIN departments dp ON d.dept_id = dp.dept_id
    JOIN (SELECT doctor_id, count(*) AS cnt FROM appointments GROUP BY doctor_id) c ON d.doctor_id = c.doctor_id
    WHERE c.cnt > (SELECT avg(n) FROM (SELECT count(*) AS n FROM appointments GROUP BY doctor_id))""")
def _(b):
    return reports.above_mean_load(b.tables)


@query("q4_exists_sql", """
    SELECT patient_id, name, phone FROM patients p
    WHERE EXISTS (SELECT 1 FROM bills b WHERE b.patient_id = p.patient_id)""")
def _(b):
    views.register_views(b.spark, b.tables)
    return b.spark.sql("SELECT patient_id, name, phone FROM patients p WHERE EXISTS "
                       "(SELECT 1 FROM (SELECT DISTINCT patient_id FROM bills) b WHERE b.patient_id = p.patient_id)")


# --- change sets ----------------------------------------------------------------------------

_NEW_PATIENTS_SQL = f"""
    SELECT request_seq, (SELECT max(patient_id) FROM patients) + row_number() OVER (ORDER BY request_seq) AS patient_id,
           name, age, gender, phone, '' AS email, '' AS blood_group, address, '{AS_OF}' AS registration_date,
           insurance_id, CAST(NULL AS VARCHAR) AS insurance_provider, 'Active' AS status
    FROM new_patients WHERE name IS NOT NULL AND gender IS NOT NULL"""


@query("u1_add_patients", _NEW_PATIENTS_SQL)
def _(b):
    return people.add_patients(b.tables, b.new_patients, AS_OF).accepted


@query("u1_explicit_nulls", _NEW_PATIENTS_SQL.replace("'' AS email", "CASE WHEN request_seq % 2 = 1 THEN '' END AS email").replace(
    "'' AS blood_group", "CASE WHEN request_seq % 3 > 0 THEN '' END AS blood_group"))
def _(b):
    """Requests that say which columns they give: a NULL they give is kept, one they leave out takes the default."""
    given = F.array_compact(F.array(F.when(F.col(SEQ) % 2 == 0, F.lit("email")), F.when(F.col(SEQ) % 3 == 0, F.lit("blood_group")), F.lit("name")))
    return people.add_patients(b.tables, b.new_patients.withColumn("given", given), AS_OF).accepted


@query("u1_add_uploads", f"""
    SELECT * FROM uploads UNION ALL
    SELECT (SELECT max(upload_id) FROM uploads) + row_number() OVER (ORDER BY request_seq), filename, original_name,
           file_type, '{AS_OF_STAMP}' FROM new_uploads WHERE original_name IS NOT NULL""")
def _(b):
    return people.add_uploads(b.tables, b.new_uploads, AS_OF_STAMP).tables["uploads"]


@query("u1_add_doctors", """
    SELECT x.request_seq, CASE WHEN a.request_seq IS NOT NULL THEN (SELECT max(doctor_id) FROM doctors)
               + row_number() OVER (PARTITION BY a.request_seq IS NULL ORDER BY x.request_seq) END AS doctor_id,
           CASE WHEN a.request_seq IS NOT NULL THEN phone END AS phone,
           CASE WHEN a.request_seq IS NOT NULL THEN email END AS email,
           CASE WHEN a.request_seq IS NOT NULL THEN 'accepted' ELSE coalesce(reason, 'unique') END AS outcome
    FROM u1_checked x LEFT JOIN u1_admitted a ON x.request_seq = a.request_seq""")
def _(b):
    done = people.add_doctors(b.tables, b.new_doctors, AS_OF)
    return done.accepted.select(SEQ, "doctor_id", "phone", "email", F.lit("accepted").alias("outcome")).unionByName(
        done.rejected.select(SEQ, F.col("reason").alias("outcome")), allowMissingColumns=True)


@query("u2_patch_patients", f"""
    SELECT p.patient_id, p.name, coalesce(n.age, p.age) AS age, p.gender, coalesce(n.phone, p.phone) AS phone, p.email,
           p.blood_group, coalesce(n.address, p.address) AS address, p.registration_date,
           CASE WHEN n.address IS NULL THEN p.insurance_id END AS insurance_id, p.insurance_provider,
           CASE WHEN n.age IS NULL THEN p.status ELSE 'Inactive' END AS status
    FROM patients p LEFT JOIN (
        SELECT id, arg_max(printf('7%09d', request_seq), request_seq) FILTER (kind = '1-URGENT') AS phone,
               'Lane ' || max(request_seq) FILTER (kind = '2-HIGH') AS address,
               20 + max(request_seq) FILTER (kind = '3-MEDIUM') % 50 AS age
        FROM u2_valid GROUP BY id) n ON p.patient_id = n.id""")
def _(b):
    return people.patch_patients(b.tables, b.patient_patches).tables["patients"]


@query("u2_patch_rejects", """
    SELECT x.request_seq, CASE WHEN p.patient_id IS NULL THEN 'not found' ELSE 'not null' END AS reason
    FROM patient_patches x LEFT JOIN patients p ON x.id = p.patient_id
    WHERE p.patient_id IS NULL OR kind = '5-LOW'""")
def _(b):
    return people.patch_patients(b.tables, b.patient_patches).rejected


@query("u2_toggle_doctors", f"""
    SELECT d.* EXCLUDE (status, salary), {money_columns('salary')}, coalesce(n.status, d.status) AS status
    FROM doctors d LEFT JOIN (SELECT id, arg_max(status, request_seq) AS status FROM doctor_patches GROUP BY id) n
      ON d.doctor_id = n.id""")
def _(b):
    return people.patch_doctor_status(b.tables, b.doctor_patches).tables["doctors"]


def _deletion(b: Bindings):
    return people.delete_patients(b.tables, b.patient_deletions, AS_OF_STAMP)


@query("u3_delete_patients", f"SELECT {PATIENT} FROM patients WHERE patient_id NOT IN (SELECT patient_id FROM u3_gone)")
def _(b):
    return _deletion(b).tables["patients"]


@query("u3_cascaded_appointments",
       f"SELECT {APPOINTMENT} FROM appointments WHERE patient_id NOT IN (SELECT patient_id FROM u3_gone)")
def _(b):
    return _deletion(b).tables["appointments"]


@query("u3_emptied_beds", "SELECT " + BED.replace(
    "patient_id,", "CASE WHEN patient_id NOT IN (SELECT patient_id FROM u3_gone) THEN patient_id END AS patient_id,")
    + " FROM beds")
def _(b):
    return _deletion(b).tables["beds"]


@query("u3_refused", """
    SELECT request_seq, CASE WHEN id IN (SELECT patient_id FROM u3_billed) AND id IN (SELECT patient_id FROM patients)
                             THEN 'has bills' ELSE 'not found' END AS reason
    FROM patient_deletions WHERE request_seq NOT IN (SELECT request_seq FROM u3_gone)""")
def _(b):
    return _deletion(b).rejected


@query("u4_upsert_availability", """
    SELECT CAST(coalesce(v.avail_id, (SELECT max(avail_id) FROM doctor_availability)
               + sum(CAST(v.avail_id IS NULL AS INTEGER)) OVER (ORDER BY n.first_seq NULLS LAST)) AS BIGINT) AS avail_id,
           coalesce(v.doctor_id, n.doctor_id) AS doctor_id, coalesce(v.avail_date, n.avail_date) AS avail_date,
           coalesce(n.l.start_time, v.start_time) AS start_time, coalesce(n.l.end_time, v.end_time) AS end_time,
           coalesce(n.l.is_available, v.is_available) AS is_available,
           CASE WHEN n.first_seq IS NULL THEN v.notes ELSE n.l.notes END AS notes
    FROM doctor_availability v FULL JOIN (
        SELECT doctor_id, avail_date, min(request_seq) AS first_seq,
               arg_max({'start_time': start_time, 'end_time': end_time, 'is_available': is_available, 'notes': notes},
                       request_seq) AS l
        FROM availability_upserts GROUP BY doctor_id, avail_date) n
      ON v.doctor_id = n.doctor_id AND v.avail_date = n.avail_date""")
def _(b):
    return rosters.upsert_availability(b.tables, b.availability_upserts).tables["doctor_availability"]


@query("u5_admit", "SELECT request_seq, coalesce(reason, 'accepted') AS outcome FROM u5_decided")
def _(b):
    done = booking.book_appointments(b.tables, b.admin_bookings, AS_OF_STAMP)
    return done.accepted.select(SEQ, F.lit("accepted").alias("outcome")).unionByName(
        done.rejected.select(SEQ, F.col("reason").alias("outcome")))


@query("u5_new_state", f"SELECT {APPOINTMENT} FROM appointments UNION ALL " + """
    SELECT appointment_id, patient_id, doctor_id, appointment_date, time_slot, status, symptoms, NULL, NULL,
           CAST(fees AS DOUBLE), wait_time_minutes, duration_minutes, created_at FROM u5_accepted""")
def _(b):
    return booking.book_appointments(b.tables, b.admin_bookings, AS_OF_STAMP).tables["appointments"]


@query("u6_admit_patient", "SELECT request_seq, coalesce(reason, 'accepted') AS outcome FROM u6_decided")
def _(b):
    done = booking.book_as_patient(b.tables, b.patient_bookings, AS_OF_STAMP)
    return done.accepted.select(SEQ, F.lit("accepted").alias("outcome")).unionByName(
        done.rejected.select(SEQ, F.col("reason").alias("outcome")))


@query("u6_bookings", "SELECT *, CAST(500 AS DOUBLE) AS fees, CAST(0 AS BIGINT) AS wait_time_minutes FROM u6_accepted")
def _(b):
    return booking.book_as_patient(b.tables, b.patient_bookings, AS_OF_STAMP).accepted.select(
        SEQ, "appointment_id", "patient_id", "doctor_id", "appointment_date", "time_slot", "fees", "wait_time_minutes")


@query("u6_registered_patients", f"SELECT {PATIENT} FROM patients UNION ALL " + f"""
    SELECT patient_id, name, age, gender, phone, NULL, NULL, NULL, '{AS_OF}', NULL, NULL, 'Active' FROM u6_new_patients""")
def _(b):
    return booking.book_as_patient(b.tables, b.patient_bookings, AS_OF_STAMP).tables["patients"]


@query("u7_change_status", f"""
    SELECT {APPOINTMENT} FROM (SELECT a.* REPLACE (coalesce(n.new_status, a.status) AS status)
    FROM appointments a LEFT JOIN u7_last n ON a.appointment_id = n.appointment_id)""")
def _(b):
    return booking.change_status(b.tables, b.status_changes, AS_OF_STAMP).tables["appointments"]


@query("u7_partition_rewrite", f"""
    SELECT {APPOINTMENT} FROM (SELECT a.* REPLACE (coalesce(n.new_status, a.status) AS status)
    FROM appointments a LEFT JOIN u7_last n ON a.appointment_id = n.appointment_id)""")
def _(b):
    """The status changes written back into the table by date, only the dates they touch."""
    path = scratch_path(b.spark, "appointments-rewritten")
    sinks.write_by_date(b.appointments, path, "appointment_date", "appointment_id")
    changes = settle(b.status_changes, "changes")
    sinks.rewrite_partitions(
        b.spark, path, b.appointments.schema, "appointment_date", "appointment_id", changes.select("appointment_id"),
        lambda rows: booking.change_status({"appointments": rows}, changes, AS_OF_STAMP).tables["appointments"])
    return b.spark.read.schema(b.appointments.schema).parquet(path).select(*b.appointments.columns)


@query("u8_accept", f"""
    SELECT {APPOINTMENT} FROM (SELECT a.* REPLACE (
        CASE WHEN n.d IS NULL THEN a.status ELSE 'Confirmed' END AS status,
        coalesce(n.d, a.duration_minutes) AS duration_minutes)
    FROM appointments a LEFT JOIN (SELECT appointment_id, arg_max(duration_minutes, request_seq) AS d
                                   FROM acceptances GROUP BY appointment_id) n ON a.appointment_id = n.appointment_id)""")
def _(b):
    return booking.accept_appointments(b.tables, b.acceptances, AS_OF_STAMP).tables["appointments"]


@query("u9_bed_assign", "SELECT request_seq, coalesce(reason, 'accepted') AS outcome FROM u9_decided")
def _(b):
    done = wards.assign_beds(b.tables, b.bed_assignments, AS_OF_STAMP)
    return done.accepted.select(SEQ, F.lit("accepted").alias("outcome")).unionByName(
        done.rejected.select(SEQ, F.col("reason").alias("outcome")))


@query("u9_new_state", f"""
    SELECT {BED} FROM (SELECT b.* REPLACE (
        CASE WHEN n.bed_id IS NULL THEN b.status ELSE 'Occupied' END AS status,
        CASE WHEN n.bed_id IS NULL THEN b.patient_id ELSE n.patient_id END AS patient_id,
        CASE WHEN n.bed_id IS NULL THEN b.admitted_date ELSE '{AS_OF_STAMP}' END AS admitted_date)
    FROM beds b LEFT JOIN (SELECT * FROM u9_decided WHERE reason IS NULL) n ON b.bed_id = n.bed_id)""")
def _(b):
    return wards.assign_beds(b.tables, b.bed_assignments, AS_OF_STAMP).tables["beds"]


@query("u10_release", f"""
    SELECT {BED} FROM (SELECT b.* REPLACE (
        CASE WHEN r.bed_id IS NULL THEN b.status ELSE 'Available' END AS status,
        CASE WHEN r.bed_id IS NULL THEN b.patient_id END AS patient_id,
        CASE WHEN r.bed_id IS NULL THEN b.admitted_date END AS admitted_date)
    FROM beds b LEFT JOIN (SELECT DISTINCT bed_id FROM bed_releases) r ON b.bed_id = r.bed_id)""")
def _(b):
    return wards.release_beds(b.tables, b.bed_releases).tables["beds"]


_BILLED_SQL = f"""
    SELECT request_seq, (SELECT max(bill_id) FROM bills) + row_number() OVER (ORDER BY request_seq) AS bill_id,
           patient_id, appointment_id, {money_columns('bed_charges', 'consultation_fees', 'medicine_charges',
                                                      'test_charges', 'total_amount')},
           CAST(cov AS DOUBLE) AS insurance_coverage, CAST(total_amount - cov AS DOUBLE) AS patient_payable,
           '{AS_OF}' AS bill_date, 'Pending' AS status
    FROM (SELECT *, CASE WHEN insured THEN CAST(round(CAST(total_amount AS DECIMAL(18,2)) * 0.70, 2) AS DECIMAL(18,2))
                         ELSE CAST(0 AS DECIMAL(18,2)) END AS cov
          FROM u11_decided WHERE reason IS NULL)"""


@query("u11_bills", _BILLED_SQL)
def _(b):
    return billing.generate_bills(b.tables, b.bill_requests, AS_OF).accepted


@query("u11_refused", "SELECT request_seq, reason FROM u11_decided WHERE reason IS NOT NULL")
def _(b):
    return billing.generate_bills(b.tables, b.bill_requests, AS_OF).rejected


@query("u12_pay", f"""
    SELECT {BILL} FROM (SELECT b.* REPLACE (CASE WHEN p.bill_id IS NULL THEN b.status ELSE 'Paid' END AS status)
    FROM bills b LEFT JOIN payments p ON b.bill_id = p.bill_id)""")
def _(b):
    return billing.pay_bills(b.tables, b.payments).tables["bills"]


@query("u12_partition_rewrite", f"""
    SELECT {BILL} FROM (SELECT b.* REPLACE (CASE WHEN p.bill_id IS NULL THEN b.status ELSE 'Paid' END AS status)
    FROM bills b LEFT JOIN payments p ON b.bill_id = p.bill_id)""")
def _(b):
    """The payments written back into the bills, kept by month; only the months they touch."""
    path = scratch_path(b.spark, "bills-rewritten")
    monthly = b.bills.withColumn("bill_month", F.substring("bill_date", 1, 7))
    sinks.write_by_date(monthly, path, "bill_month", "bill_id")
    payments = settle(b.payments, "payments")
    sinks.rewrite_partitions(b.spark, path, monthly.schema, "bill_month", "bill_id", payments.select("bill_id"),
                             lambda rows: billing.pay_bills({"bills": rows}, payments).tables["bills"])
    return b.spark.read.schema(monthly.schema).parquet(path).select(*b.bills.columns)


@query("u13_delete_availability", f"""
    SELECT {AVAIL} FROM doctor_availability WHERE avail_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(b):
    deletions = b.raw("orders").filter("o_orderstatus = 'P'").selectExpr("o_orderkey AS request_seq", "o_custkey AS id")
    return rosters.delete_by_key(b.doctor_availability, "avail_id", deletions).tables["table"]


@query("u13_delete_uploads", """
    SELECT * FROM uploads WHERE upload_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(b):
    deletions = b.raw("labels").filter("toxic = 1").selectExpr("doc_id AS request_seq", "doc_id AS id")
    return rosters.delete_by_key(b.uploads, "upload_id", deletions).tables["table"]


# --- audit ------------------------------------------------------------------------------------

_T1_SQL = f"""
    SELECT x.request_seq, 'appointments' AS table_name, x.appointment_id AS record_id, 'STATUS_CHANGE' AS action,
           coalesce(lag(x.status) OVER (PARTITION BY x.appointment_id ORDER BY x.request_seq), a.status) AS old_value,
           x.status AS new_value, {AUDIT}
    FROM status_changes x JOIN appointments a ON x.appointment_id = a.appointment_id"""
_T2_SQL = f"""
    SELECT request_seq, 'patients' AS table_name, patient_id AS record_id, 'DELETE' AS action,
           name || ' (ID:' || patient_id || ')' AS old_value, CAST(NULL AS VARCHAR) AS new_value, {AUDIT}
    FROM u3_gone"""
_T3_SQL = f"""
    SELECT request_seq, 'beds' AS table_name, bed_id AS record_id, 'BED_ASSIGNED' AS action,
           'Available' AS old_value, 'Patient ID:' || coalesce(CAST(patient_id AS VARCHAR), '?') AS new_value, {AUDIT}
    FROM u9_decided WHERE reason IS NULL"""


@query("t1_status_audit", _T1_SQL)
def _(b):
    return audit.status_audit(b.appointments, b.status_changes, AS_OF_STAMP)


@query("t2_delete_audit", _T2_SQL)
def _(b):
    return _deletion(b).audit


@query("t3_bed_audit", _T3_SQL)
def _(b):
    return wards.assign_beds(b.tables, b.bed_assignments, AS_OF_STAMP).audit


@query("t4_created_audit", f"""
    SELECT request_seq, 'appointments' AS table_name, appointment_id AS record_id, 'CREATED' AS action,
           CAST(NULL AS VARCHAR) AS old_value, 'P:' || patient_id || ' D:' || doctor_id AS new_value, {AUDIT}
    FROM u5_accepted""")
def _(b):
    return booking.book_appointments(b.tables, b.admin_bookings, AS_OF_STAMP).audit


@query("t4_user_booked_audit", f"""
    SELECT request_seq, 'appointments' AS table_name, appointment_id AS record_id, 'USER_BOOKED' AS action,
           CAST(NULL AS VARCHAR) AS old_value, 'Patient:' || patient_id AS new_value, {AUDIT}
    FROM u6_accepted""")
def _(b):
    return booking.book_as_patient(b.tables, b.patient_bookings, AS_OF_STAMP).audit


@query("t4_appended_log", f"""
    SELECT * FROM audit_log UNION ALL
    SELECT (SELECT max(log_id) FROM audit_log) + row_number() OVER (ORDER BY request_seq), table_name, record_id, action,
           old_value, new_value, timestamp, performed_by FROM ({_T1_SQL})""")
def _(b):
    return append_audit(b.audit_log, audit.status_audit(b.appointments, b.status_changes, AS_OF_STAMP))


_T5_SQL = f"""
    SELECT 'appointments' AS table_name, a.appointment_id AS record_id, 'STATUS_CHANGE' AS action,
           a.status AS old_value, n.new_status AS new_value, {AUDIT}
    FROM appointments a JOIN u7_last n ON a.appointment_id = n.appointment_id WHERE a.status <> n.new_status
    UNION ALL SELECT table_name, record_id, action, old_value, new_value, performed_by, timestamp FROM ({_T2_SQL})
    UNION ALL SELECT table_name, record_id, action, old_value, new_value, performed_by, timestamp FROM ({_T3_SQL})"""


def _after_batches(b: Bindings) -> dict[str, DataFrame]:
    """The audited tables after a batch of status changes, of deletions and of bed assignments."""
    return {"appointments": booking.change_status(b.tables, b.status_changes, AS_OF_STAMP).tables["appointments"],
            "patients": _deletion(b).tables["patients"],
            "beds": wards.assign_beds(b.tables, b.bed_assignments, AS_OF_STAMP).tables["beds"]}


@query("t5_snapshot_diff", _T5_SQL)
def _(b):
    return audit.snapshot_audit(b.tables, _after_batches(b), AS_OF_STAMP)


@query("t5_digest_diff", _T5_SQL)
def _(b):
    """The same from two stored versions, by their digests."""
    def stored(rows: dict[str, DataFrame], label: str):
        return {name: write_version(rows[name], scratch_path(b.spark, f"{name}-{label}"), KEYS[name],
                                    lambda table, block, name=name: audit.block_digests(table, block, KEYS[name], audit.AUDITED[name]))
                for name in audit.AUDITED}
    return audit.digest_audit(stored(b.tables, "before"), stored(_after_batches(b), "after"), AS_OF_STAMP)


# --- constraints --------------------------------------------------------------------------------

@query("c1_not_null", """
    SELECT 'patients.name' AS rule, CAST(request_seq AS VARCHAR) AS key FROM new_patients WHERE name IS NULL UNION ALL
    SELECT 'patients.gender', CAST(request_seq AS VARCHAR) FROM new_patients WHERE gender IS NULL""")
def _(b):
    """All tables, which hold no such rows, and the incoming patients, which do."""
    incoming = quality.nulls_in(b.new_patients, "patients", SEQ, ("name", "age", "gender", "phone"))
    return quality.not_null(b.tables).unionByName(incoming)


@query("c2_unique", """
    SELECT 'doctors.email' AS rule, email AS key FROM doctors WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
    UNION ALL SELECT 'doctors.phone', phone FROM doctors GROUP BY phone HAVING count(*) > 1
    UNION ALL SELECT 'departments.dept_name', dept_name FROM departments GROUP BY dept_name HAVING count(*) > 1
    UNION ALL SELECT 'beds.bed_number', bed_number FROM beds GROUP BY bed_number HAVING count(*) > 1
    UNION ALL SELECT 'doctor_availability.doctor_id,avail_date', doctor_id || ',' || avail_date
        FROM doctor_availability GROUP BY doctor_id, avail_date HAVING count(*) > 1""")
def _(b):
    return quality.duplicates(b.tables)


_ORPHANS = (("doctors", "doctor_id", "dept_id", "departments", "dept_id"),
            ("beds", "bed_id", "patient_id", "patients", "patient_id"),
            ("appointments", "appointment_id", "patient_id", "patients", "patient_id"),
            ("appointments", "appointment_id", "doctor_id", "doctors", "doctor_id"),
            ("bills", "bill_id", "patient_id", "patients", "patient_id"),
            ("bills", "bill_id", "appointment_id", "appointments", "appointment_id"),
            ("doctor_availability", "avail_id", "doctor_id", "doctors", "doctor_id"))


@query("c3_fk_orphans", " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS rule, CAST(x.{k} AS VARCHAR) AS key FROM {t} x "
    f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.{c})"
    for t, k, c, p, pk in _ORPHANS))
def _(b):
    return quality.orphans(b.tables)


@query("c4_double_bookings", f"""
    SELECT 'appointments.slot' AS rule, doctor_id || '|' || appointment_date || '|' || time_slot AS key
    FROM ({_CONFLICT_SQL}) WHERE n > 1""")
def _(b):
    return quality.double_bookings(b.appointments)


@query("c5_bed_consistency", """
    SELECT 'beds.occupied_without_patient' AS rule, CAST(bed_id AS VARCHAR) AS key
    FROM beds WHERE status = 'Occupied' AND patient_id IN (SELECT patient_id FROM u3_gone)""")
def _(b):
    """The beds as the patient deletions leave them."""
    return quality.bed_consistency(_deletion(b).tables["beds"])


@query("c6_bill_arithmetic", """
    SELECT 'bills.total' AS rule, CAST(bill_id AS VARCHAR) AS key FROM bills
    WHERE total_amount <> bed_charges + consultation_fees + medicine_charges + test_charges
    UNION ALL SELECT 'bills.payable', CAST(bill_id AS VARCHAR) FROM bills
    WHERE patient_payable <> total_amount - insurance_coverage""")
def _(b):
    return quality.bill_arithmetic(b.bills)


# --- streaming -------------------------------------------------------------------------------------

@query("st1_audit_stream", " UNION ALL ".join(
    f"SELECT request_seq AS event_seq, * EXCLUDE (request_seq) FROM ({sql})" for sql in (_T1_SQL, _T2_SQL, _T3_SQL)))
def _(b):
    """Write the changes of three batches as an event feed, among updates that no rule asks for; stream it, read the
    sink back."""
    source, sink = scratch_path(b.spark, "events"), scratch_path(b.spark, "audit")
    feed = [audit_stream.status_events(audit.status_audit(b.appointments, b.status_changes, AS_OF_STAMP)),
            audit_stream.delete_events(_deletion(b).accepted, AS_OF_STAMP),
            audit_stream.bed_events(wards.assign_beds(b.tables, b.bed_assignments, AS_OF_STAMP).accepted, AS_OF_STAMP),
            audit_stream.update_events(b.appointments, "appointments", "appointment_id", ["fees"], AS_OF_STAMP),
            audit_stream.update_events(b.patients, "patients", "patient_id", ["phone"], AS_OF_STAMP),
            audit_stream.update_events(b.beds.filter("status = 'Occupied'"), "beds", "bed_id", ["status"], AS_OF_STAMP)]
    for events in feed:
        sinks.append_rows(events, source)
    audit_stream.start_audit_stream(b.spark, source, sink).awaitTermination()
    return b.spark.read.parquet(sink)


_NUMBERED_SQL = " UNION ALL ".join(f"SELECT {k} AS feed, * FROM ({sql})" for k, sql in enumerate((_T1_SQL, _T2_SQL, _T3_SQL)))


@query("st1_numbered_log", f"""
    SELECT (SELECT max(log_id) FROM audit_log) + row_number() OVER (ORDER BY feed, request_seq) AS log_id,
           request_seq AS event_seq, * EXCLUDE (feed, request_seq) FROM ({_NUMBERED_SQL})""")
def _(b):
    """Three feeds arrive one after the other; the stream starts after each, goes on where it ended, and numbers its
    rows behind the log's."""
    source, log, checkpoint = (scratch_path(b.spark, label) for label in ("events", "numbered-log", "numbered-checkpoint"))
    last = b.audit_log.agg(F.coalesce(F.max("log_id"), F.lit(0))).first()[0]
    feeds = [lambda: audit_stream.status_events(audit.status_audit(b.appointments, b.status_changes, AS_OF_STAMP)),
             lambda: audit_stream.delete_events(_deletion(b).accepted, AS_OF_STAMP),
             lambda: audit_stream.bed_events(wards.assign_beds(b.tables, b.bed_assignments, AS_OF_STAMP).accepted, AS_OF_STAMP)]
    for feed in feeds:
        sinks.append_rows(feed(), source)
        audit_stream.start_numbered_log(b.spark, source, log, checkpoint, last).awaitTermination()
    return audit_stream.read_numbered(b.spark, log).drop("batch")
