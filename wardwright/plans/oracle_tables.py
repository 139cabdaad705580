"""The bindings as DuckDB common table expressions, for the side-by-side check."""

from __future__ import annotations

import re

from wardwright.schemas import SLOT_GRID
from wardwright.sources.bindings import AS_OF

GRID = "[" + ", ".join(f"'{s}'" for s in SLOT_GRID) + "]"
OCC = "('Scheduled', 'Confirmed', 'Completed')"
MONEY = "DECIMAL(18,2)"

CTES: dict[str, str] = {
    "departments": """
        SELECT CAST(n_nationkey AS BIGINT) AS dept_id, n_name AS dept_name, r_name AS location,
               CAST(50 AS BIGINT) AS capacity
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "doctors": f"""
        SELECT s_suppkey AS doctor_id, s_name AS name, 'SPEC-' || (s_suppkey % 5) AS specialization,
               CAST(s_nationkey AS BIGINT) AS dept_id, printf('8%09d', s_suppkey) AS phone,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 10 = 9 THEN ''
                    ELSE 'doctor' || s_suppkey || '@example.org' END AS email,
               CAST(DATE '2015-01-01' + CAST(s_suppkey % 3000 AS INTEGER) AS VARCHAR) AS hire_date,
               CAST(s_acctbal AS {MONEY}) AS salary,
               CASE WHEN s_suppkey % 10 = 0 THEN 'Inactive' ELSE 'Active' END AS status
        FROM supplier""",
    "patients": """
        SELECT c_custkey AS patient_id, c_name AS name, 18 + c_custkey % 70 AS age,
               ['Male', 'Female', 'Other'][c_custkey % 3 + 1] AS gender,
               printf('9%09d', c_custkey) AS phone,
               CASE WHEN c_custkey % 4 <> 0 THEN 'p' || c_custkey || '@example.org' END AS email,
               ['A+', 'B+', 'AB+', 'O-'][c_custkey % 4 + 1] AS blood_group,
               'Area ' || c_nationkey AS address, '2024-01-01' AS registration_date,
               CASE WHEN c_custkey % 5 <> 0 THEN 'INS' || c_custkey END AS insurance_id,
               c_mktsegment AS insurance_provider, 'Active' AS status
        FROM customer""",
    "beds": f"""
        SELECT p_partkey AS bed_id, p_brand AS ward_name, printf('BED-%08d', p_partkey) AS bed_number,
               p_type AS bed_type,
               CASE WHEN p_size % 10 = 0 THEN 'Maintenance' WHEN p_size % 10 <= 4 THEN 'Occupied'
                    ELSE 'Available' END AS status,
               CASE WHEN p_size % 10 BETWEEN 1 AND 4
                    THEN p_partkey % (SELECT count(*) FROM customer) END AS patient_id,
               CASE WHEN p_size % 10 BETWEEN 1 AND 4 THEN '2024-01-10 08:00' END AS admitted_date,
               CAST(p_retailprice AS {MONEY}) AS hourly_rate
        FROM part""",
    "slot_events": f"""
        SELECT e.*, CASE WHEN event_id % 2 = 0 THEN event_id % n
                         ELSE (event_id % n) * (event_id % n) % n END AS doctor_id,
               strftime(ts, '%Y-%m-%d') AS appointment_date, {GRID}[1 + hour(ts) % 12] AS time_slot
        FROM events e, (SELECT count(*) AS n FROM supplier)""",
    "appointments": f"""
        SELECT event_id AS appointment_id, user_id AS patient_id, doctor_id, appointment_date, time_slot,
               CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'click' THEN 'Scheduled'
                    WHEN 'view' THEN 'Confirmed' WHEN 'error' THEN 'Cancelled' ELSE 'No-Show' END AS status,
               CASE WHEN event_id % 4 <> 0 THEN 'complaint ' || event_type END AS symptoms,
               CASE WHEN event_type = 'purchase' THEN 'treated' END AS diagnosis,
               CAST(NULL AS VARCHAR) AS prescription, CAST(value AS {MONEY}) AS fees,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS wait_time_minutes,
               CAST(30 AS BIGINT) AS duration_minutes, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
        FROM slot_events""",
    "bills": f"""
        SELECT bill_id, patient_id, appointment_id, CAST(half AS {MONEY}) AS bed_charges,
               CAST(total_amount - half AS {MONEY}) AS consultation_fees, CAST(0 AS {MONEY}) AS medicine_charges,
               CAST(extra AS {MONEY}) AS test_charges, total_amount, cov AS insurance_coverage,
               CAST(total_amount - cov AS {MONEY}) AS patient_payable, bill_date, status
        FROM (SELECT o_orderkey AS bill_id,
                     o_custkey + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS patient_id,
                     CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey END AS appointment_id,
                     CAST(o_totalprice AS {MONEY}) AS total_amount,
                     CAST(floor(CAST(o_totalprice AS {MONEY}) / 2) AS {MONEY}) AS half,
                     CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 1 ELSE 0 END AS extra,
                     CASE WHEN (o_custkey + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) % 5 <> 0
                          THEN CAST(round(CAST(o_totalprice AS {MONEY}) * 0.70, 2) AS {MONEY})
                          ELSE CAST(0 AS {MONEY}) END AS cov,
                     strftime(o_orderdate, '%Y-%m-%d') AS bill_date,
                     CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Paid' END AS status
              FROM orders)""",
    "doctor_availability": f"""
        SELECT s_suppkey * 3 + d AS avail_id, s_suppkey AS doctor_id,
               CAST(DATE '{AS_OF}' + CAST(d + s_suppkey % 2 * 7 AS INTEGER) AS VARCHAR) AS avail_date,
               CASE WHEN s_suppkey % 8 = 0 THEN '10:00' ELSE '09:00' END AS start_time,
               CASE WHEN s_suppkey % 8 = 0 THEN '13:00' ELSE '17:00' END AS end_time,
               NOT (s_suppkey % 6 = 0 AND d = 1) AS is_available,
               CASE WHEN s_suppkey % 6 = 0 AND d = 1 THEN 'Leave' END AS notes
        FROM supplier, (SELECT unnest([0, 1, 2]) AS d)""",
    "audit_log": """
        SELECT appointment_id AS log_id, 'appointments' AS table_name, appointment_id AS record_id,
               'STATUS_CHANGE' AS action, 'Scheduled' AS old_value, status AS new_value,
               created_at AS timestamp, 'System' AS performed_by
        FROM appointments WHERE status <> 'Scheduled'""",
    "uploads": """
        SELECT doc_id AS upload_id, 'f' || doc_id || '.' || ext AS filename,
               source || '_' || doc_id || '.' || ext AS original_name, lower(ext) AS file_type,
               strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 500 AS BIGINT)),
                        '%Y-%m-%d %H:%M:%S') AS uploaded_at
        FROM (SELECT doc_id, source,
                     ['png', 'PDF', 'exe', 'txt', 'webp', 'docx', 'bin'][doc_id % 7 + 1] AS ext FROM documents)""",
    # Views
    "v_doctor_dept": """
        SELECT d.doctor_id, d.name, d.specialization, d.status, d.dept_id, dp.dept_name, dp.location, d.phone,
               d.salary
        FROM doctors d JOIN departments dp ON d.dept_id = dp.dept_id""",
    "v_appointment_details": """
        SELECT a.appointment_id, p.name AS patient_name, p.phone AS patient_phone, d.name AS doctor_name,
               dp.dept_name, a.appointment_date, a.time_slot, a.status, a.fees, a.symptoms, a.diagnosis,
               a.duration_minutes
        FROM appointments a JOIN patients p ON a.patient_id = p.patient_id
        JOIN doctors d ON a.doctor_id = d.doctor_id JOIN departments dp ON d.dept_id = dp.dept_id""",
    "v_bed_occupancy": """
        SELECT b.bed_id, b.ward_name, b.bed_number, b.bed_type, b.status, b.hourly_rate, p.name AS patient_name,
               b.admitted_date
        FROM beds b LEFT JOIN patients p ON b.patient_id = p.patient_id""",
    "v_dept_stats": """
        SELECT dp.dept_id, dp.dept_name, dp.location, count(DISTINCT d.doctor_id) AS doctor_count,
               count(DISTINCT a.appointment_id) AS total_appointments,
               coalesce(sum(CASE WHEN a.status = 'Completed' THEN a.fees END), 0) AS revenue,
               round(avg(CASE WHEN a.status = 'Completed' THEN a.wait_time_minutes END), 1) AS avg_wait
        FROM departments dp LEFT JOIN doctors d ON dp.dept_id = d.dept_id
        LEFT JOIN appointments a ON d.doctor_id = a.doctor_id
        GROUP BY dp.dept_id, dp.dept_name, dp.location""",
    # Change sets
    "admin_bookings": f"""
        SELECT event_id AS request_seq, CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id END AS patient_id,
               doctor_id, appointment_date, time_slot,
               CASE WHEN event_id % 3 = 0 THEN CAST(value AS {MONEY}) END AS fees
        FROM slot_events WHERE event_type = 'signup'""",
    "patient_bookings": """
        SELECT event_id AS request_seq, CASE WHEN event_id % 3 > 0 THEN 'Caller ' || user_id END AS name,
               18 + user_id % 70 AS age, 'Other' AS gender,
               printf('9%09d', CASE WHEN event_id % 4 = 0 THEN user_id // 4 + 1000000 ELSE user_id END) AS phone,
               doctor_id, appointment_date, time_slot
        FROM slot_events WHERE event_type = 'signup'""",
    "status_changes": """
        SELECT o_orderkey AS request_seq, o_custkey * 7 AS appointment_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Confirmed' WHEN '2-HIGH' THEN 'Completed'
                    WHEN '3-MEDIUM' THEN 'Cancelled' WHEN '5-LOW' THEN 'No-Show' ELSE 'Scheduled' END AS status
        FROM orders""",
    "acceptances": """
        SELECT o_orderkey AS request_seq, o_custkey * 7 AS appointment_id,
               15 + o_orderkey % 4 * 15 AS duration_minutes
        FROM orders WHERE o_orderstatus = 'O'""",
    "bed_assignments": """
        SELECT o_orderkey AS request_seq, o_orderkey % (SELECT count(*) + 50 FROM part) AS bed_id,
               CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN -1 ELSE o_custkey END AS patient_id
        FROM orders""",
    "bed_releases": """
        SELECT o_orderkey AS request_seq, o_custkey AS bed_id FROM orders WHERE o_orderstatus = 'F'""",
    "bill_requests": f"""
        SELECT l_orderkey AS request_seq,
               CASE WHEN o_custkey % 20 = 0 THEN -1 ELSE o_custkey END AS patient_id,
               CASE WHEN o_orderstatus = 'P' THEN l_orderkey END AS appointment_id,
               bed_charges, consultation_fees, medicine_charges, test_charges
        FROM (SELECT l_orderkey,
                     {", ".join(f"CAST(coalesce(sum(CAST(l_extendedprice AS {MONEY})) FILTER (l_linenumber % 4 = {k}), 0) AS {MONEY}) AS {c}"
                                for k, c in ((3, "bed_charges"), (0, "consultation_fees"), (1, "medicine_charges"), (2, "test_charges")))}
              FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey""",
    "payments": """
        SELECT o_orderkey AS request_seq, o_orderkey AS bill_id FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "availability_upserts": f"""
        SELECT o_orderkey AS request_seq, o_custkey % (SELECT count(*) FROM supplier) AS doctor_id,
               CAST(DATE '{AS_OF}' + CAST(o_orderkey % 5 AS INTEGER) AS VARCHAR) AS avail_date,
               CASE WHEN o_orderstatus = 'O' THEN '10:30' ELSE '09:00' END AS start_time,
               CASE WHEN o_orderstatus = 'P' THEN '15:00' ELSE '17:00' END AS end_time,
               o_orderpriority <> '1-URGENT' AS is_available,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Leave' ELSE '' END AS notes
        FROM orders""",
    "patient_patches": """
        SELECT o_orderkey AS request_seq, o_custkey * 2 AS id, o_orderpriority AS kind FROM orders""",
    "doctor_patches": """
        SELECT o_orderkey AS request_seq, o_custkey % (SELECT count(*) + 5 FROM supplier) AS id,
               CASE WHEN o_orderstatus = 'F' THEN 'Inactive' ELSE 'Active' END AS status
        FROM orders""",
    "patient_deletions": """
        SELECT c_custkey AS request_seq, c_custkey + CASE WHEN c_nationkey = 3 THEN 1000000000 ELSE 0 END AS id
        FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "new_patients": """
        SELECT event_id AS request_seq, CASE WHEN user_id % 10 <> 0 THEN 'Visitor ' || event_id END AS name,
               18 + event_id % 60 AS age, CASE WHEN user_id % 11 <> 0 THEN 'Female' END AS gender,
               printf('6%09d', user_id) AS phone, 'Area ' || user_id AS address,
               CASE WHEN event_id % 2 = 0 THEN 'INS' || event_id END AS insurance_id
        FROM events WHERE event_type = 'signup'""",
    "new_doctors": """
        SELECT c_custkey AS request_seq, CAST(CASE WHEN c_nationkey = 7 THEN 99 ELSE c_nationkey END AS BIGINT) AS dept_id,
               CASE WHEN c_custkey % 9 = 0 THEN printf('8%09d', c_custkey - c_custkey % 3)
                    ELSE printf('5%09d', c_custkey - c_custkey % 3) END AS phone,
               CASE WHEN c_custkey % 6 = 5 THEN '' ELSE 'a' || c_custkey // 4 || '@example.org' END AS email
        FROM customer""",
    "new_uploads": """
        SELECT page_id AS request_seq, 'page' || page_id || '.txt' AS filename,
               CASE WHEN page_id % 13 <> 0 THEN url END AS original_name, 'txt' AS file_type
        FROM pages""",
    # Intermediate results shared by several checks
    "booked": f"""
        SELECT DISTINCT doctor_id, appointment_date, time_slot, TRUE AS held
        FROM appointments WHERE status IN {OCC}""",
    # New doctors one by one: `k` numbers those that only the batch itself can refuse; the walk keeps the values taken.
    "u1_checked": """
        SELECT x.*, CASE WHEN EXISTS (SELECT 1 FROM doctors d WHERE d.phone = x.phone)
                           OR EXISTS (SELECT 1 FROM doctors d WHERE d.email = x.email) THEN 'unique'
                         WHEN NOT EXISTS (SELECT 1 FROM departments p WHERE p.dept_id = x.dept_id) THEN 'foreign key'
                    END AS reason
        FROM new_doctors x""",
    "u1_open": """
        SELECT request_seq, phone, email, row_number() OVER (ORDER BY request_seq) AS k FROM u1_checked WHERE reason IS NULL""",
    "u1_admitted": """
        WITH RECURSIVE walk AS (
            SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request_seq, FALSE AS let_in,
                   CAST([] AS VARCHAR[]) AS phones, CAST([] AS VARCHAR[]) AS emails
            UNION ALL
            SELECT k, request_seq, let_in, CASE WHEN let_in THEN list_append(phones, phone) ELSE phones END,
                   CASE WHEN let_in THEN list_append(emails, email) ELSE emails END
            FROM (SELECT o.*, w.phones, w.emails,
                         NOT list_contains(w.phones, o.phone) AND NOT list_contains(w.emails, o.email) AS let_in
                  FROM walk w JOIN u1_open o ON o.k = w.k + 1))
        SELECT request_seq FROM walk WHERE let_in""",
    "u5_decided": """
        SELECT q.*, CASE WHEN held OR request_seq > winner THEN 'slot taken'
                         WHEN NOT valid THEN 'foreign key' END AS reason
        FROM (SELECT r.*, b.held, valid,
                     min(CASE WHEN valid THEN request_seq END)
                         OVER (PARTITION BY r.doctor_id, r.appointment_date, r.time_slot) AS winner
              FROM (SELECT x.*, p.patient_id IS NOT NULL AND d.doctor_id IS NOT NULL AS valid
                    FROM admin_bookings x LEFT JOIN patients p ON x.patient_id = p.patient_id
                    LEFT JOIN doctors d ON x.doctor_id = d.doctor_id) r
              LEFT JOIN booked b USING (doctor_id, appointment_date, time_slot)) q""",
    "predicted": """
        SELECT d.doctor_id, CAST(coalesce(round(avg(a.wait_time_minutes)), 15) AS BIGINT) AS predicted_wait
        FROM doctors d LEFT JOIN appointments a ON a.doctor_id = d.doctor_id AND a.status = 'Completed'
        GROUP BY d.doctor_id""",
    "u5_accepted": f"""
        SELECT request_seq,
               (SELECT max(appointment_id) FROM appointments) + row_number() OVER (ORDER BY request_seq)
                   AS appointment_id,
               patient_id, u.doctor_id, appointment_date, time_slot, 'Scheduled' AS status, '' AS symptoms,
               coalesce(fees, 500) AS fees, predicted_wait AS wait_time_minutes,
               CAST(30 AS BIGINT) AS duration_minutes, '{AS_OF} 08:00:00' AS created_at
        FROM u5_decided u JOIN predicted w ON u.doctor_id = w.doctor_id WHERE reason IS NULL""",
    "u6_checked": """
        SELECT x.*, d.doctor_id IS NOT NULL AS valid, coalesce(b.held, FALSE) AS held, p.phone IS NOT NULL AS on_file,
               CASE WHEN v.is_available IS NULL THEN 'open' WHEN NOT v.is_available THEN 'leave'
                    WHEN NOT (x.time_slot >= v.start_time AND x.time_slot < v.end_time)
                    THEN 'outside hours' ELSE 'open' END AS verdict
        FROM patient_bookings x LEFT JOIN doctors d ON x.doctor_id = d.doctor_id
        LEFT JOIN doctor_availability v ON v.doctor_id = x.doctor_id AND v.avail_date = x.appointment_date
        LEFT JOIN (SELECT DISTINCT phone FROM patients) p ON p.phone = x.phone
        LEFT JOIN booked b ON b.doctor_id = x.doctor_id AND b.appointment_date = x.appointment_date
                          AND b.time_slot = x.time_slot""",
    "u6_open": """
        SELECT request_seq, phone, doctor_id || '|' || appointment_date || '|' || time_slot AS slot, on_file,
               name IS NOT NULL AS details, row_number() OVER (ORDER BY request_seq) AS k
        FROM u6_checked WHERE verdict = 'open' AND valid AND NOT held""",
    "u6_winners": """
        WITH RECURSIVE walk AS (
            SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request_seq, CAST(NULL AS VARCHAR) AS phone,
                   CAST(NULL AS VARCHAR) AS slot, FALSE AS wins, FALSE AS registers, CAST([] AS VARCHAR[]) AS slots,
                   CAST([] AS VARCHAR[]) AS phones
            UNION ALL
            SELECT k, request_seq, phone, slot, wins, wins AND NOT on_file,
                   CASE WHEN wins THEN list_append(slots, slot) ELSE slots END,
                   CASE WHEN wins AND NOT on_file THEN list_append(phones, phone) ELSE phones END
            FROM (SELECT o.*, w.slots, w.phones, NOT list_contains(w.slots, o.slot)
                         AND (o.on_file OR o.details OR list_contains(w.phones, o.phone)) AS wins
                  FROM walk w JOIN u6_open o ON o.k = w.k + 1))
        SELECT request_seq, phone, slot, registers FROM walk WHERE wins""",
    "u6_decided": """
        SELECT x.*, CASE WHEN verdict <> 'open' THEN verdict
                         WHEN held OR x.request_seq > w.request_seq THEN 'slot taken'
                         WHEN NOT (on_file OR name IS NOT NULL OR coalesce(g.at < x.request_seq, FALSE)) THEN 'not null'
                         WHEN NOT valid THEN 'foreign key' END AS reason
        FROM u6_checked x
        LEFT JOIN u6_winners w ON w.slot = x.doctor_id || '|' || x.appointment_date || '|' || x.time_slot
        LEFT JOIN (SELECT phone, min(request_seq) AS at FROM u6_winners WHERE registers GROUP BY phone) g
          ON g.phone = x.phone""",
    "u6_new_patients": """
        SELECT (SELECT max(patient_id) FROM patients) + row_number() OVER (ORDER BY request_seq) AS patient_id,
               name, age, gender, phone
        FROM (SELECT u.*, row_number() OVER (PARTITION BY phone ORDER BY request_seq) AS k
              FROM u6_decided u WHERE reason IS NULL AND phone NOT IN (SELECT phone FROM patients))
        WHERE k = 1""",
    "u6_accepted": """
        SELECT request_seq,
               (SELECT max(appointment_id) FROM appointments) + row_number() OVER (ORDER BY request_seq)
                   AS appointment_id,
               p.patient_id, doctor_id, appointment_date, time_slot
        FROM u6_decided u
        JOIN (SELECT phone, min(patient_id) AS patient_id FROM patients GROUP BY phone
              UNION ALL SELECT phone, patient_id FROM u6_new_patients) p ON u.phone = p.phone
        WHERE reason IS NULL""",
    "u9_decided": """
        SELECT q.*, CASE WHEN free IS NULL OR request_seq > winner THEN 'bed not available'
                         WHEN NOT valid THEN 'foreign key' END AS reason
        FROM (SELECT r.*, min(CASE WHEN valid THEN request_seq END) OVER (PARTITION BY r.bed_id) AS winner
              FROM (SELECT x.*, x.patient_id IS NULL OR p.patient_id IS NOT NULL AS valid, b.free
                    FROM bed_assignments x LEFT JOIN patients p ON x.patient_id = p.patient_id
                    LEFT JOIN (SELECT bed_id, TRUE AS free FROM beds WHERE status = 'Available') b
                      ON b.bed_id = x.bed_id) r) q""",
    "u11_decided": f"""
        SELECT x.*, bed_charges + consultation_fees + medicine_charges + test_charges AS total_amount,
               coalesce(p.insurance_id, 'NONE') <> 'NONE' AS insured,
               CASE WHEN p.patient_id IS NULL THEN 'unknown patient'
                    WHEN x.appointment_id IS NOT NULL AND a.appointment_id IS NULL THEN 'foreign key' END AS reason
        FROM bill_requests x LEFT JOIN patients p ON x.patient_id = p.patient_id
        LEFT JOIN appointments a ON x.appointment_id = a.appointment_id""",
    "u3_billed": """
        SELECT patient_id FROM bills
        UNION SELECT a.patient_id FROM appointments a JOIN bills b ON a.appointment_id = b.appointment_id""",
    "u3_gone": """
        SELECT min(x.request_seq) AS request_seq, p.patient_id, p.name
        FROM patient_deletions x JOIN patients p ON x.id = p.patient_id
        WHERE p.patient_id NOT IN (SELECT patient_id FROM u3_billed)
        GROUP BY p.patient_id, p.name""",
    "u2_valid": """
        SELECT x.* FROM patient_patches x JOIN patients p ON x.id = p.patient_id WHERE kind <> '5-LOW'""",
    "u7_last": """
        SELECT appointment_id, arg_max(status, request_seq) AS new_status FROM status_changes GROUP BY appointment_id""",
}

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def with_tables(body: str) -> str:
    """Put the table expressions that `body` needs, directly or not, in front of it."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in CTES and word not in needed:
                visit(CTES[word])
                needed[word] = None

    visit(body)
    if not needed:
        return body.strip()
    head = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in needed)
    return f"WITH {head}\n{body.strip()}"
