"""Hand-checked results on the small hospital."""

from decimal import Decimal

from conftest import rows_of
from pyspark.sql import functions as F

from wardwright.operators import filters, quality, reports, scheduling
from wardwright.plans import dashboard, views

AS_OF = "2024-04-15"


def test_department_statistics(ward):
    stats = {r.dept_id: r for r in views.dept_stats(ward).collect()}
    assert [stats[i].total_appointments for i in range(1, 9)] == [3, 1, 8, 0, 1, 1, 0, 3]
    assert [stats[i].doctor_count for i in range(1, 9)] == [2, 1, 3, 1, 2, 1, 1, 1]
    # Completed: of department 3 two visits of doctor 4 and one of doctor 10; one each of doctors 1, 5 and 7.
    assert stats[3].revenue == 640 + 815 + 275 and stats[2].revenue == 450 and stats[8].revenue == 990 and stats[6].revenue == 430
    assert stats[3].avg_wait == 20.0 and stats[2].avg_wait == 40.0 and stats[1].avg_wait is None and stats[1].revenue == 0


def test_department_without_doctors_is_kept(ward, make):
    t = dict(ward, departments=ward["departments"].unionByName(
        make("departments", [{"dept_id": 9, "dept_name": "New", "location": "Attic"}])))
    row = views.dept_stats(t).filter("dept_id = 9").first()
    assert (row.doctor_count, row.total_appointments, row.revenue, row.avg_wait) == (0, 0, 0, None)
    assert "New" not in {r.dept_name for r in reports.department_report(t).collect()}


def test_bed_reports(ward):
    assert rows_of(reports.beds_by_type(ward["beds"])) == [
        ("General", 16, 14, 2, 0), ("ICU", 8, 6, 2, 0), ("Private", 12, 10, 2, 0), ("Semi-Private", 6, 5, 0, 1)]
    assert reports.bed_kpis(ward["beds"]).first()["occupancy_pct"] == 14
    assert reports.bed_kpis(ward["beds"].filter("false")).first()["occupancy_pct"] == 0


def test_ward_rollup_nests_in_order_and_splits_by_place(ward, make):
    occupancy = views.bed_occupancy(ward)
    whole = reports.ward_rollup(occupancy).collect()
    assert [r.ward_name for r in whole][:2] == ["Alder", "Birch"] and len(whole) == 7
    assert [b.bed_number for b in whole[0].beds] == ["BED-001", "BED-002", "BED-003"]
    assert whole[0].beds[1].patient_name == "Patient 4" and whole[0].ward_type == "ICU"
    split = reports.ward_rollup(occupancy, beds_per_row=3)
    assert split.agg(F.max(F.size("beds"))).first()[0] <= 3
    assert split.agg(F.sum(F.size("beds"))).first()[0] == 42
    elm = [[b.bed_number for b in r.beds] for r in split.filter("ward_name = 'Elm'").collect()]
    assert elm == [[f"BED-{n:03d}" for n in range(k, k + 3)] for k in (21, 24, 27)]
    # Ids far apart and in another order than the bed numbers: still one list, by bed number.
    odd = make("beds", [{"bed_id": 1, "ward_name": "X", "bed_number": "B-9", "bed_type": "ICU", "status": "Available"},
                        {"bed_id": 2000, "ward_name": "X", "bed_number": "B-1", "bed_type": "ICU", "status": "Available"}])
    listed = reports.ward_rollup(views.bed_occupancy(dict(ward, beds=odd))).collect()
    assert [[b.bed_id for b in r.beds] for r in listed] == [[2000, 1]]


def test_salary_reports(ward):
    top = reports.salary_against_mean(ward["doctors"]).collect()
    assert [r.diff_from_avg for r in top] == [Decimal(x) for x in (
        "63000.00", "39000.00", "30000.00", "18000.00", "8000.00")]
    assert {r.avg_salary for r in top} == {Decimal("113000.00")}
    above = [int(r.salary) for r in reports.above_mean_salary(ward["doctors"]).collect()]
    assert above == [176000, 152000, 143000, 131000, 121000]


def test_above_mean_load(ward):
    assert rows_of(reports.above_mean_load(ward), "doctor_id", "appt_count") == [(2, 2), (4, 4), (7, 3), (10, 3)]


def test_top_and_left_join_counts(ward):
    top = reports.top_completed(ward).collect()
    assert [(r.doctor_id, r.completed_appts) for r in top] == [(4, 2), (1, 1), (5, 1), (7, 1), (10, 1)]
    everyone = reports.appointments_per_doctor(ward).collect()
    assert [r.doctor for r in everyone] == sorted(r.doctor for r in everyone) and len(everyone) == 12


def test_orders(ward):
    details = views.appointment_details(ward)
    recent = [(r.appointment_date, r.time_slot) for r in views.recent_appointments(ward).collect()]
    assert recent == sorted(recent, reverse=True) and len(recent) == 8
    # Appointments whose patient is missing are not in the view: the next ones move up.
    lost = dict(ward, patients=ward["patients"].filter("patient_id != 15"))
    assert [r.appointment_id for r in views.recent_appointments(ward, 4).collect()] == [38, 42, 26, 34]
    assert [r.appointment_id for r in views.recent_appointments(lost, 3).collect()] == [42, 26, 34]
    assert [r.appointment_id for r in views.appointment_sample(ward, 3).collect()] == [10, 12, 14]
    assert views.recent_appointments(ward, 100).count() == 17
    pending = [r.appointment_date for r in filters.pending_queue(details).collect()]
    assert pending == ["2024-03-19", "2024-03-21", "2024-03-25", "2024-03-27"]
    assert [r.appointment_id for r in reports.scheduled_sample(ward["appointments"], 2).collect()] == [12, 26]
    assert [r.bill_id for r in reports.bill_list(ward).collect()] == [8, 3]
    assert [r.name for r in reports.patients_with_bills(ward).collect()] == ["Patient 5", "Patient 9"]


def test_money_totals(ward):
    k = reports.billing_kpis(ward["bills"]).first()
    assert (k.total_billed, k.total_insurance, k.collected, k.pending_bills) == (1500, 420, 180, 1)
    assert reports.total_revenue(ward["bills"].filter("false")).first()[0] == 0
    none = reports.billing_kpis(ward["bills"].filter("false")).first()
    assert (none.total_billed, none.collected, none.pending_bills) == (0, 0, 0)


def test_dashboard(spark, ward):
    bundle = dashboard.dashboard(spark, ward)
    assert tuple(bundle["headline"].first()) == (15, 12, 4, 35, 42, Decimal(1500))
    assert tuple(dashboard.headline_counts(spark, ward).first()) == (15, 12, 4, 35, 42, Decimal(1500))
    assert rows_of(bundle["appt_by_status"]) == [
        ("Cancelled", 2), ("Completed", 6), ("Confirmed", 3), ("No-Show", 2), ("Scheduled", 4)]
    waits = [r.avg_wait for r in bundle["wait_times"].collect()]
    assert waits == [40.0, 20.0, 18.0, 13.0]


def test_filters(ward):
    details = views.appointment_details(ward)
    assert filters.appointment_list(details).count() == 17
    assert filters.appointment_list(details, "Scheduled").count() == 4
    assert filters.appointment_list(details, "Cancelled", "2024-03-04").count() == 1
    assert filters.doctor_list(views.doctor_dept(ward), 1).count() == 2
    assert filters.doctor_list(views.doctor_dept(ward), 0).count() == 12
    assert filters.availability_between(ward["doctor_availability"], 8, "2024-04-16", "2024-04-17").count() == 2


def test_search(ward, make):
    found = filters.search_patients(ward["patients"], "pATIENT 1")
    assert [r.patient_id for r in found.collect()] == [15, 14, 13, 12, 11, 10, 1]
    assert filters.search_patients(ward["patients"]).first().patient_id == 15
    assert [r.patient_id for r in filters.search_patients(ward["patients"], "ins_12").collect()] == [12]
    assert filters.search_patients(ward["patients"], "ins12").count() == 0
    # Ids 13 and 14 have no insurance.
    assert [r.patient_id for r in filters.search_patients(ward["patients"], "INS_1%").collect()] == [15, 12, 11, 10]
    odd = make("patients", [{"patient_id": 1, "name": "Ädam", "phone": "1"}, {"patient_id": 2, "name": "a\\b", "phone": "2"},
                            {"patient_id": 3, "name": "axb", "phone": "3"}])
    assert filters.search_patients(odd, "ädam").count() == 0  # only A-Z fold
    assert [r.patient_id for r in filters.search_patients(odd, "A\\B").collect()] == [2]
    assert [r.patient_id for r in filters.search_patients_literal(odd, "a_b").collect()] == []
    assert [r.patient_id for r in filters.search_patients_literal(odd, "äDAM").collect()] == [1]


def test_open_slots(spark, ward):
    asked = spark.createDataFrame(
        [(8, "2024-04-16"), (4, "2024-04-16"), (11, "2024-04-16"), (6, "2024-04-15"), (4, "2024-03-04"), (10, "2024-03-12"), (7, "2024-03-06")],
        "doctor_id BIGINT, appointment_date STRING")
    free = scheduling.open_slots(asked, ward["appointments"], ward["doctor_availability"])
    slots = {}
    for r in free.collect():
        slots.setdefault((r.doctor_id, r.appointment_date), []).append(r.time_slot)
    assert (8, "2024-04-16") not in slots
    assert slots[4, "2024-04-16"] == ["09:00", "09:30", "10:00", "10:30", "11:00", "11:30"]
    assert slots[11, "2024-04-16"] == ["15:00", "15:30", "16:00"]
    assert len(slots[6, "2024-04-15"]) == 12
    assert len(slots[4, "2024-03-04"]) == 11 and "15:00" not in slots[4, "2024-03-04"]
    assert len(slots[10, "2024-03-12"]) == 11 and len(slots[7, "2024-03-06"]) == 12  # a no-show holds no slot


def test_calendar_and_matrix(ward):
    calendar = scheduling.availability_calendar(ward, AS_OF).collect()
    by_id = {r.doctor_id: r.availability for r in calendar}
    assert len(calendar) == 12 and all(len(a) == 3 for a in by_id.values())
    assert [r.doctor_id for r in calendar][:3] == [2, 11, 1]
    assert tuple(by_id[6][0]) == ("2024-04-15", "Mon, Apr 15", True, "09:00", "17:00", "Default schedule")
    assert not by_id[8][1].is_available and by_id[8][1].notes == "Congress"
    work = scheduling.working_days(scheduling.availability_calendar(ward, AS_OF)).filter("doctor_id = 8").first()
    assert [a.date for a in work.availability] == ["2024-04-17"]
    assert scheduling.availability_calendar(ward, AS_OF, dept=1).count() == 2
    matrix = {r.doctor_id: tuple(r)[3:] for r in scheduling.availability_matrix(ward, AS_OF).collect()}
    # The matrix covers doctors by day; a day without an entry is the default, and the 18th lies outside.
    assert matrix[8] == ("Leave", "Leave", "13:00-17:00") and matrix[6] == ("Default",) * 3
    assert matrix[4] == ("11:00-15:30", "09:00-12:00", "Default") and matrix[2] == ("09:00-16:30", "Default", "Default")


def test_inactive_doctors_are_not_offered(ward):
    t = dict(ward, doctors=ward["doctors"].withColumn("status", F.when(F.col("doctor_id") == 2, "Inactive").otherwise("Active")))
    assert [r.doctor_id for r in scheduling.availability_calendar(t, AS_OF, dept=1).collect()] == [11]


def test_predicted_wait(ward):
    waits = dict(rows_of(scheduling.predicted_wait(ward["doctors"], ward["appointments"])))
    assert waits[1] == 40 and waits[4] == 15 and waits[7] == 13 and waits[10] == 31 and waits[2] == 15  # 15 without history; (22 + 7) / 2 rounds up to it too


def test_quality_rules(ward, make):
    for rule in (quality.not_null, quality.duplicates, quality.orphans):
        assert rule(ward).count() == 0
    bad = dict(ward)
    bad["patients"] = make("patients", [{"patient_id": 1, "name": "x", "age": 1, "phone": "1"}])
    assert ("patients.gender", "1") in rows_of(quality.not_null(bad))
    assert ("patients.registration_date", "1") in rows_of(quality.not_null(bad))
    lost = rows_of(quality.orphans(bad))
    assert ("beds.patient_id", "2") in lost and ("appointments.patient_id", "10") in lost
    assert ("bills.patient_id", "8") in lost and ("appointments.patient_id", "22") not in lost and not any(r == "beds.patient_id" and k == "3" for r, k in lost)
    bad["doctors"] = make("doctors", [{"doctor_id": 1, "phone": None, "email": ""}, {"doctor_id": 2, "phone": None, "email": ""}])
    assert rows_of(quality.duplicates(bad)) == [("doctors.email", "")]
    beds = make("beds", [{"bed_id": 1, "status": "Occupied"}, {"bed_id": 2, "status": "Available", "patient_id": 4},
                         {"bed_id": 3, "status": "Occupied", "patient_id": 4}, {"bed_id": 4, "status": None}])
    assert rows_of(quality.bed_consistency(beds)) == [
        ("beds.occupied_without_patient", "1"), ("beds.patient_without_occupancy", "2")]
    bills = ward["bills"].withColumn("patient_payable", F.col("patient_payable") + (F.col("bill_id") == 8).cast("int"))
    assert rows_of(quality.bill_arithmetic(bills)) == [("bills.payable", "8")]
    assert quality.bill_arithmetic(ward["bills"]).count() == 0
    assert quality.double_bookings(ward["appointments"]).count() == 0
    doubled = ward["appointments"].unionByName(ward["appointments"].filter("appointment_id = 18"))
    assert rows_of(quality.double_bookings(doubled)) == [("appointments.slot", "1|2024-03-06|09:30")]
