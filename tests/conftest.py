import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardwright.schemas import CHANGE_SETS, SLOT_GRID, TABLES  # noqa: E402
from wardwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.sql.maxMetadataStringLength": "10000",
        "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def table(spark, name, rows):
    """Rows (dicts; missing columns are NULL) as a canonical table or change set."""
    ddl = TABLES.get(name) or CHANGE_SETS[name]
    columns = [part.split()[0] for part in ddl.replace("MAP<STRING,STRING>", "MAP").replace("(18,2)", "").split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ddl)


def rows_of(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()),
                  key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


@pytest.fixture(scope="session")
def make(spark):
    return lambda name, rows: table(spark, name, rows)


@pytest.fixture(scope="session")
def ward(spark):
    """Hand-made hospital with as_of = 2024-04-15; names are invented."""
    from decimal import Decimal
    salaries = [97, 121, 88, 143, 176, 102, 64, 152, 131, 79, 110, 93]
    depts = [2, 1, 4, 3, 6, 5, 8, 7, 3, 3, 1, 5]
    wards_ = [("Alder", "ICU", 3), ("Birch", "General", 7), ("Cedar", "Private", 4), ("Dogwood", "Semi-Private", 6),
              ("Elm", "General", 9), ("Fir", "ICU", 5), ("Ginkgo", "Private", 8)]
    held = {2: 4, 5: 1, 12: 9, 23: 2, 31: 7, 36: 12}
    beds, n = [], 0
    for name, kind, count in wards_:
        for _ in range(count):
            n += 1
            beds.append({"bed_id": n, "ward_name": name, "bed_number": f"BED-{n:03d}", "bed_type": kind,
                         "status": "Occupied" if n in held else "Maintenance" if n == 18 else "Available",
                         "patient_id": held.get(n), "hourly_rate": Decimal(100),
                         "admitted_date": "2024-04-10 08:00" if n in held else None})
    # Doctor, day in April, hours, at work, note: some doctors, on some days.
    hours = [(2, 15, "09:00", "16:30", True, ""), (2, 18, "09:00", "16:30", True, ""), (4, 15, "11:00", "15:30", True, "Lecture until eleven"),
             (4, 16, "09:00", "12:00", True, ""), (7, 17, "08:00", "20:00", True, "On call"), (8, 15, "09:00", "17:00", False, "Congress"),
             (8, 16, "09:00", "17:00", False, "Congress"), (8, 17, "13:00", "17:00", True, ""), (11, 16, "15:00", "16:30", True, "")]
    availability = [{"avail_id": 3 * k + 2, "doctor_id": doctor, "avail_date": f"2024-04-{day}", "start_time": start, "end_time": end,
                     "is_available": ok, "notes": note} for k, (doctor, day, start, end, ok, note) in enumerate(hours)]
    # Patient, doctor, day in March, place in the slot grid, status, fee, wait.
    visits = [(9, 4, 3, 5, "Completed", 640, 22), (9, 4, 19, 0, "Scheduled", 640, None), (2, 10, 4, 7, "Cancelled", 300, None),
              (14, 4, 4, 8, "Completed", 815, 7), (5, 1, 6, 1, "Completed", 450, 40), (11, 7, 6, 3, "No-Show", 380, None),
              (1, 12, 8, 2, "Confirmed", 520, None), (3, 7, 11, 10, "Completed", 990, 13), (3, 7, 25, 10, "Scheduled", 990, None),
              (8, 10, 12, 4, "Completed", 275, 31), (12, 2, 13, 6, "Cancelled", 610, None), (7, 9, 13, 6, "Confirmed", 705, None),
              (13, 4, 21, 11, "Scheduled", 560, None), (6, 5, 14, 9, "Completed", 430, 18), (15, 2, 28, 2, "Confirmed", 345, None),
              (4, 10, 16, 1, "No-Show", 285, None), (10, 11, 27, 8, "Scheduled", 770, None)]
    appointments = [{
        "appointment_id": 10 + 2 * k, "patient_id": patient, "doctor_id": doctor, "appointment_date": f"2024-03-{day:02d}",
        "time_slot": SLOT_GRID[place], "status": status, "fees": Decimal(fee), "wait_time_minutes": wait, "duration_minutes": 30,
        "created_at": "2024-02-27 16:20:00"} for k, (patient, doctor, day, place, status, fee, wait) in enumerate(visits)]
    rows = {
        "departments": [{"dept_id": i, "dept_name": f"Dept {i}", "location": f"Floor {i}", "capacity": 50}
                        for i in range(1, 9)],
        "doctors": [{"doctor_id": i + 1, "name": f"Dr. {chr(65 + i)}", "specialization": f"Spec {depts[i]}",
                     "dept_id": depts[i], "phone": f"555{i:04d}", "email": f"d{i}@example.org",
                     "hire_date": "2020-01-01", "salary": Decimal(salaries[i] * 1000), "status": "Active"}
                    for i in range(12)],
        "patients": [{"patient_id": i, "name": f"Patient {i}", "age": 20 + i, "gender": "Other", "phone": f"900{i:04d}",
                      "registration_date": "2024-01-01", "insurance_id": None if i in (2, 9, 13, 14) else f"INS{i:03d}",
                      "status": "Active"} for i in range(1, 16)],
        "beds": beds, "appointments": appointments, "doctor_availability": availability,
        "bills": [{"bill_id": 3, "patient_id": 5, "appointment_id": 18, "bed_charges": Decimal(0),
                   "consultation_fees": Decimal(450), "medicine_charges": Decimal(150), "test_charges": Decimal(0),
                   "total_amount": Decimal(600), "insurance_coverage": Decimal(420), "patient_payable": Decimal(180),
                   "bill_date": "2024-03-07", "status": "Paid"},
                  {"bill_id": 8, "patient_id": 9, "appointment_id": 10, "bed_charges": Decimal(0),
                   "consultation_fees": Decimal(640), "medicine_charges": Decimal(0), "test_charges": Decimal(260),
                   "total_amount": Decimal(900), "insurance_coverage": Decimal(0), "patient_payable": Decimal(900),
                   "bill_date": "2024-03-05", "status": "Pending"}],
        "audit_log": [], "uploads": [],
    }
    return {name: table(spark, name, r).cache() for name, r in rows.items()}
