"""Set-wise change sets against a plain one-by-one replay of the same requests."""

import random
from decimal import Decimal

import pytest
from conftest import rows_of

from wardwright.operators import audit, billing, booking, people, rosters, wards
from wardwright.operators.changes import append_audit
from wardwright.schemas import PATCHABLE_PATIENT_COLUMNS

STAMP = "2024-04-15 08:00:00"
HOLDING = {"Scheduled", "Confirmed", "Completed"}
SEEDS = range(4)


def world(make, rng):
    """A small hospital dense enough for requests to collide; sparse sequence numbers."""
    doctors = [{"doctor_id": d, "name": f"D{d}", "specialization": "s", "dept_id": 1, "phone": f"5{d}",
                "email": f"d{d}@x", "hire_date": "2020-01-01", "salary": Decimal(1), "status": "Active"}
               for d in (1, 2, 3)]
    patients = [{"patient_id": p, "name": f"P{p}", "age": 30, "gender": "Other", "phone": f"9{p % 5}",
                 "registration_date": "2024-01-01", "status": "Active",
                 "insurance_id": rng.choice([None, "", "NONE", f"I{p}"])} for p in range(1, 9)]
    appointments = [{"appointment_id": i * 3, "patient_id": rng.randint(1, 8), "doctor_id": rng.randint(1, 3),
                     "appointment_date": "2024-05-0%d" % rng.randint(1, 2), "time_slot": rng.choice(["09:00", "14:00"]),
                     "status": rng.choice(["Scheduled", "Confirmed", "Completed", "Cancelled", "No-Show"]),
                     "fees": Decimal(10), "wait_time_minutes": rng.choice([None, 5, 8, 20]), "duration_minutes": 30,
                     "created_at": STAMP} for i in range(1, rng.randint(3, 9))]
    availability = [{"avail_id": d * 10, "doctor_id": d, "avail_date": "2024-05-01",
                     "start_time": rng.choice(["09:00", "10:00"]), "end_time": rng.choice(["14:00", "17:00"]),
                     "is_available": rng.random() < 0.8, "notes": None} for d in (1, 2)]
    beds = [{"bed_id": b, "ward_name": "w", "bed_number": f"B{b}", "bed_type": "t", "hourly_rate": Decimal(1),
             "status": rng.choice(["Available", "Available", "Occupied", "Maintenance", None]),
             "patient_id": rng.choice([None, rng.randint(1, 8)])} for b in range(1, 8)]
    bills = [{"bill_id": 5, "patient_id": rng.randint(1, 8), "appointment_id": rng.choice([None, 3, 6]),
              "bill_date": "2024-01-01", "status": "Pending", "total_amount": Decimal(1)}]
    departments = [{"dept_id": 1, "dept_name": "One", "location": "x"}, {"dept_id": 2, "dept_name": "Two", "location": "x"}]
    data = {"departments": departments, "doctors": doctors, "patients": patients, "appointments": appointments,
            "doctor_availability": availability, "beds": beds, "bills": bills}
    return data, {name: make(name, rows) for name, rows in data.items()}


def seqs(rng, n):
    return rng.sample(range(1, 1 << 40), n)


def outcome(done, *columns):
    return {r.request_seq: tuple(r[c] for c in columns) for r in done.accepted.collect()}, \
           {r.request_seq: r.reason for r in done.rejected.collect()}


@pytest.mark.parametrize("seed", SEEDS)
def test_staff_bookings(make, seed):
    rng = random.Random(seed)
    data, t = world(make, rng)
    requests = [{"request_seq": s, "patient_id": rng.choice([1, 2, 3, 99, None]), "doctor_id": rng.choice([1, 2, 2, 3, 77]),
                 "appointment_date": rng.choice(["2024-05-01", "2024-05-02"]),
                 "time_slot": rng.choice(["09:00", "14:00", "16:00", None]), "fees": rng.choice([None, Decimal("9.50")])}
                for s in seqs(rng, 40)]
    taken = {(a["doctor_id"], a["appointment_date"], a["time_slot"]) for a in data["appointments"] if a["status"] in HOLDING}
    next_id = max(a["appointment_id"] for a in data["appointments"]) + 1
    accepted, rejected = {}, {}
    for r in sorted(requests, key=lambda r: r["request_seq"]):
        key = (r["doctor_id"], r["appointment_date"], r["time_slot"])
        if key in taken:
            rejected[r["request_seq"]] = "slot taken"
        elif r["patient_id"] is None or r["time_slot"] is None:
            rejected[r["request_seq"]] = "not null"
        elif r["patient_id"] == 99 or r["doctor_id"] == 77:
            rejected[r["request_seq"]] = "foreign key"
        else:
            waits = [a["wait_time_minutes"] for a in data["appointments"] if a["doctor_id"] == r["doctor_id"]
                     and a["status"] == "Completed" and a["wait_time_minutes"] is not None]
            wait = int(sum(waits) / len(waits) + 0.5) if waits else 15
            accepted[r["request_seq"]] = (next_id, r["patient_id"], wait, r["fees"] or Decimal(500))
            next_id += 1
            taken.add(key)
    done = booking.book_appointments(t, make("admin_bookings", requests), STAMP)
    assert outcome(done, "appointment_id", "patient_id", "wait_time_minutes", "fees") == (accepted, rejected)
    assert done.tables["appointments"].count() == len(data["appointments"]) + len(accepted)
    trail = {r.request_seq: (r.record_id, r.action, r.new_value) for r in done.audit.collect()}
    doctor = {r["request_seq"]: r["doctor_id"] for r in requests}
    assert trail == {s: (a[0], "CREATED", f"P:{a[1]} D:{doctor[s]}") for s, a in accepted.items()}


@pytest.mark.parametrize("seed", SEEDS)
def test_patient_bookings(make, seed):
    rng = random.Random(100 + seed)
    data, t = world(make, rng)
    requests = [{"request_seq": s, "name": f"N{s}" if rng.random() < 0.6 else None, "age": 40, "gender": "Other",
                 "phone": rng.choice(["90", "91", "71", "72", "73", None]), "doctor_id": rng.choice([1, 2, 3, 3, 77]), "appointment_date": rng.choice(["2024-05-01", "2024-05-02", "2024-05-03"]),
                 "time_slot": rng.choice(["09:00", "13:30", "14:00", "17:00"])} for s in seqs(rng, 40)]
    taken = {(a["doctor_id"], a["appointment_date"], a["time_slot"]) for a in data["appointments"] if a["status"] in HOLDING}
    hours = {(v["doctor_id"], v["avail_date"]): v for v in data["doctor_availability"]}
    phones = {}
    for p in data["patients"]:
        phones.setdefault(p["phone"], p["patient_id"])
    next_id = max(a["appointment_id"] for a in data["appointments"]) + 1
    next_patient, accepted, rejected, registered = 9, {}, {}, []
    for r in sorted(requests, key=lambda r: r["request_seq"]):
        s, v = r["request_seq"], hours.get((r["doctor_id"], r["appointment_date"]))
        key = (r["doctor_id"], r["appointment_date"], r["time_slot"])
        if v and not v["is_available"]:
            rejected[s] = "leave"
        elif v and not v["start_time"] <= r["time_slot"] < v["end_time"]:
            rejected[s] = "outside hours"
        elif key in taken:
            rejected[s] = "slot taken"
        elif r["phone"] not in phones and None in (r["name"], r["phone"]):
            rejected[s] = "not null"
        elif r["doctor_id"] == 77:
            rejected[s] = "foreign key"
        else:
            if r["phone"] not in phones:
                phones[r["phone"]] = next_patient
                registered.append((next_patient, r["name"], r["phone"]))
                next_patient += 1
            accepted[s] = (next_id, phones[r["phone"]], 0, Decimal(500))
            next_id += 1
            taken.add(key)
    done = booking.book_as_patient(t, make("patient_bookings", requests), STAMP)
    assert outcome(done, "appointment_id", "patient_id", "wait_time_minutes", "fees") == (accepted, rejected)
    assert rows_of(done.extra["new_patients"], "patient_id", "name", "phone") == sorted(registered)
    assert done.tables["patients"].count() == 8 + len(registered)


def test_patient_booking_without_details(make):
    data, t = world(make, random.Random(1))
    base = {"doctor_id": 3, "appointment_date": "2024-06-01"}
    requests = [dict(base, request_seq=1, phone="90", time_slot="09:00"),
                dict(base, request_seq=2, phone="700", time_slot="09:30"),
                dict(base, request_seq=3, phone=None, name="x", age=1, gender="Other", time_slot="09:30"),
                dict(base, request_seq=4, phone="700", name="x", age=1, gender="Other", time_slot="09:30")]
    done = booking.book_as_patient(t, make("patient_bookings", requests), STAMP)
    accepted, rejected = outcome(done, "patient_id")
    assert rejected == {2: "not null", 3: "not null"} and accepted[1] == (5,) and accepted[4] == (9,)


def test_callers_known_since_an_earlier_request(make):
    """Whether each caller is on file hangs on the one before: 3 takes the slot of 4, so 5 stays unknown, so 6 gets
    its slot and registers 7."""
    data, t = world(make, random.Random(1))
    full = {"name": "x", "age": 1, "gender": "Other"}
    calls = [("700", "09:00", full), ("800", "09:00", full), ("700", "09:30", {}), ("800", "09:30", full),
             ("800", "10:00", {}), ("900", "10:00", full), ("900", "10:30", {})]
    requests = [dict(more, request_seq=k, phone=phone, time_slot=slot, doctor_id=3, appointment_date="2024-06-01")
                for k, (phone, slot, more) in enumerate(calls, 1)]
    done = booking.book_as_patient(t, make("patient_bookings", requests), STAMP)
    accepted, rejected = outcome(done, "patient_id")
    assert rejected == {2: "slot taken", 4: "slot taken", 5: "not null"}
    assert accepted == {1: (9,), 3: (9,), 6: (10,), 7: (10,)}


@pytest.mark.parametrize("seed", SEEDS)
def test_bed_assignments(make, seed):
    rng = random.Random(200 + seed)
    data, t = world(make, rng)
    requests = [{"request_seq": s, "bed_id": rng.randint(1, 9), "patient_id": rng.choice([None, 1, 2, 99])} for s in seqs(rng, 30)]
    beds = {b["bed_id"]: (b["status"], b["patient_id"]) for b in data["beds"]}
    trail, rejected = {}, {}
    for r in sorted(requests, key=lambda r: r["request_seq"]):
        if beds.get(r["bed_id"], ("?",))[0] != "Available":
            rejected[r["request_seq"]] = "bed not available"
        elif r["patient_id"] == 99:
            rejected[r["request_seq"]] = "foreign key"
        else:
            beds[r["bed_id"]] = ("Occupied", r["patient_id"])
            who = "?" if r["patient_id"] is None else r["patient_id"]
            trail[r["request_seq"]] = (r["bed_id"], "Available", f"Patient ID:{who}")
    done = wards.assign_beds(t, make("bed_assignments", requests), STAMP)
    assert {r.bed_id: (r.status, r.patient_id) for r in done.tables["beds"].collect()} == beds
    assert outcome(done)[1] == rejected
    assert {r.request_seq: (r.record_id, r.old_value, r.new_value) for r in done.audit.collect()} == trail


@pytest.mark.parametrize("seed", SEEDS)
def test_availability_upserts(make, seed):
    rng = random.Random(300 + seed)
    data, t = world(make, rng)
    records = [{"request_seq": s, "doctor_id": rng.randint(1, 3), "avail_date": f"2024-05-0{rng.randint(1, 4)}",
                "start_time": rng.choice(["08:00", "09:00"]), "end_time": "17:00", "is_available": rng.random() < 0.5,
                "notes": rng.choice([None, "n"])} for s in seqs(rng, 25)]
    if seed == 3:
        records[7]["doctor_id"] = 77
    state = {(v["doctor_id"], v["avail_date"]): (v["avail_id"], v["start_time"], v["is_available"], v["notes"])
             for v in data["doctor_availability"]}
    before, next_id = dict(state), 21
    for r in sorted(records, key=lambda r: r["request_seq"]):
        key = (r["doctor_id"], r["avail_date"])
        if key not in state:
            state[key] = (next_id,)
            next_id += 1
        state[key] = (state[key][0], r["start_time"], r["is_available"], r["notes"] or "")
    done = rosters.upsert_availability(t, make("availability_upserts", records))
    got = {(r.doctor_id, r.avail_date): (r.avail_id, r.start_time, r.is_available, r.notes)
           for r in done.tables["doctor_availability"].collect()}
    assert got == (before if seed == 3 else state)
    reasons = outcome(done)[1]
    assert (len(reasons), sorted(set(reasons.values()))) == ((25, ["batch rejected", "foreign key"]) if seed == 3 else (0, []))


@pytest.mark.parametrize("seed", SEEDS)
def test_status_changes_and_audit_chain(make, seed):
    rng = random.Random(400 + seed)
    data, t = world(make, rng)
    ids = [a["appointment_id"] for a in data["appointments"]] + [1000]
    changes = [{"request_seq": s, "appointment_id": ids[0] if rng.random() < 0.4 else rng.choice(ids),
                "status": rng.choice(["Scheduled", "Confirmed", "Cancelled"])} for s in seqs(rng, 40)]
    state = {a["appointment_id"]: a["status"] for a in data["appointments"]}
    trail = []
    for r in sorted(changes, key=lambda r: r["request_seq"]):
        if r["appointment_id"] in state:
            trail.append((r["request_seq"], r["appointment_id"], state[r["appointment_id"]], r["status"]))
            state[r["appointment_id"]] = r["status"]
    done = booking.change_status(t, make("status_changes", changes), STAMP)
    assert {r.appointment_id: r.status for r in done.tables["appointments"].collect()} == state
    assert rows_of(done.audit, "request_seq", "record_id", "old_value", "new_value") == trail
    assert set(outcome(done)[1]) == {r["request_seq"] for r in changes if r["appointment_id"] == 1000}
    log = append_audit(make("audit_log", [{"log_id": 4}]), done.audit)
    assert [(r.log_id, r.new_value) for r in log.orderBy("log_id").collect()][1:] == [(5 + i, x[3]) for i, x in enumerate(trail)]


def test_acceptance(make):
    data, t = world(make, random.Random(5))
    first = data["appointments"][0]["appointment_id"]
    done = booking.accept_appointments(t, make("acceptances", [
        {"request_seq": 2, "appointment_id": first, "duration_minutes": 45},
        {"request_seq": 1, "appointment_id": first, "duration_minutes": 60}]), STAMP)
    row = done.tables["appointments"].filter(f"appointment_id = {first}").first()
    assert (row.status, row.duration_minutes) == ("Confirmed", 45)
    assert rows_of(done.audit, "request_seq", "old_value", "new_value") == [
        (1, data["appointments"][0]["status"], "Confirmed"), (2, "Confirmed", "Confirmed")]


@pytest.mark.parametrize("seed", SEEDS)
def test_patient_deletes(make, seed):
    rng = random.Random(500 + seed)
    data, t = world(make, rng)
    requests = [{"request_seq": s, "id": rng.randint(1, 10)} for s in seqs(rng, 10)]
    patients = {p["patient_id"] for p in data["patients"]}
    visits = {a["appointment_id"]: a["patient_id"] for a in data["appointments"]}
    billed = {b["patient_id"] for b in data["bills"]} | {visits.get(b["appointment_id"]) for b in data["bills"]}
    trail, rejected = {}, {}
    for r in sorted(requests, key=lambda r: r["request_seq"]):
        if r["id"] not in patients:
            rejected[r["request_seq"]] = "not found"
        elif r["id"] in billed:
            rejected[r["request_seq"]] = "has bills"
        else:
            patients.discard(r["id"])
            trail[r["request_seq"]] = f"P{r['id']} (ID:{r['id']})"
    done = people.delete_patients(t, make("deletions", requests), STAMP)
    assert {r.patient_id for r in done.tables["patients"].collect()} == patients
    assert {r.appointment_id for r in done.tables["appointments"].collect()} == {a for a, p in visits.items() if p in patients}
    assert {r.bed_id: (r.status, r.patient_id) for r in done.tables["beds"].collect()} == {
        b["bed_id"]: (b["status"], b["patient_id"] if b["patient_id"] in patients else None) for b in data["beds"]}
    assert outcome(done)[1] == rejected
    assert {r.request_seq: r.old_value for r in done.audit.collect()} == trail


@pytest.mark.parametrize("seed", SEEDS)
def test_sparse_patches(make, seed):
    rng = random.Random(600 + seed)
    data, t = world(make, rng)
    choices = {"name": ["A", None], "age": ["41", "x", None], "email": ["e", None], "status": ["Inactive", None],
               "insurance_id": [None, "I"], "shoe_size": ["44"]}
    requests = []
    for s in seqs(rng, 30):
        keys = rng.sample(sorted(choices), rng.randint(0, 3))
        requests.append({"request_seq": s, "id": rng.randint(1, 9), "patch": {k: rng.choice(choices[k]) for k in keys}})
    state = {p["patient_id"]: {c: p.get(c) for c in PATCHABLE_PATIENT_COLUMNS} for p in data["patients"]}
    rejected = {}
    for r in sorted(requests, key=lambda r: r["request_seq"]):
        patch = {k: v for k, v in r["patch"].items() if k in PATCHABLE_PATIENT_COLUMNS}
        if r["id"] not in state:
            rejected[r["request_seq"]] = "not found"
        elif any(patch.get(k, "") is None for k in ("name", "age")):
            rejected[r["request_seq"]] = "not null"
        elif patch.get("age") == "x":
            rejected[r["request_seq"]] = "bad value"
        else:
            state[r["id"]].update({k: int(v) if k == "age" else v for k, v in patch.items()})
    done = people.patch_patients(t, make("patches", requests))
    got = {r.patient_id: {c: r[c] for c in PATCHABLE_PATIENT_COLUMNS} for r in done.tables["patients"].collect()}
    assert got == state and outcome(done)[1] == rejected


@pytest.mark.parametrize("seed", SEEDS)
def test_new_doctors_stay_unique(make, seed):
    rng = random.Random(700 + seed)
    data, t = world(make, rng)
    requests = [{"request_seq": s, "name": rng.choice(["n", "n", "n", None]), "specialization": "s", "salary": Decimal(1),
                 "dept_id": rng.choice([1, 1, 2, 9]), "phone": rng.choice(["51", None] + [f"7{i}" for i in range(8)]),
                 "email": rng.choice(["d2@x"] + [f"e{i}" for i in range(8)])} for s in seqs(rng, 40)]
    phones, emails = {d["phone"] for d in data["doctors"]}, {d["email"] for d in data["doctors"]}
    accepted, next_id, refused = {}, 4, set()
    for r in sorted(requests, key=lambda r: r["request_seq"]):
        clash = (r["phone"] is not None and r["phone"] in phones) or r["email"] in emails
        if r["name"] is None or r["dept_id"] == 9 or clash:
            refused.add(r["request_seq"])
        else:
            accepted[r["request_seq"]] = (next_id, r["phone"], r["email"])
            next_id += 1
            phones.add(r["phone"])
            emails.add(r["email"])
    done = people.add_doctors(t, make("new_doctors", requests), STAMP)
    got, rejected = outcome(done, "doctor_id", "phone", "email")
    assert got == accepted and set(rejected) == refused
    assert done.tables["doctors"].count() == 3 + len(accepted)


def test_new_patients_and_uploads(make):
    data, t = world(make, random.Random(8))
    requests = [{"request_seq": 9, "name": "B", "age": 2, "gender": "g", "phone": "9"},
                {"request_seq": 4, "name": "A", "age": 1, "gender": "g", "phone": "9", "email": "e"},
                {"request_seq": 5, "name": None, "age": 1, "gender": "g", "phone": "9"}]
    done = people.add_patients(t, make("new_patients", requests), STAMP, high_water=20)
    assert outcome(done, "patient_id", "email", "registration_date", "status") == (
        {4: (21, "e", "2024-04-15", "Active"), 9: (22, "", "2024-04-15", "Active")}, {5: "not null"})
    t["uploads"] = make("uploads", [])
    up = people.add_uploads(t, make("new_uploads", [{"request_seq": 1, "filename": "f", "original_name": "o", "file_type": "png"}]), STAMP)
    assert [r.upload_id for r in up.tables["uploads"].collect()] == [1]


def test_nulls_that_are_given_are_kept(make):
    from pyspark.sql import functions as F
    data, t = world(make, random.Random(1))
    requests = make("new_patients", [{"request_seq": k, "name": "n", "age": 1, "gender": "Other", "phone": "1", "email": e} for k, e in enumerate([None, None, "x@y", None])])
    given = F.when(F.col("request_seq") == 0, F.array(F.lit("email"), F.lit("address"))).when(F.col("request_seq") == 3, F.lit(None))
    done = people.add_patients(t, requests.withColumn("given", given.otherwise(F.array(F.lit("address")))), STAMP)
    assert {r.request_seq: (r.email, r.address, r.blood_group) for r in done.accepted.collect()} == {0: (None, None, ""), 1: ("", None, ""), 2: ("x@y", None, ""), 3: ("", "", "")}
    # A doctor's email that is given as NULL clashes with nothing; empty ones clash.
    doctors = make("new_doctors", [{"request_seq": k, "name": "n", "specialization": "s", "dept_id": 1, "phone": f"77{k}", "salary": Decimal(1)} for k in range(4)])
    done = people.add_doctors(t, doctors.withColumn("given", F.when(F.col("request_seq") < 2, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>"))), STAMP)
    assert outcome(done, "email") == ({0: (None,), 1: (None,), 2: ("",)}, {3: "unique"})
    bookings = make("admin_bookings", [{"request_seq": k, "patient_id": 1, "doctor_id": 3, "appointment_date": "2024-06-01", "time_slot": slot}
                                       for k, slot in enumerate(["09:00", "09:30"])])
    done = booking.book_appointments(t, bookings.withColumn("given", F.when(F.col("request_seq") == 0, F.array(F.lit("fees"), F.lit("symptoms")))), STAMP)
    assert outcome(done, "fees", "symptoms")[0] == {0: (None, None), 1: (Decimal(500), "")}


def test_bills(make):
    data, t = world(make, random.Random(9))
    t["patients"] = make("patients", [{"patient_id": 1, "insurance_id": "I"}, {"patient_id": 2}, {"patient_id": 3, "insurance_id": ""},
                                      {"patient_id": 4, "insurance_id": "NONE"}])
    charge = {"bed_charges": Decimal("10.01"), "consultation_fees": Decimal("20.02"), "medicine_charges": Decimal(0),
              "test_charges": Decimal("3.32")}
    requests = [dict(charge, request_seq=i, patient_id=p) for i, p in enumerate([1, 2, 3, 4, 50, None])]
    requests += [dict(charge, request_seq=7, patient_id=1, appointment_id=12345),
                 dict(charge, request_seq=8, patient_id=1, test_charges=None)]
    done = billing.generate_bills(t, make("bill_requests", requests), STAMP)
    accepted, rejected = outcome(done, "bill_id", "total_amount", "insurance_coverage", "patient_payable", "status")
    full, none = (Decimal("33.35"), Decimal("23.35"), Decimal("10.00")), (Decimal("33.35"), Decimal(0), Decimal("33.35"))
    assert accepted == {0: (6, *full, "Pending"), 1: (7, *none, "Pending"), 2: (8, *full, "Pending"), 3: (9, *none, "Pending")}
    assert rejected == {4: "unknown patient", 5: "unknown patient", 7: "foreign key", 8: "not null"}
    paid = billing.pay_bills({"bills": done.tables["bills"]}, make("payments", [
        {"request_seq": 1, "bill_id": 6}, {"request_seq": 2, "bill_id": 6}, {"request_seq": 3, "bill_id": 99}]))
    assert rows_of(paid.tables["bills"].filter("status = 'Paid'"), "bill_id") == [(6,)]
    assert outcome(paid)[1] == {3: "not found"}


def test_release_and_deletes(make):
    data, t = world(make, random.Random(10))
    beds = make("beds", [{"bed_id": 1, "status": "Maintenance"}, {"bed_id": 2, "status": "Occupied", "patient_id": 3, "admitted_date": "d"},
                         {"bed_id": 3, "status": "Occupied", "patient_id": 4}])
    done = wards.release_beds({"beds": beds}, make("bed_releases", [{"request_seq": i, "bed_id": b} for i, b in enumerate([1, 2, 2, 9])]))
    assert rows_of(done.tables["beds"], "bed_id", "status", "patient_id", "admitted_date") == [
        (1, "Available", None, None), (2, "Available", None, None), (3, "Occupied", 4, None)]
    gone = rosters.delete_by_key(t["doctor_availability"], "avail_id", make("deletions", [
        {"request_seq": 1, "id": 10}, {"request_seq": 2, "id": 11}]))
    assert rows_of(gone.tables["table"], "avail_id") == [(20,)] and outcome(gone)[1] == {2: "not found"}


def test_snapshot_diff_sees_net_changes(make):
    before = {"appointments": make("appointments", [{"appointment_id": i, "status": s} for i, s in enumerate(["A", "B", None])]),
              "patients": make("patients", [{"patient_id": 1, "name": "x"}, {"patient_id": 2, "name": None}]),
              "beds": make("beds", [{"bed_id": 1, "status": "Available"}, {"bed_id": 2, "status": None}, {"bed_id": 3, "status": "Occupied"}])}
    after = {"appointments": make("appointments", [{"appointment_id": i, "status": s} for i, s in enumerate(["A", "C", "D"])]),
             "patients": before["patients"].filter("patient_id = 9"),
             "beds": make("beds", [{"bed_id": b, "status": "Occupied"} for b in (1, 2, 3, 4)])}
    got = rows_of(audit.snapshot_audit(before, after, STAMP), "table_name", "record_id", "old_value", "new_value")
    assert got == [("appointments", 1, "B", "C"), ("appointments", 2, None, "D"), ("beds", 1, "Available", "Patient ID:?"),
                   ("patients", 1, "x (ID:1)", None), ("patients", 2, None, None)]
