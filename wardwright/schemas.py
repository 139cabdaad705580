"""Table schemas, constraints and fixed values of the hospital data model.

Money is DECIMAL(18,2); dates and times of day are ISO text (`YYYY-MM-DD`,
`HH:MM`), which sorts and compares in time order; audit and upload stamps are
timestamps without time zone.
"""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------
SLOT_GRID = ("09:00", "09:30", "10:00", "10:30", "11:00", "11:30",
             "14:00", "14:30", "15:00", "15:30", "16:00", "16:30")
APPOINTMENT_STATUSES = ("Scheduled", "Confirmed", "Completed", "Cancelled", "No-Show")
OCCUPYING_STATUSES = ("Scheduled", "Confirmed", "Completed")
BED_STATUSES = ("Available", "Occupied", "Maintenance")
DAY_START, DAY_END = "09:00", "17:00"
DEFAULT_NOTE = "Default schedule"
HORIZON_DAYS = 3
INSURANCE_SHARE = "0.70"
DEFAULT_FEE = 500
DEFAULT_WAIT = 15
DEFAULT_DURATION = 30
CELL_WIDTH = 80
UPLOAD_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "pdf", "doc", "docx", "xls",
                     "xlsx", "ppt", "pptx", "txt", "svg", "webp")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg", "webp")
PATCHABLE_PATIENT_COLUMNS = ("name", "age", "gender", "phone", "email", "blood_group",
                             "address", "insurance_id", "insurance_provider", "status")
# ----------------------------------------------------------------------------

TABLES: dict[str, str] = {
    "departments": "dept_id BIGINT, dept_name STRING, location STRING, capacity INT",
    "doctors": "doctor_id BIGINT, name STRING, specialization STRING, dept_id BIGINT, phone STRING, "
               "email STRING, hire_date STRING, salary DECIMAL(18,2), status STRING",
    "patients": "patient_id BIGINT, name STRING, age INT, gender STRING, phone STRING, email STRING, "
                "blood_group STRING, address STRING, registration_date STRING, insurance_id STRING, "
                "insurance_provider STRING, status STRING",
    "beds": "bed_id BIGINT, ward_name STRING, bed_number STRING, bed_type STRING, status STRING, "
            "patient_id BIGINT, admitted_date STRING, hourly_rate DECIMAL(18,2)",
    "appointments": "appointment_id BIGINT, patient_id BIGINT, doctor_id BIGINT, appointment_date STRING, "
                    "time_slot STRING, status STRING, symptoms STRING, diagnosis STRING, "
                    "prescription STRING, fees DECIMAL(18,2), wait_time_minutes INT, "
                    "duration_minutes INT, created_at STRING",
    "bills": "bill_id BIGINT, patient_id BIGINT, appointment_id BIGINT, bed_charges DECIMAL(18,2), "
             "consultation_fees DECIMAL(18,2), medicine_charges DECIMAL(18,2), "
             "test_charges DECIMAL(18,2), total_amount DECIMAL(18,2), "
             "insurance_coverage DECIMAL(18,2), patient_payable DECIMAL(18,2), bill_date STRING, "
             "status STRING",
    "audit_log": "log_id BIGINT, table_name STRING, record_id BIGINT, action STRING, old_value STRING, "
                 "new_value STRING, timestamp TIMESTAMP_NTZ, performed_by STRING",
    "doctor_availability": "avail_id BIGINT, doctor_id BIGINT, avail_date STRING, start_time STRING, "
                           "end_time STRING, is_available BOOLEAN, notes STRING",
    "uploads": "upload_id BIGINT, filename STRING, original_name STRING, file_type STRING, "
               "uploaded_at TIMESTAMP_NTZ",
}

KEYS = {
    "departments": "dept_id", "doctors": "doctor_id", "patients": "patient_id", "beds": "bed_id",
    "appointments": "appointment_id", "bills": "bill_id", "audit_log": "log_id",
    "doctor_availability": "avail_id", "uploads": "upload_id",
}

REQUIRED: dict[str, tuple[str, ...]] = {
    "departments": ("dept_name", "location"),
    "doctors": ("name", "specialization", "dept_id", "hire_date", "salary"),
    "patients": ("name", "age", "gender", "phone", "registration_date"),
    "beds": ("ward_name", "bed_number", "bed_type"),
    "appointments": ("patient_id", "doctor_id", "appointment_date", "time_slot", "created_at"),
    "bills": ("patient_id", "bill_date"),
    "audit_log": ("table_name", "record_id", "action", "timestamp"),
    "doctor_availability": ("doctor_id", "avail_date", "start_time", "end_time", "is_available"),
    "uploads": ("filename", "original_name", "uploaded_at"),
}

# (rule name, table, key columns); NULLs are distinct, empty strings are not.
UNIQUE: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("departments.dept_name", "departments", ("dept_name",)),
    ("doctors.phone", "doctors", ("phone",)),
    ("doctors.email", "doctors", ("email",)),
    ("beds.bed_number", "beds", ("bed_number",)),
    ("doctor_availability.doctor_id,avail_date", "doctor_availability", ("doctor_id", "avail_date")),
)

# (child table, column, parent table); the parent column is the parent's key.
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("doctors", "dept_id", "departments"),
    ("beds", "patient_id", "patients"),
    ("appointments", "patient_id", "patients"),
    ("appointments", "doctor_id", "doctors"),
    ("bills", "patient_id", "patients"),
    ("bills", "appointment_id", "appointments"),
    ("doctor_availability", "doctor_id", "doctors"),
)

# Change sets; every one carries a unique `request_seq` that gives the replay order.
CHANGE_SETS: dict[str, str] = {
    "new_patients": "request_seq BIGINT, name STRING, age INT, gender STRING, phone STRING, email STRING, "
                    "blood_group STRING, address STRING, insurance_id STRING, insurance_provider STRING",
    "new_doctors": "request_seq BIGINT, name STRING, specialization STRING, dept_id BIGINT, phone STRING, "
                   "email STRING, salary DECIMAL(18,2)",
    "new_uploads": "request_seq BIGINT, filename STRING, original_name STRING, file_type STRING",
    "admin_bookings": "request_seq BIGINT, patient_id BIGINT, doctor_id BIGINT, appointment_date STRING, "
                      "time_slot STRING, symptoms STRING, fees DECIMAL(18,2)",
    "patient_bookings": "request_seq BIGINT, name STRING, age INT, gender STRING, phone STRING, "
                        "doctor_id BIGINT, appointment_date STRING, time_slot STRING, symptoms STRING",
    "status_changes": "request_seq BIGINT, appointment_id BIGINT, status STRING",
    "acceptances": "request_seq BIGINT, appointment_id BIGINT, duration_minutes INT",
    "bed_assignments": "request_seq BIGINT, bed_id BIGINT, patient_id BIGINT",
    "bed_releases": "request_seq BIGINT, bed_id BIGINT",
    "bill_requests": "request_seq BIGINT, patient_id BIGINT, appointment_id BIGINT, "
                     "bed_charges DECIMAL(18,2), consultation_fees DECIMAL(18,2), "
                     "medicine_charges DECIMAL(18,2), test_charges DECIMAL(18,2)",
    "payments": "request_seq BIGINT, bill_id BIGINT",
    "availability_upserts": "request_seq BIGINT, doctor_id BIGINT, avail_date STRING, start_time STRING, "
                            "end_time STRING, is_available BOOLEAN, notes STRING",
    "patches": "request_seq BIGINT, id BIGINT, patch MAP<STRING,STRING>",
    "deletions": "request_seq BIGINT, id BIGINT",
}
