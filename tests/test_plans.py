"""Shapes of plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from wardwright.operators import audit, filters, quality, reports, scheduling
from wardwright.operators.changes import only_wanted
from wardwright.plans import views
from wardwright.session import scratch_path
from wardwright.sources import sinks, tables
from wardwright.sources.versions import write_version


@pytest.fixture(scope="module")
def stored(spark, ward):
    root = scratch_path(spark, "plans")
    for name, df in ward.items():
        sinks.append_rows(df, f"{root}/{name}")
    return tables.read_tables(spark, root)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text, table):
    return [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*/" + table, text)]


def test_exists_is_a_semi_join(stored):
    text = plan(reports.patients_with_bills(stored))
    assert "LeftSemi" in text and read_columns(text, "bills") == [{"patient_id"}]


def test_orphans_read_each_child_once(stored, no_broadcast):
    text = plan(quality.orphans(stored))
    assert text.count("LeftOuter") == 4 and "LeftAnti" not in text
    scans = {name: text.count(f"/{name}]") for name in ("beds", "bills", "doctor_availability")}
    assert set(scans.values()) == {1}
    # Appointments, doctors and patients are parents as well; as children they are read once.
    assert text.count("/appointments]") == 2 and text.count("/doctors]") == 2 and text.count("/departments]") == 1
    # The references are shuffled once, for all four joins; besides, each parent's keys.
    assert text.count("Exchange hashpartitioning") == 5


def test_statistics_fold_appointments_before_joining(stored, no_broadcast):
    text = plan(views.dept_stats(stored))
    assert read_columns(text, "appointments") == [{"doctor_id", "status", "fees", "wait_time_minutes"}]
    # The scan feeds a partial aggregate directly: nothing is shuffled row by row.
    below = text[:text.index("/appointments")]
    assert below.rindex("partial_count") > below.rindex("Exchange")
    assert "Expand" not in text


def test_filters_reach_the_scan(stored):
    text = plan(filters.appointment_list(views.appointment_details(stored), "Scheduled", "2024-03-19"))
    assert "EqualTo(status,Scheduled)" in text and "EqualTo(appointment_date,2024-03-19)" in text


def test_top_k_fetches_wide_columns_late(stored, no_broadcast):
    found = views.recent_appointments(stored)
    text = plan(found)
    for node in re.split(r"\n(?=[ :+-]*(?:\* ?)?(?:Exchange|BroadcastExchange))", text)[1:]:
        below = node.split("\n")
        depth = len(re.match(r"[ :+-]*", below[0])[0])
        inside = [below[0], *[line for line in below[1:] if len(re.match(r"[ :+-]*", line)[0]) > depth]]
        assert not any("symptoms" in line or "diagnosis" in line for line in inside)
    # The wide scan is pruned by the ids that were found; only it reads wide columns.
    wide = [m for m in re.findall(r"FileScan parquet [^\n]*", text) if "symptoms" in m]
    assert len(wide) == 1 and "In(appointment_id" in wide[0]
    want = views.appointment_details(stored).orderBy(*filters.latest_order()).limit(8)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()]


def test_no_cross_joins(stored):
    for df in (reports.salary_against_mean(stored["doctors"]), scheduling.availability_calendar(stored, "2024-04-15"),
               scheduling.availability_matrix(stored, "2024-04-15")):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_open_slots_shuffle_days_not_slots(stored, no_broadcast):
    asked = stored["doctors"].select("doctor_id", F.lit("2024-04-15").alias("appointment_date"))
    text = plan(scheduling.open_slots(asked, stored["appointments"], stored["doctor_availability"]))
    assert "Generate" in text and text.index("Generate") < text.index("SortMergeJoin")


def test_date_lookup_prunes_partitions(spark, stored):
    path = scratch_path(spark, "by-date")
    sinks.write_by_date(stored["appointments"], path, "appointment_date", "appointment_id")
    hit = spark.read.schema(stored["appointments"].schema).parquet(path).filter("appointment_date = '2024-03-19'")
    assert re.search(r"PartitionFilters: \[[^\]]*appointment_date", plan(hit)) and hit.count() == 1


def test_sorts_have_a_unique_last_key(stored):
    details = views.appointment_details(stored)
    for df, key in ((filters.appointment_list(details), "appointment_id"), (filters.pending_queue(details), "appointment_id"),
                    (reports.audit_history(stored["audit_log"]), "log_id"), (tables.upload_manifest(stored["uploads"]), "upload_id"),
                    (reports.availability_roster(stored), "avail_id")):
        assert re.search(r"rangepartitioning\([^)]*" + key, plan(df))


def test_small_batches_filter_the_appointment_scan(stored):
    asked = stored["appointments"].select(*scheduling.SLOT_KEY)
    text = plan(only_wanted(scheduling.occupied_slots(stored["appointments"]), scheduling.SLOT_KEY, asked))
    # The semi join lies below the aggregation, as a broadcast.
    assert text.index("HashAggregate") < text.index("BroadcastHashJoin") and "LeftSemi, BuildRight" in text


def test_large_batches_meet_aggregated_appointments(stored, no_broadcast):
    asked = stored["appointments"].select(*scheduling.SLOT_KEY)
    text = plan(only_wanted(scheduling.occupied_slots(stored["appointments"]), scheduling.SLOT_KEY, asked))
    assert text.index("SortMergeJoin") < text.index("HashAggregate") and text.count("Exchange") == 2


def bucketed(stored, name, key, spread, **layout):
    path = scratch_path(stored[name].sparkSession, f"bucketed-{name}")
    return sinks.write_bucketed(stored[name], path.rsplit("/", 1)[1].replace("-", "_"), key, path, buckets=4, sort=(key, spread), spread=spread, **layout)


def test_bucketed_tables_join_without_a_shuffle(stored, no_broadcast):
    visits, bills = bucketed(stored, "appointments", "patient_id", "appointment_id"), bucketed(stored, "bills", "patient_id", "bill_id")
    joined = visits.join(bills.select("patient_id", "bill_id"), "patient_id")
    text = plan(joined)
    assert "SortMergeJoin" in text and "Exchange" not in text and joined.count() == 3
    counted = visits.groupBy("patient_id").count().join(bills.groupBy("patient_id").agg(F.sum("total_amount")), "patient_id")
    assert "Exchange" not in plan(counted) and counted.count() == 2


def test_bucketed_lookup_reads_one_bucket_of_one_status(spark, stored):
    # A bucketed scan, as the plan shows its buckets then; without it the same files are left out.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    by_doctor = bucketed(stored, "appointments", "doctor_id", "appointment_id", partition="status", files_per_bucket=2)
    hit = by_doctor.filter("doctor_id = 4 AND status = 'Completed' AND appointment_id = 16")
    text = plan(hit)
    assert "SelectedBucketsCount: 1 out of 4" in text and re.search(r"PartitionFilters: \[[^\]]*status", text)
    assert {r.appointment_id for r in hit.collect()} == {16}
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_file_listing_does_not_read_contents(spark, stored):
    folder = scratch_path(spark, "files")
    sinks.write_lines(stored["patients"], folder, "name", "gender")
    listed = tables.files_manifest(spark, folder)
    assert "content" not in plan(listed)
    assert listed.agg(F.sum("length")).first()[0] == sum(len(r.name) + 1 for r in stored["patients"].collect())


def test_digest_diff_reads_digests_and_changed_blocks(spark, stored):
    keys = {"appointments": "appointment_id", "patients": "patient_id", "beds": "bed_id"}

    def version(rows, bits=2):
        return {n: write_version(rows[n], scratch_path(spark, f"version-{n}"), keys[n], lambda t, block, n=n: audit.block_digests(t, block, keys[n], audit.AUDITED[n]), bits)
                for n in audit.AUDITED}

    moved = F.when(F.col("appointment_id") == 26, F.lit("Cancelled")).otherwise(F.col("status"))
    after = {"appointments": stored["appointments"].withColumn("status", moved), "patients": stored["patients"].filter("patient_id <> 11"), "beds": stored["beds"]}
    old, new = version(stored), version(after)
    found = audit.digest_audit(old, new, "2024-04-15 08:00:00")
    assert {(r.table_name, r.record_id, r.action) for r in found.collect()} == {("appointments", 26, "STATUS_CHANGE"), ("patients", 11, "DELETE")}
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in audit.snapshot_audit(stored, after, "2024-04-15 08:00:00").collect()}
    text = plan(found)
    # Ids 24 to 27 and 8 to 11: one block of each; of the beds, which are the same, none.
    assert re.search(r"PartitionFilters: \[[^\]]*id_block#\d+L? = 6", text) and re.search(r"PartitionFilters: \[[^\]]*id_block#\d+L? = 2", text)
    assert audit.changed_blocks(old["beds"].digests, new["beds"].digests, "id_block").isEmpty()
    # A NULL that becomes a value, and two rows that swap their values, change a digest.
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "b")], "k long, s string, t string")
    digest = lambda d: [tuple(r) for r in audit.block_digests(d.withColumn("block", F.lit(0)), "block", "k", ("s", "t")).collect()]
    for changed in ([(1, None, "a"), (2, "b", "x"), (3, None, "b")], [(1, "b", None), (2, "a", "x"), (3, None, "b")], [(1, "a", None), (2, "b", "x")]):
        assert digest(spark.createDataFrame(changed, rows.schema)) != digest(rows)
    assert digest(rows.orderBy(F.desc("k"))) == digest(rows)
