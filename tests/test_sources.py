from conftest import rows_of
from pyspark.sql import functions as F

from wardwright.plans import views
from wardwright.session import scratch_path, settle
from wardwright.sources import sinks, tables


def test_tables_round_trip(spark, ward):
    root = scratch_path(spark, "lake")
    for name, df in ward.items():
        sinks.append_rows(df, f"{root}/{name}")
    read = tables.read_tables(spark, root)
    assert read["patients"].schema == ward["patients"].schema
    assert rows_of(views.dept_stats(read)) == rows_of(views.dept_stats(ward))
    assert [r.dept_id for r in tables.full_scan(read["departments"], "departments").collect()] == list(range(1, 9))
    assert tables.full_scan(read["patients"], "patients", newest_first=True).first().patient_id == 15


def test_views_follow_their_tables(spark, ward):
    views.register_views(spark, ward)
    assert spark.sql("SELECT count(*) FROM v_bed_occupancy WHERE patient_name IS NOT NULL").first()[0] == 6
    assert spark.sql("SELECT sum(total_appointments) FROM v_dept_stats").first()[0] == 17


def test_append_keeps_existing_files(spark, make):
    path = scratch_path(spark, "append")
    sinks.append_rows(make("deletions", [{"request_seq": 1, "id": 1}]), path)
    before = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    sinks.append_rows(make("deletions", [{"request_seq": 2, "id": 2}]), path)
    after = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    assert before < after and spark.read.parquet(path).count() == 2


def test_with_new_rows_fills_missing_columns(make):
    table = make("deletions", [{"request_seq": 1, "id": 1}])
    assert rows_of(sinks.with_new_rows(table, table.select(F.lit(5).cast("long").alias("id"), F.lit(0).alias("other")))) == [
        (None, 5), (1, 1)]


def test_json_keeps_nulls(spark, make):
    rows = make("patients", [{"patient_id": 1, "name": None}])
    record = sinks.json_records(rows).first().record
    assert '"name":null' in record and '"patient_id":1' in record
    path = scratch_path(spark, "json")
    sinks.write_json(rows, path)
    assert '"name":null' in spark.read.text(path).first().value


def test_upload_listing(spark, make):
    from datetime import datetime
    ups = make("uploads", [{"upload_id": 1, "uploaded_at": datetime(2024, 1, 2)}, {"upload_id": 2, "uploaded_at": datetime(2024, 1, 1)},
                           {"upload_id": 3, "uploaded_at": datetime(2024, 1, 2)}])
    assert [r.upload_id for r in tables.upload_manifest(ups).collect()] == [3, 1, 2]
    path = scratch_path(spark, "files")
    sinks.write_json(ups.coalesce(1), path)
    files = tables.files_manifest(spark, path)
    assert files.count() == 1 and "content" not in files.columns


def test_settled_table_is_computed_once(spark):
    df = settle(spark.range(5).withColumn("r", F.rand()), "settle")
    assert rows_of(df) == rows_of(df)


def files_of(spark, path):
    return {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}


def test_rewritten_partitions_leave_the_others_alone(spark, ward):
    path, table = scratch_path(spark, "rewritten"), ward["appointments"]
    sinks.write_by_date(table, path, "appointment_date", "appointment_id")
    before = files_of(spark, path)
    ids = spark.createDataFrame([(24,), (30,), (77,), (None,)], "appointment_id long")
    cancel = F.when(F.col("appointment_id").isin(24, 30), F.lit("Cancelled")).otherwise(F.col("status"))
    touched = sinks.rewrite_partitions(spark, path, table.schema, "appointment_date", "appointment_id", ids, lambda rows: rows.withColumn("status", cancel))
    assert sorted(touched) == ["2024-03-11", "2024-03-13"]
    stored = spark.read.schema(table.schema).parquet(path)
    assert rows_of(stored, *table.columns) == rows_of(table.withColumn("status", cancel), *table.columns)
    after = files_of(spark, path)
    assert len(before & after) == len(before) - 2 and not any("03-11" in f or "03-13" in f for f in before & after)
    assert sinks.rewrite_partitions(spark, path, table.schema, "appointment_date", "appointment_id", ids.filter("appointment_id = 77"), lambda rows: rows) == []
    assert files_of(spark, path) == after
