"""The dashboard bundle: eleven figures and lists, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.operators import reports
from wardwright.operators.loads import fold_statuses, status_load
from wardwright.plans import views
from wardwright.session import settle

Tables = dict[str, DataFrame]


def headline_counts(spark: SparkSession, t: Tables, load: DataFrame | None = None) -> DataFrame:
    """The six scalars in one row, as scalar subqueries; both bed counts come from one scan.
    With a settled `load` the appointments need no scan of their own."""
    beds = t["beds"].agg(F.struct(F.count_if(F.col("status") == "Available").alias("available"),
                                  F.count(F.lit(1)).alias("total"))).scalar()
    if load is None:
        scheduled = reports.filtered_count(t["appointments"], "Scheduled").scalar()
    else:
        scheduled = load.agg(F.coalesce(F.sum(F.when(F.col("status") == "Scheduled", F.col("n"))), F.lit(0))).scalar()
    return spark.range(1).select(
        reports.row_count(t["patients"]).scalar().alias("total_patients"),
        reports.filtered_count(t["doctors"], "Active").scalar().alias("total_doctors"),
        scheduled.alias("scheduled_appts"),
        beds["available"].alias("available_beds"), beds["total"].alias("total_beds"),
        reports.total_revenue(t["bills"]).scalar().alias("total_revenue"))


def dashboard(spark: SparkSession, t: Tables) -> dict[str, DataFrame]:
    """Appointments are read twice in all: once for the settled load per doctor and status that
    all counts, sums and means start from, once for the latest few."""
    load = settle(status_load(t["appointments"]), "dashboard")
    per_doctor = fold_statuses(load)
    return {
        "headline": headline_counts(spark, t, load),
        "appt_by_status": load.groupBy("status").agg(F.sum("n").alias("cnt")),
        "dept_stats": views.dept_stats(t, per_doctor),
        "bed_by_type": reports.beds_by_type(t["beds"]),
        "recent_appts": views.recent_appointments(t),
        "wait_times": reports.mean_wait_by_department(t, per_doctor),
    }


#: The list sections of the document, each with the columns it is ordered by; the latest appointments come first.
SECTION_ORDER = {"appt_by_status": ("status",), "dept_stats": ("dept_id",), "bed_by_type": ("bed_type",),
                 "recent_appts": ("appointment_date", "time_slot", "appointment_id"), "wait_times": ("dept_name",)}
NEWEST_FIRST = {"recent_appts"}


def nested_dashboard(spark: SparkSession, t: Tables) -> DataFrame:
    """The whole dashboard as one row: the headline figures, and a list of structs per section. The lists are as long as there are
    statuses, departments, bed types and latest appointments, not as there are rows."""
    bundle = dashboard(spark, t)
    lists = []
    for name, keys in SECTION_ORDER.items():
        section = bundle[name]
        entry = F.struct(F.struct(*keys).alias("_order"), F.struct(*section.columns).alias("row"))
        listed = F.transform(F.sort_array(F.collect_list(entry), asc=name not in NEWEST_FIRST), lambda x: x["row"])
        lists.append(section.agg(listed.alias(name)).scalar().alias(name))
    return bundle["headline"].select("*", *lists)


def dashboard_document(spark: SparkSession, t: Tables) -> DataFrame:
    """One row with one column, `document`: the dashboard as JSON, nulls kept."""
    return nested_dashboard(spark, t).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
