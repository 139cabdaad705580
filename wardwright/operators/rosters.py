"""Doctor availability: upsert and removal; removal of upload entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwright.operators.changes import (FOREIGN_KEY, NOT_NULL, SEQ, Outcome, default_for, exists_flag, split_known, update_by_key,
                                          with_new_ids)
from wardwright.session import settle
from wardwright.sources.sinks import with_new_rows

Tables = dict[str, DataFrame]
DAY = ["doctor_id", "avail_date"]
VALUES = ["start_time", "end_time", "is_available", "notes"]


def upsert_availability(t: Tables, records: DataFrame, high_water: int | None = None) -> Outcome:
    """Insert or replace the entry of a doctor and day; the last record of a key wins and a replaced
    entry keeps its id. One bad record rejects the whole batch.
    """
    table = t["doctor_availability"]
    records = records.withColumn("notes", default_for(records, "notes", F.lit("")))
    missing = F.lit(False)
    for name in (*DAY, "start_time", "end_time", "is_available"):
        missing = missing | F.col(name).isNull()
    checked = exists_flag(records, "doctor_id", t["doctors"], "doctor_id", "_doctor").withColumn(
        "reason", F.when(missing, NOT_NULL).when(~F.col("_doctor"), FOREIGN_KEY))
    # The batch verdict is one aggregated value, used as a scalar subquery.
    sound = checked.agg(F.coalesce(F.count("reason") == 0, F.lit(True))).scalar()
    accepted = records.filter(sound)
    rejected = checked.select(SEQ, F.coalesce("reason", F.lit("batch rejected")).alias("reason")).filter(~sound)

    # Per key the values of its last record, and its first sequence number, which orders new ids.
    per_day = accepted.groupBy(*DAY).agg(F.max_by(F.struct(*VALUES), SEQ).alias("v"), F.min(SEQ).alias(SEQ))
    merged = settle(per_day.join(table.select("avail_id", *DAY), DAY, "left")
                    .select("avail_id", *DAY, SEQ, *[F.col("v")[c].alias(c) for c in VALUES]), "availability")
    replaced = merged.filter("avail_id IS NOT NULL").select("avail_id", *VALUES)
    fresh = with_new_ids(merged.filter("avail_id IS NULL").drop("avail_id"), table, "doctor_availability", high_water)
    state = with_new_rows(
        update_by_key(table, "avail_id", replaced, {c: F.col(f"c.{c}") for c in VALUES}), fresh)
    return Outcome({"doctor_availability": state}, accepted, rejected)


def delete_by_key(table: DataFrame, key: str, deletions: DataFrame) -> Outcome:
    """Remove the rows with the given ids; unknown ids change nothing."""
    wanted = deletions.select(SEQ, F.col("id").alias(key))
    state = table.join(wanted.select(key), key, "left_anti").select(*table.columns)
    return Outcome({"table": state}, *split_known(wanted, table, key))
