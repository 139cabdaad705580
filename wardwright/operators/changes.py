"""Shared parts of the change-set operators.

A change set is a DataFrame of requests with a unique `request_seq`. Applying it
gives the state that replaying the requests one by one in that order would
give, computed set-wise. Nothing is updated in place: the caller writes the new
state to a new version of the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwright.functions.ordering import positions
from wardwright.functions.scalars import stamp
from wardwright.schemas import KEYS
from wardwright.session import settle

SEQ = "request_seq"
FOREIGN_KEY = "foreign key"
NOT_NULL = "not null"
NOT_FOUND = "not found"


#: Optional column of a change set: the names of the columns that a request gives. A NULL in a column it names is kept; any
#: other NULL, and every one without this column, stands for a value that was left out, which takes the default.
GIVEN = "given"


def default_for(requests: DataFrame, column: str, default: Column) -> Column:
    """The value of a column of `requests`, or `default` where it was left out."""
    value, named = F.col(column), F.lit(False)
    if GIVEN in requests.columns:
        named = F.coalesce(F.array_contains(GIVEN, column), F.lit(False))
    return F.when(value.isNull() & ~named, default).otherwise(value)


@dataclass(frozen=True)
class Outcome:
    """New state of the touched tables, and what became of every request."""

    tables: dict[str, DataFrame]
    accepted: DataFrame
    rejected: DataFrame
    audit: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def last_id(table: DataFrame, name: str, high_water: int | None = None) -> Column:
    """The highest id ever given out. Pass `high_water` where rows above the present maximum were deleted."""
    top = table.agg(F.coalesce(F.max(KEYS[name]), F.lit(0))).scalar()
    return top if high_water is None else F.greatest(top, F.lit(high_water))


def with_new_ids(rows: DataFrame, table: DataFrame, name: str, high_water: int | None = None,
                 seq: str = SEQ, out: str | None = None) -> DataFrame:
    """Give `rows` consecutive ids after the table's last one, in `seq` order."""
    numbered = positions(rows.select(seq), seq, "_position")
    return (rows.join(numbered, seq)
                .withColumn(out or KEYS[name], last_id(table, name, high_water) + F.col("_position"))
                .drop("_position"))


# A join side that comes out of an aggregation on the join key is already partitioned by it,
# so Spark adds no shuffle there, and without one the adaptive skew join cannot split a hot
# key on the other side. Such sides are settled first: read back, they are broadcast if they are
# small by their true size, or shuffled, and then hot keys are split.

def only_wanted(table: DataFrame, keys: list[str], requests: DataFrame) -> DataFrame:
    """The rows of a large table that a batch of requests asks for. `table` is unique in `keys`,
    by nature or because it is aggregated by them.

    The distinct request keys are the build side of a semi join. Where they fit
    the broadcast limit, Catalyst moves the join below the aggregation: the table
    is filtered during its scan, with partition pruning where a key column is a
    partition column. A larger batch meets the aggregated table, so a key with a
    third of all rows has shrunk to one row before anything is shuffled.
    """
    return table.join(requests.select(*keys).distinct(), keys, "left_semi")


def exists_flag(requests: DataFrame, column: str, parent: DataFrame, parent_key: str, out: str) -> DataFrame:
    """Add `out`: is `column` a key of `parent`? For the parents that stay small next to the requests'
    tables: people, doctors, departments. Only the key column is read."""
    keys = parent.select(F.col(parent_key).alias(column), F.lit(True).alias(out))
    return requests.join(keys, column, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def known_keys(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The requested keys that a large table holds, as a settled one-column table."""
    return settle(only_wanted(table.select(key), [key], requests), "known-keys")


def wanted_flag(requests: DataFrame, column: str, parent: DataFrame, parent_key: str, out: str) -> DataFrame:
    """`exists_flag` for a large parent, such as patients: the wanted keys are found first, so that a small
    batch filters the parent during its scan and never shuffles it."""
    keys = known_keys(requests.select(F.col(column).alias(parent_key)), parent, parent_key)
    return exists_flag(requests, column, keys, parent_key, out)


def known_rows(requests: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
    """`known_keys` with further columns of the table, so that what else follows from the rows asked for needs no scan of its own."""
    return settle(only_wanted(table.select(key, *columns), [key], requests), "known-rows")


def split_known(requests: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose key is in the table, and the others as rejections."""
    return split_by(requests, known_keys(requests, table, key), key)


def split_by(requests: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose key is in `known`, a settled table, and the others as rejections."""
    keys = known.select(key)
    unknown = requests.join(keys, key, "left_anti").select(SEQ, F.lit(NOT_FOUND).alias("reason"))
    return requests.join(keys, key, "left_semi"), unknown


def first_valid(requests: DataFrame, key: list[str], valid: Column | str) -> DataFrame:
    """Lowest valid `request_seq` per key as `winner`; an aggregate with partial sums, not a window,
    so a key with a third of all requests costs one row per task."""
    return requests.groupBy(*key).agg(F.min(F.when(valid if isinstance(valid, Column) else F.col(valid),
                                                   F.col(SEQ))).alias("winner"))


def admission(taken: Column, seq: Column, winner: Column, valid: Column, taken_reason: str) -> Column:
    """Reason of rejection or NULL. The holder of a key is found before the row is inserted, so
    'taken' goes before an invalid reference, but only once the key has been won."""
    lost = F.coalesce(taken, F.lit(False)) | F.coalesce(seq > winner, F.lit(False))
    return F.when(lost, F.lit(taken_reason)).when(~valid, F.lit(FOREIGN_KEY))


def audit_rows(rows: DataFrame, table: str, record_id, action: str, old, new, as_of: str) -> DataFrame:
    """Audit rows without log ids; `request_seq` keeps their order until they are appended."""
    text = F.lit(None).cast("string")
    return rows.select(
        SEQ, F.lit(table).alias("table_name"), F.col(record_id).alias("record_id"), F.lit(action).alias("action"),
        (text if old is None else old).alias("old_value"), (text if new is None else new).alias("new_value"),
        stamp(as_of).alias("timestamp"), F.lit("System").alias("performed_by"))


def append_audit(audit_log: DataFrame, rows: DataFrame, high_water: int | None = None) -> DataFrame:
    """The log with `rows` numbered in request order. Numbering reads them several times, so they are settled."""
    numbered = with_new_ids(settle(rows, "audit-rows"), audit_log, "audit_log", high_water)
    return audit_log.unionByName(numbered.select(*audit_log.columns))


def last_per_key(requests: DataFrame, key: list[str] | str, columns: list[str]) -> DataFrame:
    """The columns of the last request per key."""
    keys = [key] if isinstance(key, str) else key
    picked = requests.groupBy(*keys).agg(F.max_by(F.struct(*columns), SEQ).alias("_last"))
    return picked.select(*keys, *[F.col("_last")[c].alias(c) for c in columns])


def update_by_key(table: DataFrame, key: str, changes: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Keyed update. `changes` has one row per key; `columns` give new values, over its columns
    and the table's, for the rows it touches. Callers settle `changes` first: by its true size a small
    batch is broadcast to the table's scan, and only a large one makes the table shuffle."""
    touched = changes.withColumn("_touched", F.lit(True))
    joined = table.alias("t").join(touched.alias("c"), F.col(f"t.{key}") == F.col(f"c.{key}"), "left")
    return joined.select(*[
        F.when(F.col("_touched"), columns[name]).otherwise(F.col(f"t.{name}")).alias(name)
        if name in columns else F.col(f"t.{name}") for name in table.columns])
