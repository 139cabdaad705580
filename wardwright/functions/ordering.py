"""Positions and predecessors along a unique sequence number, without a global window.

Both helpers cut the sequence into blocks of 2**BLOCK_BITS consecutive numbers.
As the numbers are unique, no window group can exceed a block, whatever the
skew of the data: a key that owns a third of all rows is spread over its
blocks. Two further levels of blocks carry totals (or last values) across block
boundaries, so every level works on groups of the same bounded size. Block
membership depends on the data alone, so a retried task yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 18


def positions(rows: DataFrame, seq: str, out: str = "position", bits: int = BLOCK_BITS) -> DataFrame:
    """(seq, out): the 1-based place of every row in `seq` order. `seq` must be unique."""
    rows = rows.select(F.col(seq), F.shiftright(seq, bits).alias("_block"))
    blocks = (rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"))
                  .withColumn("_span", F.shiftright("_block", bits)))
    spans = blocks.groupBy("_span").agg(F.sum("_rows").alias("_span_rows"))

    before = (Window.unboundedPreceding, -1)
    # One row per 2**36 sequence numbers.
    span_start = spans.select(
        "_span", F.coalesce(F.sum("_span_rows").over(Window.orderBy("_span").rowsBetween(*before)),
                            F.lit(0)).alias("_span_start"))
    in_span = Window.partitionBy("_span").orderBy("_block").rowsBetween(*before)
    block_start = (blocks.withColumn("_in_span", F.coalesce(F.sum("_rows").over(in_span), F.lit(0)))
                         .join(span_start, "_span")
                         .select("_block", (F.col("_span_start") + F.col("_in_span")).alias("_start")))
    in_block = Window.partitionBy("_block").orderBy(seq)
    return (rows.withColumn("_place", F.row_number().over(in_block))
                .join(block_start, "_block")
                .select(seq, (F.col("_start") + F.col("_place")).alias(out)))


def previous_in_key(rows: DataFrame, key: str, seq: str, value: str, out: str,
                    bits: int = BLOCK_BITS, levels: int = 3) -> DataFrame:
    """Add `out` = struct(`value`) of the row before in the key's `seq` order, NULL for the first.

    The struct tells "no row before" from "the row before holds NULL".
    """
    wrapped = rows.withColumn("_value", F.struct(F.col(value).alias("value")))
    return _carry(wrapped, key, seq, out, bits, levels).drop("_value")


def _carry(rows: DataFrame, key: str, order: str, out: str, bits: int, levels: int) -> DataFrame:
    if levels == 1:
        return rows.withColumn(out, F.lag("_value").over(Window.partitionBy(key).orderBy(order)))
    block, far = f"_block{levels}", f"_far{levels}"
    rows = rows.withColumn(block, F.shiftright(order, bits))
    last = rows.groupBy(key, block).agg(F.max_by("_value", order).alias("_value"))
    carried = _carry(last, key, block, far, bits, levels - 1).select(key, block, far)
    near = F.lag("_value").over(Window.partitionBy(key, block).orderBy(order))
    return (rows.withColumn("_near", near).join(carried, [key, block])
                .withColumn(out, F.coalesce("_near", far))
                .drop("_near", far, block))
