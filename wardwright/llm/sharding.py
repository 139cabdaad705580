"""Histogram sort: shards of near-equal bytes from exact counts below candidate boundaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardwright.llm.common import prepare, table
from wardwright.session import settle

_WIDE = 16  # bytes of a key


def _keys(high: pd.Series, low: pd.Series) -> np.ndarray:
    """Two longs as 16 bytes that sort as the pair does."""
    flip = np.uint64(1 << 63)
    pair = np.empty((len(high), 2), ">u8")
    pair[:, 0], pair[:, 1] = high.to_numpy(np.int64).view(np.uint64) ^ flip, low.to_numpy(np.int64).view(np.uint64) ^ flip
    return pair.view(f"S{_WIDE}").ravel()


def _places(bounds: list[int]):
    """A function that says how many of the boundaries (as integers, sorted) are at or below each key."""
    sorted_bounds = np.array([b.to_bytes(_WIDE, "big") for b in bounds], f"S{_WIDE}")

    @F.pandas_udf("int")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for high, low in parts:
            yield pd.Series(np.searchsorted(sorted_bounds, _keys(high, low), side="right").astype(np.int32))

    return place


def find_splitters(keys: DataFrame, parts: int, tolerance: float, probes: int = 8) -> tuple[list[int], list[int]]:
    """Boundaries that cut `keys` (high, low, size) into `parts` ranges of equal bytes, and the rows below each.

    Each round counts the exact bytes and rows below every candidate in one pass over all partitions and narrows the
    bracket around each wanted boundary, until the bytes below it are within `tolerance` of a part or the
    bracket holds one key. The driver sees one count per candidate, never keys.
    """
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = [total * k / parts for k in range(1, parts)]
    allowed = tolerance * total / parts
    bottom, top = 0, 1 << 8 * _WIDE
    # Per boundary: a key with too few bytes below it and one with too many, with those bytes and rows.
    brackets = [[(bottom, 0, 0), (top, total, count)] for _ in wanted]
    chosen: list[tuple[int, int] | None] = [None] * len(wanted)
    while open_ones := [k for k, c in enumerate(chosen) if c is None]:
        candidates = set()
        for k in open_ones:
            (low, below, _), (high, above, _) = brackets[k]
            # Even steps over the bracket, and a finer set around where even density would put the boundary.
            guess = low + int((high - low) * ((wanted[k] - below) / max(above - below, 1)))
            near = max(1, (high - low) // 64)
            for step in range(1, probes + 1):
                candidates.add(low + (high - low) * step // (probes + 1))
                candidates.add(guess + (step - probes // 2) * near // probes)
        bounds = sorted(c for c in candidates if bottom < c < top)
        place = _places(bounds)
        rows = keys.select(place("high", "low").alias("place"), "size").groupBy("place").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        in_place = {r["place"]: (r["bytes"], r["rows"]) for r in rows}
        here = np.zeros((len(bounds) + 1, 2), object)
        for n, counts in in_place.items():
            here[n] = counts
        bytes_below, rows_below = np.cumsum(here[:-1], axis=0).T.tolist() if bounds else ([], [])
        for k in open_ones:
            low, high = brackets[k]
            # The last candidate inside the bracket with no more than the bytes wanted below it, and the one after it.
            first, end = bisect_right(bounds, low[0]), bisect_left(bounds, high[0])
            at = bisect_right(bytes_below, wanted[k], first, end)
            if at > first:
                low = (bounds[at - 1], bytes_below[at - 1], rows_below[at - 1])
            if at < end:
                high = (bounds[at], bytes_below[at], rows_below[at])
            brackets[k] = [low, high]
            best = min((low, high), key=lambda p: abs(p[1] - wanted[k]))
            # No row or one lies between the two, or they are neighbours: nothing better exists.
            if abs(best[1] - wanted[k]) <= allowed or high[2] - low[2] <= 1 or high[0] - low[0] <= 1:
                chosen[k] = (min(best[0], top - 1), best[2])
    return [c[0] for c in chosen], [c[1] for c in chosen]


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
                   bucket_bytes: int = 64 << 20, tolerance: float = 0.005) -> DataFrame:
    """Add `size`, `shard` (from 0) and `slot` (gapless from 0 within the shard) to all rows, shards near equal in bytes.

    The sort key is the hash of the text, then the id: equal texts are neighbours, and a large group of them can be
    cut between two ids. Each shard is itself cut into buckets of about `bucket_bytes` by the same boundaries
    search; the rows are exchanged once, by bucket, and sorted there. As the rows below every boundary are
    known, slots need no further pass. Size is the UTF-8 bytes of the text plus 8, a null text counting 0. Rows
    that repeat an id and text stay together. A null id sorts first. An empty table gives an empty result; input
    columns named like the results are replaced.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    low = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    sized = docs.select(*kept, (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                        F.xxhash64(F.col(text)).alias("_high"), low.alias("_low"))
    keys = settle(sized.select(F.col("_high").alias("high"), F.col("_low").alias("low"), "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    bounds, below = find_splitters(keys, shards * per_shard, tolerance)
    # Rows below the bucket less rows below its shard: where the slots of the bucket start.
    first_row = [0, *below]
    start = [first_row[b] - first_row[b - b % per_shard] for b in range(shards * per_shard)]
    starts = F.array(*[F.lit(int(s)).cast("long") for s in start]) if len(start) <= 4096 else None
    bucketed = sized.withColumn("_bucket", _places(bounds)("_high", "_low"))
    row = F.row_number().over(Window.partitionBy("_bucket").orderBy("_high", "_low"))
    numbered = bucketed.withColumn("_row", row.cast("long") - 1)
    if starts is not None:
        first = F.element_at(starts, F.col("_bucket") + 1)
        return numbered.select(*kept, "size", F.floor(F.col("_bucket") / per_shard).cast("int").alias("shard"),
                               (first + F.col("_row")).alias("slot"))
    spark = docs.sparkSession
    offsets = spark.createDataFrame(list(enumerate(start)), "_bucket int, _first long")
    return numbered.join(offsets, "_bucket").select(
        *kept, "size", F.floor(F.col("_bucket") / per_shard).cast("int").alias("shard"), (F.col("_first") + F.col("_row")).alias("slot"))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return dealt.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
