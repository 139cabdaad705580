import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wardwright.functions import ordering, scalars as fx
from wardwright.operators import filters
from wardwright.sources.calendar import days_ahead, with_days, with_slots


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("amount,text", [
    ("0", "₹0"), ("999", "₹999"), ("1000", "₹1,000"), ("123456.5", "₹1,23,456.5"), ("12345678.05", "₹1,23,45,678.05"),
    ("-1234567", "₹-12,34,567")])
def test_rupees(spark, amount, text):
    assert one(spark, fx.rupees(F.lit(amount).cast("decimal(18,2)"))) == text


def test_text(spark):
    lit = F.lit
    assert one(spark, fx.rupees(lit(None).cast("decimal(18,2)"))) == "--"
    assert one(spark, fx.display_id("P", lit(7))) == "P0007" and one(spark, fx.display_id("P", lit(12345))) == "P12345"
    assert one(spark, fx.display_id("BED-", lit(7), 3)) == "BED-007"
    assert one(spark, fx.cell_text(lit("x" * 81))) == "x" * 80 + "..."
    assert one(spark, fx.cell_text(lit("x" * 80))) == "x" * 80 and one(spark, fx.cell_text(lit(""))) == "NULL"
    assert one(spark, fx.extension(lit("a.tar.GZ"))) == "gz" and one(spark, fx.extension(lit("none"))) is None
    assert one(spark, filters.allowed_upload(lit("x.PDF"))) and not one(spark, filters.allowed_upload(lit("pdf")))
    assert not one(spark, filters.allowed_upload(lit("x.exe"))) and one(spark, filters.is_image(lit("svg")))
    assert one(spark, fx.minutes_text(lit(30))) == "30 min" and one(spark, fx.minutes_text(lit(0))) == "--"


def test_numbers(spark):
    lit = F.lit
    assert one(spark, fx.half_up(lit(2.5))) == 3.0 and one(spark, fx.half_up(lit(-2.5))) == -3.0
    assert one(spark, fx.js_round(lit(-2.5))) == -2
    assert str(one(spark, fx.coverage(lit("33.35").cast("decimal(18,2)"), lit(True)))) == "23.35"
    assert one(spark, fx.coverage(lit("33.35").cast("decimal(18,2)"), lit(False))) == 0
    assert one(spark, fx.insured(lit(""))) and not one(spark, fx.insured(lit("NONE")))
    assert not one(spark, fx.insured(lit(None).cast("string")))


def test_days(spark):
    assert one(spark, fx.day_label(F.lit("2024-04-05"))) == "Fri, Apr 05"
    assert days_ahead("2024-02-28", 3) == ["2024-02-28", "2024-02-29", "2024-03-01"]
    rows = with_slots(with_days(spark.range(2), "2024-12-31", 2))
    assert rows.count() == 48 and rows_of(rows.select("date").distinct()) == [("2024-12-31",), ("2025-01-01",)]


def test_badges(spark):
    badge = fx.availability_badge
    lit = F.lit
    assert one(spark, badge(lit(False), lit("09:00"), lit("17:00"))) == "Leave"
    assert one(spark, badge(lit(True), lit("09:00"), lit("17:00"))) == "Available"
    assert one(spark, badge(lit(True), lit("10:00"), lit("17:00"))) == "10:00-17:00"


@pytest.mark.parametrize("bits", [2, 18])
def test_positions_follow_sequence_order(spark, bits):
    rng = random.Random(bits)
    seqs = sorted({rng.choice([rng.randint(-40, 40), rng.randint(0, 1 << 45)]) for _ in range(300)})
    shuffled = seqs[:]
    rng.shuffle(shuffled)
    rows = spark.createDataFrame([(s,) for s in shuffled], "s BIGINT")
    got = dict(rows_of(ordering.positions(rows, "s", bits=bits)))
    assert got == {s: i + 1 for i, s in enumerate(seqs)}


@pytest.mark.parametrize("bits", [1, 2, 18])
def test_previous_in_key_crosses_blocks(spark, bits):
    rng = random.Random(bits)
    seqs = rng.sample(range(200), 120)
    # One key holds most rows; NULL values must stay apart from "no row before".
    rows = [(s, 1 if rng.random() < 0.6 else rng.randint(2, 9), rng.choice(["a", "b", None])) for s in seqs]
    df = spark.createDataFrame(rows, "s BIGINT, k BIGINT, v STRING")
    got = {r.s: (None if r.p is None else (r.p.value,))
           for r in ordering.previous_in_key(df, "k", "s", "v", "p", bits=bits).collect()}
    last, want = {}, {}
    for s, k, v in sorted(rows):
        want[s] = last.get(k)
        last[k] = (v,)
    assert got == want
