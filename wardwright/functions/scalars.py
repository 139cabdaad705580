"""Scalar column functions. All are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardwright.schemas import CELL_WIDTH, DAY_END, DAY_START, INSURANCE_SHARE

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- null handling, numbers, money -------------------------------------------

def or_default(c: Column | str, default) -> Column:
    """NULL becomes `default`."""
    return F.coalesce(col(c), F.lit(default))


def money(c: Column | str) -> Column:
    return col(c).cast("decimal(18,2)")


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Round half away from zero."""
    return F.round(col(c), digits)


def js_round(c: Column | str) -> Column:
    """Round half towards positive infinity."""
    return F.floor(col(c) + F.lit(0.5))


def occupancy_percent(occupied: Column | str, total: Column | str) -> Column:
    """Whole percent, 0 for an empty group."""
    share = F.when(col(total) > 0, js_round(col(occupied) / col(total) * 100))
    return F.coalesce(share, F.lit(0)).cast("long")


def insured(insurance_id: Column | str) -> Column:
    """An empty id counts as insured; a missing one and the literal NONE do not."""
    return F.coalesce(col(insurance_id), F.lit("NONE")) != "NONE"


def coverage(total: Column | str, is_insured: Column) -> Column:
    share = F.round(money(total) * F.lit(INSURANCE_SHARE).cast("decimal(3,2)"), 2)
    return money(F.when(is_insured, share).otherwise(F.lit(0)))


# --- text --------------------------------------------------------------------

def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only, the case folding of SQLite's LIKE."""
    return F.translate(col(c), _UPPER, _LOWER)


def like_any_case(c: Column | str, term: str) -> Column:
    """Contains-search where `%` and `_` in the term are wildcards and a backslash is an ordinary character."""
    pattern = "%" + term.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"
    return ascii_lower(c).like(pattern)


def display_id(prefix: str, c: Column | str, width: int = 4) -> Column:
    """`P0001`-style id; longer numbers are kept whole."""
    return F.format_string(f"{prefix}%0{width}d", col(c))


def cell_text(c: Column | str, width: int = CELL_WIDTH) -> Column:
    """Report cell: NULL marker for missing or empty text, `...` after `width` characters."""
    text = col(c)
    return (F.when(text.isNull() | (text == ""), F.lit("NULL"))
             .when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("...")))
             .otherwise(text))


def extension(file_name: Column | str) -> Column:
    """Lower-cased text after the last dot; NULL when there is no dot."""
    name = col(file_name)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def indian_grouping(amount: Column | str) -> Column:
    """12345678.50 -> 1,23,45,678.5 : last three digits, then pairs; trailing zeros dropped."""
    text = money(amount).cast("string")
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(\d)(?=(\d\d)+\d$)", "$1,")
    cents = F.regexp_replace(F.substring_index(text, ".", -1), "0+$", "")
    return F.concat(whole, F.when(cents == "", F.lit("")).otherwise(F.concat(F.lit("."), cents)))


def rupees(amount: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("₹"), indian_grouping(amount)), F.lit("--"))


def minutes_text(c: Column | str) -> Column:
    """`30 min`, or `--` when missing or zero."""
    value = col(c)
    return F.when(value != 0, F.concat(value.cast("string"), F.lit(" min"))).otherwise(F.lit("--"))


# --- dates -------------------------------------------------------------------

def iso_date(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def iso_stamp(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def day_label(c: Column | str) -> Column:
    """`Fri, Apr 05`."""
    return F.date_format(col(c).cast("date"), "EEE, MMM dd")


def stamp(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


# --- availability ------------------------------------------------------------

def availability_badge(is_available: Column | str, start: Column | str, end: Column | str) -> Column:
    """Leave, the hours when they differ from the default day, otherwise Available."""
    custom = (col(start) != DAY_START) | (col(end) != DAY_END)
    return (F.when(~col(is_available), F.lit("Leave"))
             .when(custom, F.concat_ws("-", col(start), col(end)))
             .otherwise(F.lit("Available")))


def matrix_cell(is_available: Column | str, start: Column | str, end: Column | str) -> Column:
    """Admin matrix cell: Leave, the hours, or Default where there is no entry."""
    return (F.when(col(is_available).isNull(), F.lit("Default"))
             .when(~col(is_available), F.lit("Leave"))
             .otherwise(F.concat_ws("-", col(start), col(end))))
