"""Dirty values as Column expressions: decimals, whole numbers, results, times, lists; what can't be read is null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result words that mean good and not good.
GOOD = ("OK", "PASS", "ĐẠT", "DAT", "TRUE", "1")
BAD = ("NG", "FAIL", "KHÔNG ĐẠT", "KHONG DAT", "FALSE", "0")
TIME_FORMS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def decimal(raw: Column, faithful: bool = False) -> Column:
    """Decimal comma or point: of two kinds of marks the last is the decimal one; a lone comma with three digits after
    it separates thousands (faithful: with two, as in the reference, which reads 12,61 as 1261)."""
    text = F.regexp_replace(raw, r"[^0-9,.\-]", "")
    comma, point = F.locate(",", F.reverse(text)), F.locate(".", F.reverse(text))
    both = (comma > 0) & (point > 0)
    one = F.length(F.regexp_replace(text, "[^,]", "")) == 1
    thousands = one & (comma == (3 if faithful else 4))
    plain = (
        F.when(both & (comma < point), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(text, F.lit(","), F.lit("")))
        .when((comma > 0) & thousands, F.replace(text, F.lit(","), F.lit("")))
        .when(comma > 0, F.replace(text, F.lit(","), F.lit(".")))
        .otherwise(text)
    )
    return plain.try_cast("double")


def whole(raw: Column, faithful: bool = False) -> Column:
    """Rounded half to even."""
    return F.bround(decimal(raw, faithful), 0).cast("long")


def result(raw: Column) -> Column:
    text = F.upper(F.trim(raw))
    return F.when(text.isin(*GOOD), "OK").when(text.isin(*BAD), "NG").otherwise(text)


def timestamp(raw: Column) -> Column:
    """Day-first forms before ISO forms."""
    text = F.trim(raw)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMS]).cast("timestamp_ntz")


def listed(raw: Column) -> Column:
    """A comma-separated list in a text as an array without blanks."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")


def header(name: str) -> str:
    """A column name without accents, marks and case."""
    flat = unicodedata.normalize("NFD", name.lower().replace("đ", "d"))
    return "".join(c for c in flat if c.isascii() and c.isalnum())


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
