"""Identifier grammar as Column expressions; blank becomes null, an unknown form stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted lot label forms and the group that holds the number.
LOT_FORMS = (
    (r"^QR(\d{6})([A-Z])(\d{3,4})$", 3),
    (r"^L[-_]([A-Z])[-_](\d{3,4})$", 2),
    (r"^([A-Z])\s*(\d{3,4})$", 2),
    (r"^LOT-(\d{3,4})-([A-Z])$", 1),
    (r"^LOT-(\d{3,4})$", 1),
)


def _clean(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when(text != "", text)


def _numbered(text: Column, forms, template: str, base: Column | None = None) -> Column:
    """The first form that matches, its number put into the template (which never cuts longer numbers)."""
    out = base
    for regex, group in forms:
        hit = text.rlike(regex)
        value = F.format_string(template, F.regexp_extract(text, regex, group).try_cast("int"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def lot_id(raw: Column) -> Column:
    text = _clean(raw)
    inner = F.regexp_extract(text, r"^QR-.*?(\d{3,4})", 1)
    return _numbered(text, LOT_FORMS, "LOT-%04d").when(text.rlike("^QR-.+$") & (inner != ""), F.format_string("LOT-%04d", inner.try_cast("int"))).otherwise(text)


def order_id(raw: Column) -> Column:
    text = _clean(raw)
    return _numbered(text, ((r"^JT-(\d{3,4})$", 1), (r"^JT[-_]?(\d+)$", 1)), "JT-%04d").otherwise(text)


def station_id(raw: Column) -> Column:
    text = _clean(raw)
    return F.when(text.startswith("STN-"), text).when(text.rlike("^[A-Z0-9]+$"), F.concat(F.lit("STN-"), text)).otherwise(text)


def product_id(raw: Column) -> Column:
    text = _clean(raw)
    return _numbered(text, ((r"^PROD-P(\d+)$", 1), (r"^P0?(\d+)$", 1)), "PROD-P%d").otherwise(text)


def component_id(raw: Column) -> Column:
    text = _clean(raw)
    return _numbered(text, ((r"^COMP-C(\d+)$", 1), (r"^ITEM_COMP-C(\d+)$", 1), (r"^C(\d+)$", 1)), "COMP-C%d").otherwise(text)


def batch_id(raw: Column) -> Column:
    text = _clean(raw)
    return F.when(text.rlike(r"^B\d{2}$"), F.concat(F.lit("BATCH-HT-"), text)).otherwise(text)


def digits_key(raw: Column) -> Column:
    """The first three or four digits, zero-filled to four; without digits the whole text."""
    found = F.regexp_extract(raw, r"(\d{3,4})", 1)
    return F.when(found == "", raw).otherwise(F.lpad(found, 4, "0"))
