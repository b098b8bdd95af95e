"""Validation messages and confidence of identity records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.identifiers import is_aadhaar, is_licence, is_pan
from docloom.functions.values import is_id_date


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def aadhaar_errors(c: Column) -> Column:
    """An array of messages; empty if the number is valid."""
    digits = F.regexp_replace(c, r"\s", "")
    shape = F.concat(F.lit("Invalid Aadhaar: must be 12 digits starting 2-9. Got: "), c)
    check = F.concat(F.lit("Invalid Aadhaar checksum. Got: "), c)
    message = F.when(_blank(c), "Aadhaar number not found").when(~digits.rlike(r"^[2-9]\d{11}$"), shape).when(~is_aadhaar(digits), check)
    return F.array_compact(F.array(message))


def pan_errors(c: Column) -> Column:
    message = F.when(_blank(c), "PAN number not found").when(~is_pan(c), F.concat(F.lit("Invalid PAN: must be AAAAA9999A. Got: "), c))
    return F.array_compact(F.array(message))


def licence_errors(c: Column) -> Column:
    message = F.when(_blank(c), "DL number not found").when(~is_licence(c), F.concat(F.lit("Invalid DL number format. Got: "), c))
    return F.array_compact(F.array(message))


def birth_date_errors(c: Column) -> Column:
    wrong = F.concat(F.lit("Invalid DOB format: "), c, F.lit(". Expected DD/MM/YYYY."))
    return F.array_compact(F.array(F.when(_blank(c), "Date of birth not found").when(~is_id_date(c), wrong)))


def optional_date_errors(c: Column, name: str) -> Column:
    """Blank is allowed."""
    return F.array_compact(F.array(F.when(~_blank(c) & ~is_id_date(c), F.concat(F.lit(f"Invalid {name} date: "), c))))


def name_errors(c: Column, label: str) -> Column:
    message = F.when(_blank(c), f"{label} not found").when(F.length(c) < 2, F.concat(F.lit(f"{label} too short: "), c))
    return F.array_compact(F.array(message))


def all_errors(*lists: Column) -> Column:
    """The lists one after another; null if there is no message."""
    joined = F.concat(*lists)
    return F.when(F.size(joined) > 0, joined)


def confidence_bucket(fields: list[Column], high: int, medium: int) -> Column:
    """HIGH, MEDIUM or LOW by the whole percentage of fields that were found."""
    found = F.size(F.array_compact(F.array(*fields)))
    percent = F.floor(found * 100 / len(fields))
    return F.when(percent >= high, "HIGH").when(percent >= medium, "MEDIUM").otherwise("LOW")
