"""Identifiers with check digits or fixed shapes: validity and repair, as Column expressions."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import DIGIT_LOOKALIKES, LETTER_LOOKALIKES, comparison_key, digit_lookalikes
from docloom.functions.values import bound

# --- Fixed values: the dihedral group of the Verhoeff check, its first permutation, and the state codes in use. ---
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
STATE_CODES = tuple(f"{n:02d}" for n in (*range(1, 39), 97))
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN_SHAPE = r"^\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
PAN_SHAPE = "^[A-Z]{5}[0-9]{4}[A-Z]$"
DL_LONG = r"^[A-Z]{2}[-\s]?[0-9]{2,3}[-\s]?[0-9]{4}[-\s]?[0-9]{7}$"
DL_COMPACT = "^[A-Z]{2}[0-9]{13,14}$"
GST_DIGIT = ("OQDILZSBGT", "0001125867")
GST_LETTER = ("01258679", "OIZSBGTQ")
GST_PAN_TAIL = ("01258679", "QIZSBGTQ")
CHECK_LOOKALIKES = ("OQDILR", "000112")
READINGS = {
    "0": "0OQD", "O": "O0QD", "Q": "QO0", "D": "DO0", "1": "1IL", "I": "I1L", "L": "L1I", "2": "2Z", "Z": "Z2", "5": "5S",
    "S": "S5", "8": "8B", "B": "B8", "6": "6G", "G": "G6", "7": "7T", "T": "T7", "9": "9Q0",
}
NUMBER_SHAPES = (
    (r"\d{3,5}", 100), (r"\d{6,12}", 55), (r"[A-Z]\d{3,8}", 120), (r"[A-Z]{2,10}\d{2,8}/\d{1,8}[A-Z]?", 115),
    (r"[A-Z]{1,4}[-/]?\d{2,8}[A-Z]?", 95), (r"[A-Z]{1,4}[-/]?[A-Z0-9]{2,8}", 60),
)
MOST_READINGS = 512
LEAST_NUMBER_SCORE = 55
# --- End of fixed values. ---


def _dihedral(a: int, b: int) -> int:
    """The product of two elements of the dihedral group of order ten, numbered 0 to 9."""
    i, j = a % 5, b % 5
    if a < 5:
        return (i + j) % 5 + (5 if b >= 5 else 0)
    return (i - j) % 5 + (0 if b >= 5 else 5)


def _verhoeff_tables() -> tuple[list[int], list[int]]:
    product = [_dihedral(a, b) for a in range(10) for b in range(10)]
    row = list(range(10))
    permuted = []
    for _ in range(8):
        permuted += row
        row = [VERHOEFF_PERMUTATION[x] for x in row]
    return product, permuted


PRODUCT, PERMUTED = _verhoeff_tables()


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def verhoeff(digits: Column, shift: int = 0) -> Column:
    """The Verhoeff checksum of a string of digits: 0 if its last digit checks. With shift 1, of digits still without one."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.element_at(_literal(PRODUCT), acc * 10 + F.element_at(_literal(PERMUTED), (i + shift) % 8 * 10 + digit + 1) + 1)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step))


def verhoeff_digit(body: Column) -> Column:
    """The digit to append to a string of digits so that it checks."""
    inverse = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]
    return F.element_at(_literal(inverse), verhoeff(body, 1) + 1).cast("string")


def aadhaar_digits(c: Column) -> Column:
    """The digits of a number, look-alike letters read as digits."""
    return F.regexp_replace(digit_lookalikes(c), "[^0-9]", "")


def is_aadhaar(c: Column) -> Column:
    """Twelve digits, the first 2 to 9, that check. False for null."""
    digits = aadhaar_digits(c)
    return F.coalesce(digits.rlike("^[2-9][0-9]{11}$") & (verhoeff(digits) == 0), F.lit(False))


def format_aadhaar(c: Column) -> Column:
    """Twelve digits in groups of four; anything else unchanged."""
    bare = F.regexp_replace(c, r"\s", "")
    return F.when(bare.rlike("^.{12}$"), F.regexp_replace(bare, r"^(.{4})(.{4})(.{4})$", "$1 $2 $3")).otherwise(c)


def repair_aadhaar(c: Column) -> Column:
    """The digits if they make a valid number, else null."""
    return F.when(is_aadhaar(c), aadhaar_digits(c))


def is_pan(c: Column) -> Column:
    return F.coalesce(c.rlike(PAN_SHAPE), F.lit(False))


def repair_pan(c: Column) -> Column:
    """Ten characters read by position: five letters, four digits, a letter; null if that gives no valid shape."""
    key = comparison_key(c)
    fixed = F.concat(
        F.translate(F.substring(key, 1, 5), *LETTER_LOOKALIKES),
        F.translate(F.substring(key, 6, 4), *DIGIT_LOOKALIKES),
        F.translate(F.substring(key, 10, 1), *LETTER_LOOKALIKES),
    )
    return F.when((F.length(key) == 10) & fixed.rlike(PAN_SHAPE), fixed)


def is_licence(c: Column) -> Column:
    return F.coalesce(c.rlike(DL_LONG) | F.regexp_replace(c, r"\s", "").rlike(DL_COMPACT), F.lit(False))


def repair_licence(c: Column) -> Column:
    """Fifteen or sixteen characters read by position: two letters, then digits; null if that gives no valid shape."""
    key = comparison_key(c)
    fixed = F.concat(F.translate(F.substring(key, 1, 2), *LETTER_LOOKALIKES), F.translate(F.substring(key, 3, 14), *DIGIT_LOOKALIKES))
    return F.when(F.length(key).between(15, 16) & fixed.rlike(DL_COMPACT), fixed)


def gstin_check_digit(body: Column) -> Column:
    """The fifteenth character for the first fourteen: base 36, weights 1 and 2 in turn, digits of products summed.

    The body is evaluated once: each place reads it, and it is often a long expression.
    """

    def character(b: Column) -> Column:
        products = [_base36(F.substring(b, i, 1)) * (2 - i % 2) for i in range(1, 15)]
        total = sum((F.floor(p / 36) + p % 36 for p in products), F.lit(0).cast("long"))
        return F.when(F.length(b) == 14, F.substring(F.lit(BASE36), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1)))

    return bound(body, character)


def _base36(c: Column) -> Column:
    code = F.ascii(c)
    return F.when(code >= 65, code - 55).otherwise(code - 48)


def gstin_checks(c: Column) -> Column:
    checks = bound(comparison_key(c), lambda key: (F.length(key) == 15) & (gstin_check_digit(F.substring(key, 1, 14)) == F.substring(key, 15, 1)))
    return F.coalesce(checks, F.lit(False))


def is_gstin(c: Column) -> Column:
    """The shape and a state code in use. The check digit is a matter of gstin_checks. False for null."""
    key = comparison_key(c)
    return F.coalesce(key.rlike(GSTIN_SHAPE) & F.substring(key, 1, 2).isin(*STATE_CODES), F.lit(False))


def is_gstin_like(c: Column) -> Column:
    """Fifteen characters that could be a number read badly, position by position."""
    key = comparison_key(c)
    digit, letter = "[0-9OQDILZSBTG]", "[A-Z01256789]"
    letters = F.length(F.regexp_replace(F.substring(key, 3, 5), f"[^{letter[1:-1]}]", ""))
    digits = F.length(F.regexp_replace(F.substring(key, 8, 4), f"[^{digit[1:-1]}]", ""))
    return F.coalesce(key.rlike(f"^{digit}{{2}}.{{9}}{letter}.[Z2].$") & (letters >= 4) & (digits >= 3), F.lit(False))


def positional_gstin(key: Column) -> Column:
    """The first fourteen characters read by position; the state code taken as it comes."""
    digits = lambda part: F.regexp_replace(F.translate(part, *GST_DIGIT), "[^0-9]", "0")
    entity = F.translate(F.substring(key, 13, 1), "ILOQD0", "111111")
    return F.concat(
        digits(F.substring(key, 1, 2)),
        F.translate(F.substring(key, 3, 5), *GST_LETTER),
        digits(F.substring(key, 8, 4)),
        F.translate(F.substring(key, 12, 1), *GST_PAN_TAIL),
        entity,
        F.lit("Z"),
    )


def nearest_state_code(code: Column) -> Column:
    """The code itself if in use, else the one in use that differs in the fewest places; of several the least."""
    codes = F.array(*[F.lit(s) for s in STATE_CODES])

    def nearest(own: Column) -> Column:
        far = lambda s: (F.substring(s, 1, 1) != F.substring(own, 1, 1)).cast("int") + (F.substring(s, 2, 1) != F.substring(own, 2, 1)).cast("int")
        return F.when(own.isin(*STATE_CODES), own).otherwise(F.array_min(F.transform(codes, lambda s: F.struct(far(s).alias("d"), s.alias("s"))))["s"])

    return bound(code, nearest)


def repair_gstin(c: Column) -> Column:
    """A valid number for a token read badly, or null.

    Kept if it is valid and checks. Else read by position, with the nearest state code; a last character that is one of
    the usual look-alikes is read as a digit, any other is recomputed.
    """
    stated = lambda body: F.concat(nearest_state_code(F.substring(body, 1, 2)), F.substring(body, 3, 12))

    def read(key: Column) -> Column:
        last = F.substring(key, 15, 1)

        def ended(body: Column) -> Column:
            look = F.concat(body, F.translate(last, *CHECK_LOOKALIKES))
            computed = bound(F.concat(body, gstin_check_digit(body)), lambda g: F.when(is_gstin(g), g))
            return F.when(last.rlike("[OQDILR]") & is_gstin(look), look).otherwise(F.coalesce(computed, F.when(is_gstin(key), key)))

        fixed = F.when(is_gstin(key) & gstin_checks(key), key).otherwise(bound(bound(positional_gstin(key), stated), ended))
        return F.when((F.length(key) == 15) & is_gstin_like(key), fixed)

    return bound(comparison_key(c), read)


def _allowed(character: str, at: int) -> bool:
    if at == 13:
        return character == "Z"
    if at == 12:
        return character.isalnum() and character != "0"
    return character.isalpha() if 2 <= at <= 6 or at == 11 else character.isdigit()


def _check_digit(body: str) -> str:
    total = 0
    for i, x in enumerate(body):
        product = BASE36.index(x) * (i % 2 + 1)
        total += product // 36 + product % 36
    return BASE36[-total % 36]


@F.pandas_udf(StringType())
def search_gstin(keys: pd.Series, most: pd.Series) -> pd.Series:
    """The valid number nearest to a 15-character key among at most `most` readings of its ambiguous characters."""

    def search(key: str | None, most: int) -> str | None:
        if key is None or len(key) != 15:
            return None
        options = [[o for o in READINGS.get(x, x) if _allowed(o, i)] for i, x in enumerate(key[:14])]
        best: tuple[int, str] | None = None
        for body in itertools.islice(itertools.product(*options), most):
            body = "".join(body)
            if body[:2] in STATE_CODES:
                found = body + _check_digit(body)
                distance = sum(a != b for a, b in zip(key, found, strict=True))
                if best is None or distance < best[0]:
                    best = (distance, found)
        return best[1] if best else None

    return pd.Series([search(k, n) for k, n in zip(keys, most, strict=True)], dtype=object)


def positional_distance(a: Column, b: Column) -> Column:
    """How many places two strings differ in, plus the difference of their lengths."""
    n = F.least(F.length(a), F.length(b))
    differ = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(n > 0, differ).otherwise(0) + F.abs(F.length(a) - F.length(b))


def pan_of_gstin(pan: Column, gstin: Column) -> Column:
    """The number itself if valid, else the one inside a valid GSTIN."""
    return F.when(is_pan(pan), pan).when(is_gstin(gstin), F.substring(comparison_key(gstin), 3, 10))


def state_of_gstin(code: Column, gstin: Column) -> Column:
    """A state code in two digits, else the one that a GSTIN begins with."""
    own = F.when(code.rlike(r"^\d{1,2}$"), F.lpad(code, 2, "0"))
    return F.coalesce(own, F.when(is_gstin(gstin), F.substring(comparison_key(gstin), 1, 2)))


def repair_ifsc(c: Column) -> Column:
    """Eleven characters read by position: four letters, a zero, six letters or digits; else null."""
    key = comparison_key(c)
    fixed = F.concat(F.translate(F.substring(key, 1, 4), *LETTER_LOOKALIKES), F.translate(F.substring(key, 5, 7), *DIGIT_LOOKALIKES))
    return F.when((F.length(key) == 11) & fixed.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), fixed)


def is_invoice_number(c: Column) -> Column:
    """Up to twenty characters: up to twelve digits, or letters and digits together with dashes and slashes."""
    mixed = c.rlike("[A-Za-z]") & c.rlike("[0-9]") & c.rlike("^[A-Za-z0-9/-]+$")
    return F.coalesce(F.length(c).between(1, 20) & (c.rlike(r"^\d{1,12}$") | mixed), F.lit(False))


def repair_invoice_number(c: Column) -> Column:
    """Edges stripped, upper case, and a leading I or L before digits only read as 1."""
    token = F.upper(F.regexp_replace(c, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.when(token.rlike(r"^[IL]\d{2,11}$"), F.regexp_replace(token, "^[IL]", "1")).otherwise(token)


def _number_score(token: str, read: str) -> int | None:
    """How good a reading of a token is as an invoice number; None if it is none."""
    digits = read.isdecimal()
    if not (digits and 3 <= len(read) <= 12) and not (re.fullmatch("[A-Z0-9/-]{1,20}", read) and re.search("[A-Z]", read) and re.search(r"\d", read)):
        return None
    if re.fullmatch(r"\d{1,2}([/-])(\d{1,2}|[A-Z]{3,9})\1\d{2,4}", read):
        return None
    score = next((points for shape, points in NUMBER_SHAPES if re.fullmatch(shape, read)), 0)
    score -= 80 * read.startswith("NO") + 40 * read.endswith(("-", "/"))
    if token.isdecimal():
        score += 40 if digits else -25
    differ = sum(a != b for a, b in zip(token, read, strict=True))
    return score - 6 * differ + 2 * (len(read) - differ)


@F.pandas_udf(StringType())
def search_invoice_number(tokens: pd.Series) -> pd.Series:
    """The best of up to MOST_READINGS readings of each token as an invoice number; the token itself if none is good.

    Ties go to the reading found first, the token's own characters before others.
    """

    def search(token: str | None) -> str | None:
        if token is None:
            return None
        token = re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", token).upper()
        if re.fullmatch(r"[IL]\d{2,11}", token):
            return "1" + token[1:]
        if not 1 <= len(token) <= 20 or re.fullmatch(GSTIN_SHAPE, token):
            return token
        readings = itertools.product(*[x if x in "/-" else READINGS.get(x, x) for x in token])
        best, found = None, token
        for read in itertools.islice(("".join(r) for r in readings), MOST_READINGS):
            score = _number_score(token, read)
            if score is not None and (best is None or score > best):
                best, found = score, read
        return found if best is not None and best >= LEAST_NUMBER_SCORE else token

    return tokens.map(search)
