import pytest
from pyspark.sql import functions as F

from docloom.functions import identifiers as I
from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.functions import values as V


@pytest.fixture(scope="module")
def of(spark):
    """Apply a function of one Column to some values."""

    def run(function, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").select("x").collect()]

    return run


def test_cleaning(of):
    assert of(T.normalize_line, " a \t b\n", None, "") == ["a b", "", ""]
    assert of(T.comparison_key, "Ab-c 1!", None) == ["ABC1", ""]
    assert of(T.strip_edges, "--a-b:.", "...") == ["a-b", ""]
    assert of(T.digit_lookalikes, "oqdilzsbg", None) == ["000112586", None]
    assert of(T.letter_lookalikes, "012568x") == ["OIZSGBX"]
    assert of(T.clean_id_text, "g0vt of india\n\x01 D0B: O1/O2/199O \n\n~~ ts0920150001234", None) == ["GOVT OF INDIA\nDOB: 01/02/1990\nTS0920150001234", ""]
    assert of(T.clean_invoice_text, "A\tB    C\r\n\n\n\n“x” — 1, 234: 5", None) == ['A | B | C\n"x" - 1,234 : 5', ""]
    assert of(lambda c: T.clean_invoice_text(c, compose=True), "ﬁne ①") == ["fine 1"]
    assert of(T.clean_medical_text, "a  b  c word ### ") == ["abc word"]
    assert of(T.repair_characters, "1OOO SI5 OO1 Il", "I O S") == ["1000 S15 O01 Il", "I O S"]
    assert of(T.correct_words, "Fiitness ceftify") == ["fitness certify"]
    assert of(T.collapse_repeats, "A B, a b, C", "X Y X Y") == ["A B, C", "X Y"]
    assert of(lambda c: T.redact(c, F.array(F.lit("AB12"))), "x A B 1 2 y") == ["x  ###  y"]
    assert of(lambda c: T.truncate_at(c, ("dated", "code")), "Some Ltd Dated 1", "dated x", "none") == ["Some Ltd", "dated x", "none"]
    assert of(lambda c: T.fragments(c, (("dated",), ("code",))), "A | B Dated 1") == [["A", "B", "Dated 1", "B Dated 1", "A | B Dated 1"]]


def test_predicates(of):
    assert of(lambda c: P.contains_any(c, ("grand total",)), "GRAND-TOTAL 5", "gr4nd", "grand t0tal", None) == [True, False, True, False]
    assert of(P.is_address_like, "12, MG Road", "Plot Street", "x@y", "500001", "hello", None) == [True, True, True, True, False, False]
    assert of(P.is_table_header, "Item Qty Rate", "unit value", "Description") == [True, False, False]
    assert of(P.is_buyer_header, "Bill To", "To,", "Buyer's Order No", "Original for buyer", "x | Ship To | y", None) == [True, True, False, False, True, False]
    assert of(P.is_uppercase_line, "ALPHA BETA GAMMA", "alpha beta", "AB") == [True, False, False]
    assert of(P.is_tax_line, "CGST 9%", "Taxable Value", "GST 18 %") == [True, False, True]
    near = lambda c: P.roughly_equal(c.cast("double"), F.lit(100.0))
    assert of(near, "101.9", "103", None) == [True, False, False]
    assert of(lambda c: P.is_tax_rate(c.cast("double"), F.lit(100.0)), "18", "9", "0") == [True, False, False]


def test_identifiers(of):
    good = of(lambda c: F.concat(c, I.verhoeff_digit(c)), "23456789012")[0]
    assert of(I.is_aadhaar, good, good[:-1] + str((int(good[-1]) + 1) % 10), "1" + good[1:], None) == [True, False, False, False]
    assert of(I.format_aadhaar, good) == [f"{good[:4]} {good[4:8]} {good[8:]}"]
    assert of(I.verhoeff_digit, "236") == ["3"]
    assert of(I.repair_pan, "A8CDE12E4F", "ABCDEI234F", "short") == [None, "ABCDE1234F", None]
    assert of(I.repair_licence, "TS0920150001234", "T5O92O15OOO1234", "X") == ["TS09201500" + "01234", "TS0920150001234", None]
    body = "27ZZZZZ0001Z1Z"
    full = body + of(I.gstin_check_digit, body)[0]
    assert of(I.is_gstin, full, body + "?", "99" + full[2:], None) == [True, False, False, False]
    assert of(I.gstin_checks, full, body + ("0" if full[-1] != "0" else "1")) == [True, False]
    assert of(I.repair_gstin, full, full.replace("0001", "OOOI"), "NOISE", None) == [full, full, None, None]
    assert of(lambda c: I.search_gstin(c, F.lit(4096)), full) == [full]
    assert of(I.nearest_state_code, "27", "99", "40") == ["27", "09", "10"]
    assert of(lambda c: I.positional_distance(c, F.lit("abcd")), "abxd", "ab", "") == [1, 2, 4]
    assert of(I.is_invoice_number, "INV-1", "123", "ABC", "1234567890123", None) == [True, True, False, False, False]
    assert of(I.search_invoice_number, "B5B4", "I23", "??", None) == ["B584", "123", "", None]
    assert of(I.repair_ifsc, "ABCDO12345S", "bad") == ["ABCD0123455", None]


def test_amounts(of):
    assert of(lambda c: V.parse_amount(c).cast("string"), "1,23,456.50", "Rs. 500", "12,50", "1,234", "1234567890123", "x", None) == ["123456.5000", "500.0000", "12.5000", "1234.0000", None, None, None]
    assert of(lambda c: V.format_amount(V.parse_amount(c)), "100", "1.50", "0.25") == ["100", "1.5", "0.25"]
    assert of(V.numeric_tokens, "5 x 1,000.50 = 5,002.50 A12") == [["5", "1,000.50", "5,002.50"]]
    assert of(lambda c: F.transform(V.amounts(c), lambda a: a["token"]), "IGST 180% 1,800.00 50", "Bank 5000") == [["180", "1,800.00"], []]
    assert of(lambda c: F.transform(V.amounts(c), lambda a: a["percent"]), "IGST 180 % 1,800.00") == [[True, False]]
    assert of(V.amount_in_words, "Indian Rupees One Lakh Twenty Three Thousand Four Hundred Fifty Six and Paise Ten Only", "no number", None) == [123456, None, None]
    assert of(lambda c: V.amount_in_words(V.words_of_amount(c.cast("long"))), "0", "19", "100", "90017", "12345678") == [0, 19, 100, 90017, 12345678]


def test_dates(of):
    day = lambda f: lambda c: f(c).cast("string")
    assert of(day(V.parse_invoice_date), "5/4/2026", "05-Apr-26", "31-04-2026", "2026-04-05", "5.4.26", "5/4/26", None) == ["2026-04-05", "2026-04-05", None, "2026-04-05", "2026-04-05", None, None]
    assert of(day(V.parse_medical_date), "1 January, 2024", "O1/02/2O24", "1-Feb-24", "45/78/9999") == ["2024-01-01", "2024-02-01", "2024-02-01", None]
    assert of(V.normalize_id_date, "O1/2/1990", "none") == ["01/02/1990", "N0NE"]
    assert of(V.is_id_date, "31/02/2000", "1/1/2000", "2000-01-01", "32/01/2000", "01.01.2000", None) == [True, True, True, False, True, False]
    assert of(lambda c: V.is_invoice_date(c, F.lit("2025-01-01").cast("date")), "01/04/2025", "02/04/2025", "01/01/1999") == [True, False, False]
    assert of(lambda c: V.repair_future_date(c, F.lit("2025-01-01").cast("date")).cast("string"), "01/05/2034", "01/05/2024") == ["2024-05-01", "2024-05-01"]
    assert of(V.day_count_word, "Twenty-One", "five", "none") == [21, 5, None]
