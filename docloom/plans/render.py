"""Documents with known contents, rendered from the relational tables: what the extractors are checked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.identifiers import gstin_check_digit, verhoeff_digit
from docloom.functions.values import words_of_amount
from docloom.session import table

DIGITS, LETTERS = "0123456789", "BCDFGHJKLM"


def letters_of(key: Column, width: int = 4) -> Column:
    """A key spelt with letters."""
    return F.translate(F.lpad(key.cast("string"), width, "0"), DIGITS, LETTERS)


def gstin_of(key: Column) -> Column:
    """A number that checks, for a key."""
    state = F.lpad((key % 37 + 1).cast("string"), 2, "0")
    body = F.concat(state, F.lit("ZZZZZ"), F.lpad((key % 10_000).cast("string"), 4, "0"), F.lit("Z1Z"))
    return F.concat(body, gstin_check_digit(body))


def aadhaar_of(key: Column) -> Column:
    body = F.concat(F.lit("2"), F.lpad(key.cast("string"), 10, "0"))
    return F.concat(body, verhoeff_digit(body))


def money(cents: Column) -> Column:
    """Whole cents as text with two decimals."""
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def vendor_name(key: Column) -> Column:
    return F.concat(F.lit("VENDOR "), letters_of(key), F.lit(" INDUSTRIES LIMITED"))


def buyer_name(key: Column) -> Column:
    return F.concat(F.lit("CLIENT "), letters_of(key, 6), F.lit(" RETAIL SOLUTIONS LLP"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, l_linenumber, name, hsn, quantity, price, cents): one item for each order and line number, in whole cents."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    one = items.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("i"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    df = one.join(parts, F.col("i.l_partkey") == F.col("p_partkey"))
    price = F.round(F.col("p_retailprice") * 100).cast("long")
    quantity = F.col("i.l_quantity").cast("long") + 1
    return df.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("i.l_suppkey").alias("suppkey"), F.col("p_name").alias("name"),
        (F.col("p_partkey") % 9_000 + 1_000).cast("string").alias("hsn"), quantity.alias("quantity"), price.alias("price"), (quantity * price).alias("cents"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): an invoice for every order with items, with 9 % of two taxes each."""
    line = F.concat_ws(" ", "name", "hsn", F.col("quantity").cast("string"), money(F.col("price")), money(F.col("cents")))
    items = order_lines(spark, sf_dir).groupBy("o_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n").alias("rows"),
        F.sum("cents").alias("sub"),
        F.min("suppkey").alias("suppkey"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    df = orders.join(items, "o_orderkey").withColumn("half", F.floor((F.col("sub") * 9 + 50) / 100).cast("long"))
    df = df.withColumn("total", F.col("sub") + 2 * F.col("half"))
    day = F.date_format(F.add_months("o_orderdate", 120), "dd-MMM-yyyy")
    text = F.concat_ws(
        "\n",
        vendor_name(F.col("suppkey")), F.lit("Plot 44 Industrial Estate"), F.concat(F.lit("GSTIN: "), gstin_of(F.col("suppkey"))), F.lit("Tax Invoice"),
        F.concat(F.lit("Invoice No: INV"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")), F.concat(F.lit("Date: "), day), F.lit(""),
        F.lit("Bill To"), buyer_name(F.col("o_custkey")), F.lit("21 Market Street"), F.concat(F.lit("GSTIN: "), gstin_of(F.col("o_custkey") + 5_000)), F.lit(""),
        F.lit("Item Description HSN Qty Rate Amount"), F.col("rows"),
        F.concat(F.lit("Taxable Value "), money(F.col("sub"))), F.concat(F.lit("CGST 9% "), money(F.col("half"))),
        F.concat(F.lit("SGST 9% "), money(F.col("half"))), F.concat(F.lit("Grand Total "), money(F.col("total"))),
        F.concat(F.lit("Amount in words: Indian Rupees "), words_of_amount(F.floor(F.col("total") / 100)), F.lit(" only")),
        F.lit("Bank Details: Some Bank A/C 123456789012"),
    )
    return df.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): two pages of a leave certificate for every customer."""
    key = F.col("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (key % 300).cast("int"))
    end = F.date_add(start, (key % 20).cast("int"))
    form = lambda d: F.when(key % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(key % 3 == 1, F.date_format(d, "dd-MMM-yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    first = F.concat_ws(
        "\n",
        F.concat(F.lit("CITY "), letters_of(key), F.lit(" HOSPITAL")), F.lit("Medical Leave Certificate"),
        F.concat(F.lit("This is to certify that Mr. Ravi Na"), F.lower(letters_of(key)), F.lit(" is suffering from viral fever.")),
        F.concat(F.lit("He is advised rest from "), form(start), F.lit(" to "), form(end), F.lit(".")),
    )
    second = F.concat_ws("\n", F.concat(F.lit("Period of absence "), (key % 20 + 1).cast("string"), F.lit(" days")), F.lit("Doctor Signature"), F.lit("Reg No 12345"))
    pages = F.array(F.struct(F.lit(1).alias("page_no"), first.alias("text")), F.struct(F.lit(2).alias("page_no"), second.alias("text")))
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.inline(pages))


def id_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a card for every customer: Aadhaar, PAN or driving licence by the key's remainder."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("RAVI "), F.translate(letters_of(key, 6), "BCDFGHJ", "AEIOURN"), F.lit(" DEVA"))
    born = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (key % 9_000).cast("int")), "dd/MM/yyyy")
    number = aadhaar_of(key)
    grouped = F.concat_ws(" ", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 4))
    aadhaar = F.concat_ws("\n", F.lit("GOVERNMENT OF INDIA"), name, F.concat(F.lit("DOB: "), born), F.lit("MALE"), grouped, F.lit("ADDRESS: S/O SOMEBODY"), F.lit("12-3 TEST ROAD 500001"))
    pan = F.concat(F.lit("ABCPZ"), F.lpad((key % 10_000).cast("string"), 4, "0"), F.lit("Q"))
    pan_text = F.concat_ws("\n", F.lit("INCOME TAX DEPARTMENT"), F.lit("GOVT OF INDIA"), name, F.lit("MOHAN ARAV DEVA"), born, F.lit("PERMANENT ACCOUNT NUMBER"), pan)
    dl = F.concat(F.lit("TS"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("2015"), F.lpad(key.cast("string"), 7, "0"))
    dl_text = F.concat_ws("\n", F.lit("DRIVING LICENCE"), F.concat(F.lit("DL NO "), dl), F.concat(F.lit("NAME: "), name), F.concat(F.lit("DOB: "), born), F.lit("VALID FROM: 01/02/2015"), F.lit("VALID TO: 31/01/2035"))
    text = F.when(key % 3 == 0, aadhaar).when(key % 3 == 1, pan_text).otherwise(dl_text)
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), text.alias("text"))
