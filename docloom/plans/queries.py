"""Queries over the input tables, one or more for each group of operators, with the SQL that gives the same rows.

Round trips render documents from relational rows and read them back; their SQL states the truth straight from the
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import identifiers as I
from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.functions import values as V
from docloom.operators import amounts as A
from docloom.operators.classify import classify
from docloom.operators.idcards import extract_id_cards
from docloom.operators.invoice import read_invoices, scan_candidates
from docloom.operators.lineitems import line_items, section_totals
from docloom.operators.lines import index_lines, plain_lines, with_zones
from docloom.operators.medical import extract_certificates
from docloom.operators.merge import merge_passes
from docloom.operators.rank import best, top_k
from docloom.operators.templates import TEMPLATE_SCHEMA, learn, lookup, quality, signatures
from docloom.plans import damaged
from docloom.plans.render import aadhaar_of, certificates, gstin_of, id_cards, invoices, money
from docloom.session import stored, table
from docloom.streaming.ingest import windowed_counts

AS_OF = "2025-01-01"
DIGIT_TO_LETTER, LETTER_TO_DIGIT = ("012568", "OIZSGB"), ("OIZSGB", "012568")


def as_of():
    return F.lit(AS_OF).cast("date")


def rendered(render: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents as a table, like documents that are read; else every use of a text would render it again."""
    return stored(render(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def invoice_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, parties, amounts and item count of every rendered invoice."""
    docs = rendered(invoices, spark, sf_dir)
    out = read_invoices(docs, stored(with_zones(index_lines(docs))), as_of(), scanned=False)
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(f"{c}_cents")
    return out.select(
        "doc_id", "invoice_number", V.parse_invoice_date(F.col("invoice_date")).cast("string").alias("invoice_date"), "vendor_name", "vendor_gstin",
        "buyer_name", "buyer_gstin", cents("subtotal"), cents("tax"), cents("total"), F.size("line_items").cast("long").alias("n_items"),
        cents("items_total"), F.col("words_total").cast("long").alias("words_total"), "status",
    )


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every rendered invoice. A text has one use here, so it is no table: as rendered, invoices are dealt by
    order already, and their lines need not be dealt again."""
    return line_items(with_zones(index_lines(invoices(spark, sf_dir))))


def line_item_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of every rendered invoice."""
    items = invoice_items(spark, sf_dir)
    cents = lambda c, n: F.round(F.col(c) * 100).cast("long").alias(n)
    return items.select("doc_id", "item_no", "description", "hsn", F.col("quantity").cast("long").alias("quantity"), cents("unit_price", "price_cents"), cents("amount", "amount_cents"))


def line_item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section score and the sum of each rendered invoice's items."""
    out = section_totals(invoice_items(spark, sf_dir)).where("items_total is not null")
    return out.select("doc_id", "score", F.round(F.col("items_total") * 100).cast("long").alias("items_cents"))


def amount_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotal and tax found again from nothing but the amounts of a text and its total. 2000 more than an order's price,
    so that no amount is too small to count."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.round(F.col("o_totalprice")).cast("long") + 2_000).alias("net"))
    tax = F.floor(F.col("net") * 18 / 100)
    text = F.concat_ws("\n", F.concat(F.lit("Some value "), F.col("net").cast("string")), F.concat(F.lit("Other value "), tax.cast("string")), F.concat(F.lit("Grand Total "), (F.col("net") + tax).cast("string")))
    docs = rows.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), (F.col("net") + tax).cast("double").alias("total"))
    found = A.reconstruct(A.amount_candidates(with_zones(index_lines(docs))), docs.select("doc_id", "total"))
    return found.select("doc_id", F.col("subtotal").cast("long").alias("subtotal"), F.col("tax").cast("long").alias("tax"))


def certificate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of every rendered certificate."""
    return extract_certificates(rendered(certificates, spark, sf_dir))


def id_card_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every rendered identity card."""
    out = extract_id_cards(rendered(id_cards, spark, sf_dir))
    return out.select("doc_id", "document_type", "name", "dob", "gender", "aadhaar_number", "pan_number", "father_name", "dl_number", "valid_from", "valid_to", "confidence")


def template_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates learnt from all invoices, then looked up for each: the vendor of the template that was found."""
    docs = rendered(invoices, spark, sf_dir)
    lines = stored(with_zones(index_lines(docs)))
    signed = stored(signatures(lines))
    records = quality(read_invoices(docs, lines, as_of(), scanned=False, itemised=False)).join(signed, "doc_id")
    store = stored(learn(spark.createDataFrame([], TEMPLATE_SCHEMA), records))
    return lookup(signed, store).join(store.select("template_id", "vendor_name"), "template_id").select("doc_id", "vendor_name")


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, pages, columns and characters of every document's line index."""
    lines = index_lines(documents(spark, sf_dir))
    count = lambda c: F.count(F.when(c, 1))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.max("page_no").cast("long").alias("n_pages"), count(F.col("col") == "LEFT").alias("n_left"),
        count(F.col("col") == "RIGHT").alias("n_right"), F.sum(F.length("text")).cast("long").alias("n_chars"),
    )


def zone_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document lie in each zone."""
    lines = with_zones(plain_lines(documents(spark, sf_dir)).withColumns({"page_no": F.lit(1), "x": F.lit(0), "y": F.col("line_no") * 22, "w": F.lit(24), "h": F.lit(18), "col": F.lit("FULL")}))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(f"n_{c[3:]}")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), count("in_top"), count("in_bottom"), count("in_table"))


def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of normalised, keyed and edge-stripped whole texts, and of their ASCII with look-alikes exchanged."""
    c = F.col("text")
    plain = F.regexp_replace(c, "[^ -~]", "")
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normalize_line(c)).alias("line"), F.md5(T.comparison_key(c)).alias("key"), F.md5(T.strip_edges(c)).alias("edges"), F.md5(T.digit_lookalikes(plain)).alias("digits"), F.md5(T.letter_lookalikes(plain)).alias("letters"))


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each keyword family how many lines of a document it fits."""
    lines = plain_lines(documents(spark, sf_dir)).withColumn("folded", P.folded(F.col("text")))
    fits = lambda words: F.count(F.when(P.holds_any(F.col("folded"), words), 1))
    return lines.groupBy("doc_id").agg(fits(P.BUSINESS).alias("business"), fits(P.GOVERNMENT).alias("government"), fits(P.BANK).alias("bank"), fits(P.ITEM_STOP).alias("item_stop"))


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every document and of every rendered card."""
    docs = documents(spark, sf_dir).select("doc_id", F.upper("text").alias("text")).unionByName(rendered(id_cards, spark, sf_dir).withColumn("doc_id", -1 - F.col("doc_id")))
    return classify(docs).select("doc_id", "document_type", "score_aadhaar", "score_pan", "score_driving_license")


def line_quality_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best lines of every document by quality, then place."""
    lines = plain_lines(documents(spark, sf_dir)).withColumn("quality", T.line_quality(F.col("text")))
    return top_k(lines, ["doc_id"], [F.desc("quality"), F.col("line_no")], 3).select("doc_id", "rank", "line_no", "quality")


def longest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each document's longest lines, by one aggregate."""
    lines = plain_lines(documents(spark, sf_dir)).withColumn("n", F.length("text"))
    return best(lines, ["doc_id"], [-F.col("n"), F.col("line_no")], ["line_no", "n"])


def pass_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of every page of a customer merged: the clean line of each key wins, in the order first seen."""
    key = F.col("c_custkey").cast("string")
    reading = lambda k, noise: F.struct(
        F.lit(k).alias("pass_no"), F.concat_ws("\n", F.concat(F.lit("CUSTOMER RECORD "), F.lit(noise)), F.concat(F.lit("ACCOUNT "), key, F.lit(" "), F.lit(noise)), F.lit("AB"), F.lit("? ? ? ?")).alias("text")
    )
    passes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page_no"), F.inline(F.array(reading(1, "' "), reading(2, ""), reading(3, "''"))))
    return merge_passes(passes)


def verhoeff_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers completed with their check digit, and whether they and their neighbours are valid."""
    df = table(spark, sf_dir, "customer").select("c_custkey", aadhaar_of(F.col("c_custkey")).alias("number"))
    wrong = F.concat(F.substring("number", 1, 11), ((F.substring("number", 12, 1).cast("int") + 1) % 10).cast("string"))
    return df.select("c_custkey", "number", I.is_aadhaar(F.col("number")).alias("valid"), I.is_aadhaar(wrong).alias("wrong_valid"), I.format_aadhaar(F.col("number")).alias("grouped"))


def gstin_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers completed with their check digit, and repaired after each digit and letter was read as its look-alike."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", gstin_of(F.col("s_suppkey")).alias("gstin"))
    g = F.col("gstin")
    damaged = F.concat(F.translate(F.substring(g, 1, 2), *DIGIT_TO_LETTER), F.substring(g, 3, 5), F.translate(F.substring(g, 8, 4), *DIGIT_TO_LETTER), F.substring(g, 12, 4))
    df = df.withColumn("damaged", damaged)
    return df.select("s_suppkey", "gstin", I.is_gstin(g).alias("valid"), I.gstin_checks(g).alias("checks"), I.repair_gstin(F.col("damaged")).alias("repaired"), I.pan_of_gstin(F.lit(None).cast("string"), g).alias("pan"), I.state_of_gstin(F.lit(None).cast("string"), g).alias("state"))


def gstin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded search for numbers whose last letter of the holder's code was misread."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", gstin_of(F.col("s_suppkey")).alias("gstin"))
    damaged = F.concat(F.substring("gstin", 1, 6), F.lit("2"), F.substring("gstin", 8, 8))
    return df.select("s_suppkey", I.search_gstin(damaged, F.lit(4096)).alias("found"))


def identifier_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAN, licence and bank codes with look-alikes put right; invoice numbers with a leading I."""
    key = F.col("c_custkey")
    digits = lambda n: F.translate(F.lpad((key % 10**n).cast("string"), n, "0"), *DIGIT_TO_LETTER)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", I.repair_pan(F.concat(F.lit("A8C0Z"), digits(4), F.lit("6"))).alias("pan"), I.repair_licence(F.concat(F.lit("T5"), digits(2), F.lit("2O15"), digits(7))).alias("licence"),
        I.repair_ifsc(F.concat(F.lit("ABCDO"), digits(6))).alias("ifsc"), I.repair_invoice_number(F.concat(F.lit("#I"), F.lpad(key.cast("string"), 5, "0"), F.lit("."))).alias("invoice"),
    )


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distances between each part's name and type."""
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("levenshtein"), I.positional_distance(F.col("p_name"), F.lower("p_type")).alias("places"))


def amount_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in three ways and read back, as hundredths, and plainly formatted."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    plain = money(F.col("cents"))
    grouped = F.regexp_replace(plain, r"(\d)(?=(\d{2})*\d{3}\.)", "$1,")
    way = F.col("l_linenumber") % 3
    written = F.when(way == 0, F.concat(F.lit("Rs. "), grouped)).when(way == 1, F.concat(F.lit("INR"), plain)).otherwise(F.replace(plain, F.lit("."), F.lit(",")))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents.alias("cents"), "l_quantity")
    value = V.parse_amount(written)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(value * 100).cast("long").alias("cents"), V.format_amount(value).alias("text"))


def amount_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals said in words and read back."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 37).cast("long").alias("n"))
    said = F.concat(F.lit("Amount chargeable (in words): Indian Rupees "), V.words_of_amount(F.col("n")), F.lit(" and paise twenty only"))
    return df.select("o_orderkey", V.amount_in_words(said).alias("n"))


def date_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in seven ways and read back; months with a 31st only sometimes exist."""
    way = F.col("o_orderkey") % 7
    forms = ("dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy", "dd-MMM-yyyy", "dd.MMM.yyyy", "yyyy-MM-dd", "d-MMM-yy")
    written = F.date_format("o_orderdate", forms[6])
    for k, f in enumerate(forms[:6]):
        written = F.when(way == k, F.date_format("o_orderdate", f)).otherwise(written)
    day = V.parse_invoice_date(F.col("written"))
    wrong = V.parse_invoice_date(F.regexp_replace("written", r"^\d{1,2}(?=[/.-])", "31"))
    medical = V.parse_medical_date(F.when(way < 4, F.col("written")))
    df = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return df.select("o_orderkey", day.alias("day"), V.is_invoice_date(F.col("written"), as_of()).alias("valid"), wrong.isNotNull().alias("has_31"), medical.alias("medical"))


def date_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All date-shaped texts in documents and in rendered cards."""
    docs = documents(spark, sf_dir).unionByName(rendered(id_cards, spark, sf_dir).withColumn("doc_id", -1 - F.col("doc_id")))
    c = F.col("text")
    return docs.select("doc_id", F.array_join(V.invoice_date_candidates(c), ",").alias("invoice"), F.array_join(V.id_dates(c), ",").alias("id")).where("invoice <> '' or id <> ''")


def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mail addresses, bank codes, vehicles, pincodes and account numbers each document's lines hold."""
    found = scan_candidates(plain_lines(documents(spark, sf_dir)))
    count = lambda f, n: F.count(F.when(F.col("field") == f, 1)).alias(n)
    out = found.groupBy("doc_id").agg(count("email", "mails"), count("ifsc", "codes"), count("vehicle", "vehicles"), count("pincode", "pincodes"), count("account", "accounts"))
    return out.where("mails + codes + vehicles + pincodes + accounts > 0")


def tax_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether amounts agree and whether a tax is at a usual rate."""
    sub, tax = F.col("l_extendedprice"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 2)
    total = sub + tax + F.col("l_linenumber") * 300
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        F.count(F.when(P.amounts_agree(sub, tax, total), 1)).alias("agree"), F.count(F.when(P.is_tax_rate(tax, sub), 1)).alias("usual")
    )


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: the streaming count over a table that is complete."""
    return windowed_counts(table(spark, sf_dir, "events"), F.col("event_type"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        invoice_round_trip, line_item_round_trip, line_item_scores, amount_reconstruction, certificate_round_trip, id_card_round_trip,
        template_round_trip, line_index, zone_sizes, text_cleaning, keyword_lines, classification, line_quality_top, longest_line, pass_merge,
        verhoeff_numbers, gstin_numbers, gstin_search, identifier_repair, distances, amount_parsing, amount_words, date_parsing, date_scan,
        entity_scan, tax_checks, event_windows,
    )
    return {f.__name__: f for f in own} | damaged.queries()
