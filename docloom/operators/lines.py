"""Documents as indexed lines, with columns, pages and overlapping zones: the fact table of all extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions.text import as_text

CHAR, ROW, HEIGHT, PAGE = 8, 22, 18, 10_000
SECTION, JUMP = 18, 220
#: A row of words with one blank between two, and any before the first. What ends lines in patterns is left to the long way.
PLAIN_ROW = r"^ *+[^\\s\\x85\\u2028\\u2029]++(?: [^\\s\\x85\\u2028\\u2029]++)*+\\z"


def combined_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): a document's pages in order of page_no, blank ones left out, with a form feed between them."""
    shown = pages.where(F.trim(as_text(F.col("text"))) != "")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return shown.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\f").alias("text"))


def page_roles(pages: DataFrame) -> DataFrame:
    """pages with role: only, first, middle or last."""
    w = Window.partitionBy("doc_id")
    lo, hi = F.min("page_no").over(w), F.max("page_no").over(w)
    no = F.col("page_no")
    return pages.withColumn("role", F.when(lo == hi, "only").when(no == lo, "first").when(no == hi, "last").otherwise("middle"))


def index_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_no, text, x, y, w, h, col): a row for each block of a line.

    Pages end at form feeds, rows at line ends, blocks at three blanks or more. line_no counts blocks through the
    document; x and w are places in the row, y the place on the page, col FULL, LEFT or RIGHT. Blank rows do not
    count. Everything happens inside a document's row: no shuffle.
    """
    blocks = r"regexp_extract_all(row, '\\S(?:.*?\\S)?(?=\\s{3,}|$)', 0)"
    starts = (
        "aggregate(b, named_struct('s', cast(array() as array<int>), 'p', 1), "
        "(a, t) -> named_struct('s', concat(a.s, array(locate(t, row, a.p))), 'p', locate(t, row, a.p) + length(t))).s"
    )
    block = lambda text, x, col: (
        f"named_struct('page_no', pi + 1, 'text', {text}, 'x', {x} * {CHAR}, 'y', pi * {PAGE} + ri * {ROW}, "
        f"'w', greatest(24, length(t) * {CHAR}), 'h', {HEIGHT}, 'col', {col})"
    )
    one = block("trim(regexp_replace(t, '\\\\s+', ' '))", "(s[k] - 1)", "if(size(b) = 1, 'FULL', if(k = 0, 'LEFT', 'RIGHT'))")
    in_row = f"transform(array({blocks}), b -> transform(array({starts}), s -> transform(b, (t, k) -> {one}))[0])[0]"
    # Most rows have words with single blanks between: one block, which is the row without the blanks before it.
    whole = block("t", "(length(row) - length(t))", "'FULL'")
    in_row = f"if(row rlike '{PLAIN_ROW}', transform(array(ltrim(row)), t -> {whole}), {in_row})"
    rows = r"filter(transform(split(page, '\n'), r -> replace(r, '\t', ' ')), r -> r rlike '\\S')"
    nested = f"flatten(transform(split(_t, '\f'), (page, pi) -> flatten(transform({rows}, (row, ri) -> {in_row}))))"
    text = F.regexp_replace(as_text(F.col("text")), "\r\n?", "\n")
    out = docs.select("doc_id", text.alias("_t")).select("doc_id", F.posexplode(F.expr(nested)).alias("i", "l"))
    return out.select("doc_id", (F.col("i") + 1).alias("line_no"), "l.page_no", "l.text", "l.x", "l.y", "l.w", "l.h", "l.col")


def plain_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): the non-blank lines, trimmed, numbered from 1."""
    rows = F.filter(F.transform(F.split(as_text(F.col("text")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(rows).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line_no"), "text")


def _first(condition: Column, value: Column, w) -> Column:
    return F.min(F.when(condition, value)).over(w)


def with_zones(lines: DataFrame) -> DataFrame:
    """lines with n_lines, the document's anchors and flags in_top, in_middle, in_table, in_bottom, and zone.

    Anchors: table_header, total_line and tax_line (null if absent), header_end, footer_start. The flags may overlap;
    zone is the one of them that counts for a line by itself: TOP before BOTTOM before TABLE before MIDDLE. Also
    folded (see predicates), buyer_line, the last buyer header down to the line, and first_buyer. All windows share one
    partitioning by doc_id, and move no more than a line's own small columns.
    """
    doc = Window.partitionBy("doc_id")
    seq = doc.orderBy("line_no")
    upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    no, n, form = F.col("line_no"), F.col("n_lines"), F.col("folded")
    text = F.lower("text")
    df = lines.withColumns({"folded": P.folded(F.col("text")), "_words": P.header_words(text)})
    # The costly look at a line's parts is only for lines that hold the words at all.
    may_open = P.holds_any(form, P.BUYER_SECTION) | text.rlike(r"(?:^|\|)\s*(?:invoice )?to[,:.]?\s*(?:\||$)")
    df = df.withColumns(
        {
            "is_header": F.bit_count("_words") >= 2,
            "_total": P.holds_any(form, P.TOTAL_LINE) | (text.rlike(r"^total\b") & ~text.contains("to be taxed")),
            "_tax": text.contains("igst") | text.contains("cgst") | text.contains("sgst") | text.contains("tax"),
            "is_buyer_header": F.when(may_open, P.is_buyer_header(text)).otherwise(False),
            "_stop": P.holds_any(form, P.ITEM_STOP),
            "_footer": P.holds_any(form, P.FOOTER),
        }
    )
    df = df.withColumns({"n_lines": F.count("*").over(doc), "_2": F.lead("_words", 1).over(seq), "_3": F.lead("_words", 2).over(seq)})
    two = F.coalesce(F.bit_count(F.col("_words").bitwiseOR(F.col("_2"))) >= 2, F.lit(False))
    three = F.coalesce(F.bit_count(F.col("_words").bitwiseOR(F.col("_2")).bitwiseOR(F.col("_3"))) >= 2, F.lit(False))
    header = F.when(F.col("is_header"), no).when(two, no + 1).when(three & (F.bit_count("_2") >= 2), no + 1).when(three & (F.bit_count("_3") >= 2), no + 2)
    df = df.withColumn("_hit", header).drop("_words", "_2", "_3")
    at = F.min(F.when(F.col("_hit").isNotNull(), F.struct(no.alias("i"), F.col("_hit").alias("h")))).over(doc)
    df = df.withColumn("table_header", at["h"])
    df = df.withColumns(
        {
            "total_line": _first(F.col("_total") & (no > F.coalesce("table_header", F.lit(0))), no, doc),
            "tax_line": _first(F.col("_tax") & (no > n - 30), no, doc),
            "_cut": _first((no > 1) & (F.col("is_buyer_header") | F.col("is_header")), no, doc),
            "_strong": _first(F.col("_footer") & (no > n - 25), no, doc),
        }
    )
    size = F.least(F.greatest(F.lit(12), F.ceil(n * 0.25)), F.lit(25))
    size = F.when(F.col("table_header") > 1, F.least(size, F.col("table_header"))).otherwise(size)
    end = F.least(F.greatest(F.lit(1), F.least(size, n)), F.coalesce("_cut", n))
    foot = F.greatest(F.lit(0), n - F.least(F.greatest(F.lit(15), F.ceil(n * 0.30)), F.lit(40)))
    foot = F.when(F.col("total_line").isNotNull(), F.least(foot, F.greatest(F.lit(0), F.col("total_line") - 3))).otherwise(foot)
    df = df.withColumns({"header_end": end.cast("int"), "footer_start": (F.least(foot, F.coalesce(F.col("_strong") - 1, foot)) + 1).cast("int")})
    upper = F.coalesce("table_header", "total_line", "footer_start")
    # A buyer header reaches down to the next header or stop line, and no further than where lines of another column
    # begin far below it. Places go down the page, so the last line of each column tells.
    anchor = F.when(F.col("is_buyer_header"), F.struct(no.alias("i"), F.col("y"), F.col("col")))
    columns = ("FULL", "LEFT", "RIGHT")
    df = df.withColumns(
        {
            "_near": F.collect_list(anchor).over(seq.rowsBetween(-(SECTION - 1), 0)),
            "_last": F.coalesce(F.max(F.when(F.col("is_header") | F.col("_stop"), no)).over(upto), F.lit(0)),
            "buyer_line": F.max(F.when(F.col("is_buyer_header"), no)).over(upto),
            "first_buyer": F.min(F.when(F.col("is_buyer_header"), no)).over(doc),
            **{f"_y_{c}": F.coalesce(F.max(F.when(F.col("col") == c, F.col("y"))).over(upto), F.lit(-1)) for c in columns},
        }
    )
    far = lambda a: F.greatest(*[F.when(a["col"] != c, F.col(f"_y_{c}")).otherwise(-1) for c in columns]) > a["y"] + JUMP
    inside = F.exists("_near", lambda a: (F.col("_last") <= a["i"]) & ~far(a)) & (no < upper)
    df = df.withColumn("_inside", inside).drop(*[f"_y_{c}" for c in columns], "_last")
    any_inside = F.max("_inside").over(doc)
    table_end = F.when(F.col("total_line") > F.col("table_header"), F.col("total_line")).otherwise(F.col("footer_start"))
    df = df.withColumns(
        {
            "in_top": no <= F.col("header_end"),
            "in_bottom": no >= F.col("footer_start"),
            "in_table": F.coalesce((no > F.col("table_header")) & (no < table_end), F.lit(False)),
            "in_middle": F.col("_inside") | (~any_inside & (no > F.col("header_end")) & (no < upper)),
        }
    )
    in_rows = (no >= F.col("table_header")) & (F.col("total_line").isNull() | (no < F.col("total_line")))
    zone = F.when(F.col("in_top"), "TOP").when(F.col("in_bottom"), "BOTTOM").when(in_rows, "TABLE").otherwise("MIDDLE")
    return df.withColumn("zone", zone).drop("_hit", "_total", "_tax", "_stop", "_footer", "_cut", "_strong", "_near", "_inside")


def take_while_open(lines: DataFrame, start: Column, stop: Column, name: str) -> DataFrame:
    """lines with a flag: after the document's first `start` line, and before the next `stop` line."""
    doc = Window.partitionBy("doc_id")
    df = lines.withColumn("_from", F.min(F.when(start, F.col("line_no"))).over(doc))
    df = df.withColumn("_to", F.min(F.when(stop & (F.col("line_no") > F.col("_from")), F.col("line_no"))).over(doc))
    inside = (F.col("line_no") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to")))
    return df.withColumn(name, F.coalesce(inside, F.lit(False))).drop("_from", "_to")
