"""What kind of document a text is, and which pages of a certificate matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import as_text

# --- Fixed values: signals of the document kinds and weights of certificate pages. ---
SIGNALS = {
    "AADHAAR": (
        "UNIQUE IDENTIFICATION AUTHORITY OF INDIA", "UIDAI", "AADHAAR", "AADHAR", "ADHAR", "GOVERNMENT OF INDIA",
        "ENROLLMENT NO", "ENROLMENT NO", "VID",
    ),
    "PAN": ("INCOME TAX DEPARTMENT", "PERMANENT ACCOUNT NUMBER", "GOVT OF INDIA", "INCOME TAX", "PAN"),
    "DRIVING_LICENSE": (
        "DRIVING LICENCE", "DRIVING LICENSE", "DL NO", "DL NUMBER", "VALID FROM", "VALID TILL", "VALID TO",
        "TRANSPORT DEPARTMENT", "MOTOR VEHICLES", "LICENSE NO", "LICENCE NO", "COV", "BLOOD GROUP",
    ),
}
SHAPES = {
    "AADHAAR": (r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b",),
    "PAN": (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",),
    "DRIVING_LICENSE": (r"\b[A-Z]{2}[-\s]?\d{2,3}[-\s]?\d{4}[-\s]?\d{7}\b", r"\b[A-Z]{2}\d{13,14}\b"),
}
ORGANIZATIONS = ("hospital", "health center", "health centre", "medical section", "medical unit", "clinic", "dispensary", "nuclear fuel complex")
LEAVE_PAGE = ("recommended for leave", "communication of leave", "absence from duty", "with effect from", "advised rest")
FITNESS_PAGE = ("fitness to return to duty", "fit to resume duty", "fit to resume duties")
PAGE_WEIGHTS = (
    ("medical certificate", 60), ("medical & fitness certificate", 90), ("medical section", 20),
    *((k, 8) for k in ORGANIZATIONS), *((k, 65) for k in LEAVE_PAGE), ("days with effect from", 35), ("suffering from", 25),
    *((k, -30) for k in FITNESS_PAGE), ("circular", -180), ("recruitment", -180), ("mandatory courses", -180), ("apar", -80),
)
# --- End of fixed values. ---


def kind_scores(text: Column) -> dict[str, Column]:
    """For each kind: 3 for a signal of over ten characters, 1 for a shorter one, 5 for each identifier shape."""
    text = as_text(text)
    out = {}
    for kind, words in SIGNALS.items():
        terms = [F.when(text.contains(w), 3 if len(w) > 10 else 1).otherwise(0) for w in words]
        terms += [F.when(text.rlike(p), 5).otherwise(0) for p in SHAPES[kind]]
        out[kind] = reduce(lambda a, b: a + b, terms)
    return out


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the three scores and document_type: the kind that scores most, the first named of equals; UNKNOWN at 0."""
    scores = kind_scores(F.col(text))
    names = {kind: f"score_{kind.lower()}" for kind in scores}
    df = docs.withColumns({names[k]: c for k, c in scores.items()})
    most = F.greatest(*names.values())
    kind = F.lit(None).cast("string")
    for k in reversed(scores):
        kind = F.when(F.col(names[k]) == most, k).otherwise(kind)
    return df.withColumn("document_type", F.when(most == 0, "UNKNOWN").otherwise(kind))


def route(classified: DataFrame, extractors: dict) -> DataFrame:
    """Each kind's rows through its extractor, a function of DataFrames with one schema; kinds without one as they are given for UNKNOWN."""
    kinds = [k for k in extractors if k != "UNKNOWN"]
    parts = [extractors[k](classified.where(F.col("document_type") == k)) for k in kinds]
    if "UNKNOWN" in extractors:
        parts.append(extractors["UNKNOWN"](classified.where(~F.coalesce(F.col("document_type").isin(*kinds), F.lit(False)))))
    return reduce(DataFrame.unionByName, parts)


def certificate_page_score(text: Column) -> Column:
    """How much a page looks like a leave certificate; null for a blank page."""
    lower = F.lower(as_text(text))
    total = reduce(lambda a, b: a + b, [F.when(lower.contains(k), w).otherwise(0) for k, w in PAGE_WEIGHTS])
    return F.when(F.trim(lower) != "", total)


def select_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, primary_text, header_text, combined_text) of pages (doc_id, page_no, text).

    Primary is the best page, the first of equals; header the first that scores over 0; combined all of those, in
    order. If no page scores over 0 all are empty.
    """
    df = pages.select("doc_id", "page_no", "text", certificate_page_score(F.col("text")).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc_nulls_last(), "page_no")
    df = df.withColumn("_rank", F.row_number().over(w))
    good = F.col("score") > 0
    out = df.groupBy("doc_id").agg(
        F.max(F.when((F.col("_rank") == 1) & good, F.col("text"))).alias("primary_text"),
        F.min(F.when(good, F.struct("page_no", "text")))["text"].alias("header_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("page_no", "text")))), lambda p: p["text"]), "\n").alias("combined_text"),
    )
    return out.na.fill("", ["primary_text", "header_text", "combined_text"])
