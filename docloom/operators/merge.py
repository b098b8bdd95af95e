"""Several recognition passes of a page merged into one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import clean_id_text, comparison_key, line_quality
from docloom.operators.rank import best


def merge_passes(passes: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) of passes (doc_id, page_no, pass_no, text).

    Lines are cleaned; those with one key, their letters and digits, are one line, of which the best reading stays, the
    earliest of equals. Keys under three characters and qualities under -10 are dropped. Lines keep the order in which
    their keys were first seen.
    """
    rows = passes.select("doc_id", "page_no", "pass_no", F.posexplode(F.split(clean_id_text(F.col("text")), "\n")).alias("i", "line"))
    rows = rows.withColumns({"key": comparison_key(F.col("line")), "quality": line_quality(F.col("line"))})
    rows = rows.where((F.length("key") >= 3) & (F.col("quality") >= -10))
    kept = best(rows, ["doc_id", "page_no", "key"], [-F.col("quality"), F.col("pass_no"), F.col("i")], ["line"])
    seen = rows.groupBy("doc_id", "page_no", "key").agg(F.min(F.struct("pass_no", "i")).alias("seen"))
    placed = kept.join(seen, ["doc_id", "page_no", "key"])
    ordered = F.array_sort(F.collect_list(F.struct("seen", "line")))
    return placed.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
