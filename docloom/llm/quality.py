"""Quality rules as a bitmask ledger, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import table

BETWEEN = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"
SYMBOL = "[^#*$%&|<>]"

#: Each rule's bit is its place here; a rule holds if its SQL condition, over the measurements, is true.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")

#: Versions of what a document is dropped for.
POLICIES: dict[str, tuple[str, ...]] = {
    "2025-base": BASE,
    "2025-full": tuple(RULES),
}


def mask_of(rules: tuple[str, ...]) -> int:
    """The bits of some rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of whole texts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of other than ASCII white space; a null text has none. n_lines counts \\n-separated lines that
    hold a word; n_dup_lines those equal to an earlier one. n_repeat_words counts the words that lie in a window of
    three words which the text holds twice or more. Windows are told apart by 64-bit hashes, sorted with their places;
    equal neighbours are repeats, so a text of n words costs n log n, whatever it repeats.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    given = [c for c in docs.columns if c not in {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failures"}]
    df = docs.select(
        *given,
        F.array_remove(F.split(whole, BETWEEN), "").alias("_w"),
        F.length(F.translate(whole, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, SYMBOL, "")).cast("long").alias("n_symbols"),
        F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("_lines"),
    )
    df = df.select(
        *given,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") >= 4,
            F.slice(
                F.transform("_w", lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p"))),
                F.lit(1),
                F.size("_w") - 2,
            ),
        ).alias("_windows"),
    )
    df = df.withColumn("_windows", F.sort_array("_windows"))

    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get("_windows", i - 1)["h"], F.get("_windows", i + 1)["h"]
        return before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"])

    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_windows", repeated), lambda x: x["p"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["upto"])).alias("n"), (p + 3).alias("upto")),
        lambda a: a["n"].cast("long"),
    )
    return df.select(*given, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failures`, a bit for each rule of RULES that the text breaks.

    Every rule is evaluated once; policies and ablations only read the bits. Null and empty texts break few_words.
    """
    df = measured(docs, text)
    bits = [F.when(F.expr(rule), 1 << k).otherwise(0) for k, rule in enumerate(RULES.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return df.withColumn("failures", mask)


def apply_policy(led: DataFrame, version: str = "2025-full") -> DataFrame:
    """The ledger with `kept`: whether a row breaks none of the rules of that version."""
    return led.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablations(led: DataFrame, version: str = "2025-full") -> DataFrame:
    """(rule, n_failed, n_alone, n_kept_without): for each rule of a version how many rows break it, how many break no
    other of the version's, and how many would be kept without it.

    The ledger is first reduced to counts of its distinct masks, at most 2 ** len(RULES) rows.
    """
    policy = mask_of(POLICIES[version])
    masks = led.groupBy(F.col("failures").bitwiseAND(F.lit(policy)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of((r,))).alias("bit")) for r in POLICIES[version]])
    both = masks.select("m", "n", F.inline(rules))
    broken = F.col("m").bitwiseAND(F.col("bit")) != 0
    others = F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return both.groupBy("rule").agg(count(broken).alias("n_failed"), count(broken & others).alias("n_alone"), count(others).alias("n_kept_without"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    led = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(mask_of(BASE))) != 0).alias("base_failed"), "kept", "n_lines", "failures",
    )


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT rid, s, w[s + 1] || ' ' || w[s + 2] || ' ' || w[s + 3] AS g
  FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS s FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 3)) AS p FROM rep) GROUP BY rid),
l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM w LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (100 * n_symbols > 10 * word_chars)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS INTEGER) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
       failures = 0 AS kept, n_lines, failures
FROM f
"""
