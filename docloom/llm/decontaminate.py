"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.links import bounded_broadcast
from docloom.session import checkpointed, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows that are joined at a time: some 40 MB for broadcast. More windows are taken in further blocks.
BLOCK = 200_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null. Splitting between words is the cheapest way to them."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, BETWEEN), "")


def _token(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(size)])


def item_windows(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(win, len, items): every distinct window, its number of words, and the sorted ids of the items that have it.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window.
    """
    rows = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    rows = rows.where(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    rows = rows.select("item", F.expr(f"slice(w, s + 1, {window})").alias("w"))
    return rows.groupBy(F.array_join("w", " ").alias("win")).agg(F.first(F.size("w")).alias("len"), F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items) for each row of docs.

    hits: the sorted distinct (start, stop) word ranges where a window of an item occurs; n_hit: the words they cover;
    items: the sorted ids, as strings, of items with occurring windows. Null and empty texts have no words and no
    hits; items without words or without an id have no windows or no id to report; repeated rows and ids each give
    their own row; other columns are ignored; an empty items table leaves everything without hits.

    The join is prefix-filtered. A window's tokens are its shingles of `shingle` words (fewer if the shortest window
    has fewer). They are ordered by how often the corpus holds them. An occurrence holds all of a window's tokens, so
    its necessary prefix is one token, the rarest, and only that token is joined. The token's place in the window
    and the lengths then bound where an occurrence would begin and end, and the words there are compared with the
    window itself. Nothing but documents' own rows, with their hits, is shuffled. Windows are broadcast in blocks of
    at most BLOCK rows; a benchmark of more windows takes one further pass over the documents for each block.
    """
    found = checkpointed(item_windows(items, window).withColumn("wid", F.monotonically_increasing_id()))
    shortest, number = found.agg(F.min("len"), F.count("*")).first()
    size = max(1, min(shingle, shortest or 1))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text)).alias("w"))
    source = source.withColumn("n", F.size("w"))

    tokens = found.select("wid", "len", F.split("win", " ").alias("w"))
    tokens = tokens.select("wid", "w", F.explode(F.expr(f"sequence(0, len - {size})")).alias("o"))
    tokens = checkpointed(tokens.select("wid", "o", _token("w", F.col("o"), size).alias("token")))
    placed = source.select("w", F.explode(F.expr(f"if(n >= {size}, sequence(0, n - {size}), array())")).alias("p"))
    placed = placed.select(_token("w", F.col("p"), size).alias("token"))
    wanted = bounded_broadcast(tokens.select("token").distinct())
    counts = placed.join(wanted, "token", "left_semi").groupBy("token").count()
    counted = tokens.join(counts, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # A window with a token that the corpus does not hold cannot occur.
    rarest = counted.groupBy("wid").agg(F.min(F.struct("count", "o", "token")).alias("best")).where("best.count > 0")
    prefix = rarest.join(found, "wid").select(F.col("best.token").alias("token"), F.col("best.o").alias("o"), "win", "len", "items")
    prefix = checkpointed(prefix)

    # Row p = -1 stands for the document itself; it meets the row of token 0 that has no window.
    base = source.select("doc_id", "row", "w", "n", F.explode(F.expr(f"sequence(-1, greatest(-1, n - {size}))")).alias("p"))
    base = base.withColumn("token", F.when(F.col("p") < 0, F.lit(0).cast("long")).otherwise(_token("w", F.col("p"), size)))
    itself = prefix.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("token"), F.lit(0).alias("o"), F.lit(None).cast("string").alias("win"),
        F.lit(0).alias("len"), F.array().cast("array<string>").alias("items"),
    )
    start = F.col("p") - F.col("o")
    same = F.array_join(F.slice("w", start + 1, F.col("len")), " ") == F.col("win")
    fits = ((F.col("p") < 0) & F.col("win").isNull()) | ((F.col("p") >= 0) & (start >= 0) & (start + F.col("len") <= F.col("n")) & same)
    blocks = max(1, -(-number // BLOCK))
    matched = None
    for k in range(blocks):
        part = prefix.where(f"pmod(xxhash64(win), {blocks}) = {k}") if blocks > 1 else prefix
        part = part.unionByName(itself) if k == 0 else part
        some = base.join(F.broadcast(part), "token").where(fits).select("doc_id", "row", "n", start.alias("start"), "len", "items")
        matched = some if matched is None else matched.unionByName(some)
    hit = F.when(F.col("len") > 0, F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("stop")))
    out = matched.groupBy("doc_id", "row").agg(
        F.max("n").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, h: F.struct(
            (a.n + F.greatest(F.lit(0), h.stop - F.greatest(h.start, a.upto))).alias("n"), F.greatest(a.upto, h.stop).alias("upto")
        ),
        lambda a: a.n.cast("long"),
    )
    return out.select("doc_id", "n_words", covered.alias("n_hit"), "hits", "items")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document occurs in the benchmark."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = f"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s
        FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dwin AS (
  SELECT rid, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT rid, s, n, item FROM dwin JOIN iw USING (n, win)),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
