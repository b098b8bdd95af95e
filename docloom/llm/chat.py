"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import stored, table

#: A row of the result holds so many turns at most; longer renderings go on in the next row.
PART = 512


def numbered_turns(conversations: DataFrame, part: int) -> DataFrame:
    """(conv_id, place, part, role, text): turns in order of (turn, role, MD5 of the text), nulls first, and their places.

    All turns are put in order by ranges, with the row's own number last in the key, so a conversation that holds a
    third of all rows is spread over many ranges. Only the first conversation of a range can have begun in an earlier
    one: what came before is a row for each range at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select("conv_id", "turn", "role", text.alias("text"), F.md5(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    keys, at = ["conv_id", "turn", "role", "tie", "row"], F.monotonically_increasing_id()
    ranges = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    ordered = stored(ordered.select("conv_id", "role", "text", F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    counts = ordered.groupBy("range", "conv_id").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select(F.col("range").alias("_range"), F.col("conv_id").alias("_conv"), "before")
    own = F.row_number().over(Window.partitionBy("range", "conv_id").orderBy("k")) - 1
    same = (F.col("range") == F.col("_range")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    # A row for each range at most.
    out = ordered.withColumn("own", own).join(F.broadcast(before), same, "left")
    place = F.coalesce("before", F.lit(0)) + F.col("own")
    return out.select("conv_id", place.alias("place"), F.floor(place / part).cast("long").alias("part"), "role", "text")


def rotate_perspectives(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, participant, n_turns, text, masks, n_target_chars): each dialogue once for every participant.

    A participant is a distinct non-null role, other than `system`, of the whole conversation. In a participant's
    rendering that speaker's turns are the assistant's and only they are trained on: masks holds the (start, stop)
    character ranges of their texts, end mark included. Other speakers are users named by their role; system turns, and
    turns of no role, are context.

    Every participant gets the whole dialogue, all turns in order (see numbered_turns). A rendering is one text; so
    that no row grows without bound it is given in rows of at most `part` turns each, numbered from 0, whose texts
    follow each other without a gap; masks are places in the row's own text. Repeated turns are turns like others; a
    null text is empty; null turns and roles come first. Null conv_ids form one conversation. A conversation without
    participants gives no row, and so does an empty table. Texts may be of any length. Other columns are ignored.
    """
    turns = numbered_turns(conversations.select("conv_id", "turn", "role", "text"), part)
    dialogues = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    roles = conversations.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("participant")).distinct()
    each = dialogues.join(roles, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = lambda x: F.coalesce(x["role"] == F.col("participant"), F.lit(False))
    system = lambda x: F.coalesce(x["role"] == "system", F.lit(True))
    head = lambda x: (
        F.when(own(x), F.lit("<|assistant|>\n")).when(system(x), F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), x["role"], F.lit("|>\n")))
    )
    pieces = F.transform("t", lambda x: F.struct(own(x).alias("own"), head(x).alias("head"), F.concat(x["text"], F.lit("<|end|>\n")).alias("body")))
    each = each.withColumn("p", pieces)
    masks = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("m")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    a["m"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(x["head"])).alias("start"),
                            (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("stop"),
                        )
                    ),
                ),
            )
            .otherwise(a["m"])
            .alias("m"),
        ),
        lambda a: a["m"],
    )
    each = each.withColumn("masks", masks)
    return each.select(
        "conv_id",
        "part",
        "participant",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        "masks",
        F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + m["stop"] - m["start"]).alias("n_target_chars"),
    )


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    marks = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["stop"].cast("string"))), ",")
    return out.select("conv_id", "part", "participant", "n_turns", "n_target_chars", F.sha2("text", 256).alias("text_sha256"), marks.alias("masks"))


OP4_SQL = f"""
WITH o AS (
  SELECT conv_id, role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) - 1 AS place
  FROM conversations),
t AS (SELECT *, place // {PART} AS part FROM o),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
x AS (
  SELECT t.conv_id, t.part, participant, place, coalesce(role = participant, false) AS own,
         CASE WHEN coalesce(role = participant, false) THEN '<|assistant|>' || chr(10)
              WHEN coalesce(role = 'system', true) THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
         text || '<|end|>' || chr(10) AS body
  FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
y AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, participant ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM x)
SELECT conv_id, part, participant, count(*) AS n_turns,
       CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_target_chars,
       sha256(string_agg(head || body, '' ORDER BY place)) AS text_sha256,
       coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY place) FILTER (own), '') AS masks
FROM y GROUP BY conv_id, part, participant
"""
