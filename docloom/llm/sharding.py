"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import checkpointed, table

#: Movers are admitted by so many classes of gain, each in so many parts.
GAINS, PARTS = 16, 64


def admitted(flows: list[tuple[int, int, int, int]], sizes: list[int], least: float, most: float) -> list[tuple[int, int, int]]:
    """Which flows (from, to, priority, rows) may move so that every shard keeps `least` to `most` rows.

    Flows are taken by priority; what finds no room is tried again after others have moved.
    """
    out, waiting = [], sorted(flows, key=lambda f: (f[2], f[0], f[1]))
    while waiting:
        later = []
        for flow in waiting:
            a, b, priority, n = flow
            if sizes[b] + n <= most and sizes[a] - n >= least:
                sizes[a] -= n
                sizes[b] += n
                out.append((a, b, priority))
            else:
                later.append(flow)
        if len(later) == len(waiting):
            break
        waiting = later
    return out


def propagate(cells: DataFrame, sizes: list[int], shards: int, rounds: int, slack: int) -> DataFrame:
    """cells (group, home, n) with `label`: where each group's rows that began in shard `home` are to go.

    The rows of a group are linked through the group, so a row's neighbours in a shard are the group's rows there. In
    each round cells want to move to the shard that holds most of their neighbours. Wishes are counted by (from, to,
    priority), at most shards ** 2 * GAINS * PARTS numbers, and admitted by gain as long as sizes stay within `slack`
    rows of even. Every round is a checkpoint.
    """
    total = sum(sizes)
    least, most = total / shards - slack, total / shards + slack
    cells = cells.withColumn("label", F.col("home"))
    for _ in range(rounds):
        held = cells.groupBy("group", "label").agg(F.sum("n").alias("held"))
        best = held.groupBy("group").agg(F.max(F.struct("held", F.xxhash64("group", "label").alias("h"), "label")).alias("best"))
        wish = cells.join(held, ["group", "label"]).join(best, "group")
        gain = F.least(F.floor(F.log2(F.col("best.held") - F.col("held") + 1)), F.lit(GAINS - 1)).cast("int")
        priority = (F.lit(GAINS - 1) - gain) * PARTS + F.pmod(F.xxhash64("group"), F.lit(PARTS)).cast("int")
        wish = wish.select("group", "home", "n", "label", F.col("best.label").alias("target"), priority.alias("priority"))
        wish = checkpointed(wish)
        moving = wish.where("label <> target").groupBy("label", "target", "priority").agg(F.sum("n").alias("n")).collect()
        allowed = admitted([(r["label"], r["target"], r["priority"], r["n"]) for r in moving], sizes, least, most)
        if not allowed:
            return wish.select("group", "home", "n", "label")
        # At most shards ** 2 * GAINS * PARTS rows.
        may = wish.sparkSession.createDataFrame(allowed, "label int, target int, priority int").withColumn("moves", F.lit(True))
        wish = wish.join(F.broadcast(may), ["label", "target", "priority"], "left")
        cells = wish.select("group", "home", "n", F.when(F.col("moves"), F.col("target")).otherwise(F.col("label")).alias("label"))
    return checkpointed(cells)


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, label) for each row of docs: law `rows`.

    Rows with equal texts are linked. They begin in shards by a hash, then labels spread along the links under
    capacity quotas (see propagate), so that few groups are cut. Last, rows are put in order of (label, group) and cut
    into shards whose counts differ by one at most; in each label the rows without links come first and last, so that
    moving the cut seldom divides a group; the quotas leave room for an eighth of those rows. A group larger than a shard is divided. slot is a row's place in its
    shard, from 0; size is the text's UTF-8 bytes plus 1; grown_shard is null under this law.

    Null texts count as empty, and are linked with nothing; nor are empty ones, so that they can fill gaps. Null and
    repeated ids and repeated rows are rows like others; other columns are ignored; an empty table has no rows.

    Groups are first reduced to a row for each (group, shard), a partial aggregate, so a group of a third of all rows
    takes part in the rounds as `shards` rows. The final order is dealt by range, with the row's own number last in
    the key: no group or id is too large to be split.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    linked = F.octet_length(text) > 0
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(linked, F.struct(F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), F.octet_length(text).alias("l"))).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = checkpointed(rows.withColumn("home", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")))
    sizes = [0] * shards
    for r in rows.groupBy("home").count().collect():
        sizes[r["home"]] = r["count"]
    total = sum(sizes)

    cells = rows.where("group is not null").groupBy("group", "home").agg(F.count("*").alias("n"))
    linked_groups = cells.groupBy("group").agg(F.sum("n").alias("all")).where("all > 1").select("group")
    cells = checkpointed(cells.join(linked_groups, "group"))
    alone = total - (cells.agg(F.sum("n")).first()[0] or 0)
    slack = total // (50 * shards) + alone // (8 * shards) + 1
    moved = propagate(cells, list(sizes), shards, rounds, slack).select("group", "home", "label")
    placed = rows.join(moved, ["group", "home"], "left").withColumn("side", F.when(F.col("label").isNotNull(), 1).otherwise(F.pmod(F.xxhash64("row"), F.lit(2)) * 2))
    placed = placed.select("doc_id", "size", "text_crc32", "row", "group", "side", F.coalesce("label", "home").alias("label"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "side", "group", "doc_id", "row"]
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ordered = checkpointed(
        ordered.select("doc_id", "size", "text_crc32", "label", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    )
    upto, before = [], 0
    for r in ordered.groupBy("part").count().orderBy("part").collect():
        upto.append((r["part"], before))
        before += r["count"]
    # A row for each of `parts` partitions.
    starts = docs.sparkSession.createDataFrame(upto, "part long, before long")
    place = F.col("before") + F.col("k")
    shard = F.expr(f"(before + k) * {shards}L div {max(total, 1)}L")
    out = ordered.join(F.broadcast(starts), "part").withColumn("place", place).withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "label",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal counts, equal texts together."""
    return shard_documents(table(spark, sf_dir, "documents"))
