import zlib
from collections import Counter, defaultdict

from docloom.llm.sharding import admitted, op5_sharding, shard_documents


def check(rows, out, shards=8):
    assert len(out) == len(rows)
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    counts = [len(by_shard.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    raw = [((t or "").encode(), d) for d, t in rows]
    assert Counter((d, len(t) + 1, zlib.crc32(t)) for t, d in raw) == Counter((r.doc_id, r.size, r.text_crc32) for r in out)


def test_table(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check(rows, op5_sharding(spark, tiny).collect())


def test_groups_stay_together(spark):
    rows = [(i, f"text {i % 400}") for i in range(1200)] + [(5000 + i, f"alone {i}") for i in range(3000)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, out)
    where = defaultdict(set)
    for r in out:
        if r.doc_id < 5000:
            where[r.doc_id % 400].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 12


def test_hot_group_and_edge_cases(spark):
    rows = [(i, "hot") for i in range(700)] + [(1000 + i, None if i % 2 else "") for i in range(300)] + [(None, "n"), (1, "hot"), (1, "hot"), (2, "x" * 100_000)]
    rows += [(7, "same id and text")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as home", "2 as label", "3 as part")
    check(rows, shard_documents(df).collect())
    for few in ([], [(1, "a")], [(1, "a"), (2, "a"), (3, None)]):
        check(few, shard_documents(spark.createDataFrame(few, "doc_id long, text string")).collect())


def test_quotas_are_kept():
    sizes = [100, 100]
    out = admitted([(0, 1, 0, 8), (1, 0, 1, 8), (0, 1, 2, 50), (0, 1, 3, 3)], sizes, 95, 105)
    assert (0, 1, 2) not in out and (0, 1, 3) in out and 95 <= min(sizes) and sum(sizes) == 200
