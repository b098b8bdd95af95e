import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import links
from docloom.llm.hashing import mix
from docloom.llm.registers import sketches


def tree(rows):
    """The components of spokes (hub, id)."""
    root = {}

    def find(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    for a, b in rows:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for row in rows for v in row}


@pytest.mark.parametrize("size, batch", [(1, 1), (7, 3), (100, 50), (2000, 10_000)])
def test_buckets_join_all_ids_of_a_key(size, batch, monkeypatch):
    monkeypatch.setattr(links, "SLOTS", 64)
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 400, (2000, 3)) << 6 | np.arange(3)
    keys[::3, 0] = 999 << 6
    ids = rng.integers(0, 900, 2000)
    met = [tuple(r.values()) for k in range(2) for b in links.local_hubs(iter([(keys[a : a + size], ids[a : a + size]) for a in range(k * 1000, k * 1000 + 1000, size)])) for r in b.to_pylist()]
    met.sort()
    table = np.array(met)
    batches = [pa.RecordBatch.from_arrays([pa.array(table[a : a + batch, c]) for c in range(3)], names=["key", "id", "hub"]) for a in range(0, len(table), batch)]
    got = {}
    for b in links._buckets(iter(batches)):
        for r in b.to_pylist():
            got.setdefault(r["key"], []).append((r["hub"], r["id"]))
    want = {}
    for row, i in zip(keys.tolist(), ids.tolist(), strict=True):
        for k in row:
            want.setdefault(k, set()).add(i)
    assert set(got) == {k for k, own in want.items() if len(own) > 1}
    for k, rows in got.items():
        assert tree(rows) == dict.fromkeys(want[k], min(want[k]))


def test_hot_key_goes_on_once_a_task():
    signed = [(np.full((1000, 1), 64), np.arange(1000) + 1000 * k) for k in range(30)]
    rows = [r for b in links.local_hubs(iter(signed)) for r in b.to_pylist()]
    assert sum(r["id"] == r["hub"] for r in rows) == 1 and len(rows) == 30_000


def family(others):
    """Sets of 100 by id: a hub (id 0) unlike all, `others` nodes unlike all, and two that are alike at 0.9."""
    out = {i: np.arange(100) + 1000 * i for i in range(others + 1)}
    for i in (1, 2):
        out[others + i] = np.append(np.arange(100) + 500_000_000, 600_000_000 + i)
    return {i: np.sort(s).astype(np.uint64) for i, s in out.items()}


@pytest.mark.parametrize("others, guessed", [(0, False), (5, False), (600, False), (5, True), (600, True)])
def test_pair_whose_hub_is_unlike_both(spark, others, guessed):
    members = family(others)
    planted = [others + 1, others + 2]
    rows = [(64, i) for i in members] + [(129, i) for i in (0, *planted)]
    keyed = spark.createDataFrame(rows, "key long, id long").selectExpr("key", "id", "0L hub")

    def alike(left, right):
        out = []
        for a, b in zip(left, right, strict=True):
            s, t = set(members[int(a)].tolist()), set(members[int(b)].tolist())
            out.append(len(s & t) >= 0.8 * len(s | t))
        return np.array(out, dtype=bool)

    def texts(ids):
        return ids.selectExpr("id", "cast(id as string) text")

    sig = sketches(list(members.values()), 256)
    sized = spark.createDataFrame([(i, 100, r.astype("<u2").tobytes()) for i, r in zip(members, sig, strict=True)], "id long, size long, sig binary")
    guess = (lambda pairs: pairs.selectExpr("a", "b", "false likely")) if guessed else None
    out = links.links(keyed, texts, alike, lambda some, held: some.join(sized, "id"), 0.8, guess)
    assert {(r.id, r.component) for r in out.collect()} == {(i, planted[0]) for i in planted}


def test_many_alike_nodes_name_few_partners_at_first():
    members = [mix(np.random.default_rng(i).permutation(1000)[:930].astype(np.uint64)) for i in range(60)]
    sig = [r.astype("<u2").tobytes() for r in sketches(members, 256)]
    rows = [(1, i, i, 0, 0, 0, 930, s) for i, s in enumerate(sig)]
    few, all_ = links._near(rows, 0.8, 2), links._near(rows, 0.8, 256)
    assert len(few) <= 120 and all(more for _, _, more in few) and len(all_) > 1700 and not any(more for _, _, more in all_)


def group(n):
    """Rows of a meeting of n sets of 930 of the same 1000 members, each a part of its own."""
    members = [mix(np.random.default_rng(i).permutation(1000)[:930].astype(np.uint64)) for i in range(n)]
    sig = [r.astype("<u2").tobytes() for r in sketches(members, 256)]
    return [(1, i, i, 0, 0, 0, 930, s, str(i)) for i, s in enumerate(sig)]


def test_a_meeting_gives_fewer_links_than_nodes():
    rows, asked = group(60), []

    def alike(left, right):
        asked.extend(zip(left, right, strict=True))
        return np.ones(len(left), dtype=bool)

    assert len(links._hopeful([r[:8] for r in rows], 0.8, None)) == 60
    found = links._confirmed(rows, 0.8, None, alike)
    assert len(found) == 59 and set(tree(found).values()) == {0} and len(asked) <= 120
    assert len(links._matched([(*r[:6], r[8]) for r in rows], lambda texts, key: np.ones((60, 60), dtype=bool))) == 59


def test_a_meeting_compares_all_pairs_that_are_not_connected():
    asked = []

    def alike(left, right):
        asked.extend(zip(left, right, strict=True))
        return np.array([{a, b} == {"3", "17"} for a, b in zip(left, right, strict=True)])

    assert [set(p) for p in links._confirmed(group(20), 0.8, None, alike)] == [{3, 17}]
    assert {frozenset(p) for p in asked} >= {frozenset((str(i), str(j))) for i in range(20) for j in range(i) if {i, j} != {3, 17}}


def test_packed_rows_are_few_and_give_the_same_buckets(monkeypatch):
    monkeypatch.setattr(links, "FLUSH", 20_000)
    rng = np.random.default_rng(1)
    keys = (rng.integers(-(2**40), 2**40, (9_000, 3)) << 20) // 64 * 64 | np.arange(3)
    keys[::3] = keys[1::3]
    keys[::5, 0] = 64
    ids = rng.integers(-(2**63), 2**63 - 1, len(keys))
    rows = [b for k in range(3) for b in links.packed(links.local_hubs((keys[a : a + 500], ids[a : a + 500]) for a in range(k * 3000, k * 3000 + 3000, 500)))]
    table = pa.Table.from_batches(rows).sort_by("part")
    assert all(len(r["keys"]) == len(r["ids"]) // 8 * (8 if r["hubs"] else 6) for r in table.to_pylist())
    assert table.num_rows < 0.8 * keys.size
    whole = {}
    for b in links._buckets(links.unpacked(iter(table.to_batches(max_chunksize=700)), 900)):
        for r in b.to_pylist():
            whole.setdefault(r["key"], []).append((r["hub"], r["id"]))
    want = {}
    for row, i in zip((keys & (2**60 - 1)).tolist(), ids.tolist(), strict=True):
        for k in row:
            want.setdefault(k, set()).add(i)
    assert set(whole) == {k for k, own in want.items() if len(own) > 1}
    for k, found in whole.items():
        assert tree(found) == dict.fromkeys(want[k], min(want[k]))


def test_a_pair_that_many_meetings_have_is_compared_once():
    rows = [(key, i, i, 0, 0, 0, str(i)) for key in range(5) for i in (3, 5, 8)]
    cuts, asked = [0, 3, 6, 9, 12, 15], []

    def alike(left, right):
        asked.extend(zip(left, right, strict=True))
        return np.array([{a, b} == {"3", "8"} for a, b in zip(left, right, strict=True)], dtype=bool)

    assert links._matched_all(rows, cuts, None, alike) == [(3, 8)]
    assert sorted(map(sorted, asked)) == [["3", "5"], ["3", "8"], ["5", "8"]]


def test_small_meetings_of_one_least_id_are_dealt_together(spark):
    rows = [(key, i, i) for key in (1, 2, 3) for i in (7, 9, 11)] + [(4, i, i) for i in range(links.SMALL + 1)] + [(5, i, i) for i in range(links.SMALL + 1)]
    deals = {}
    for r in links._meetings_of(spark.createDataFrame(rows, "key long, id long, part long")).collect():
        deals.setdefault(r.key, set()).add(r.deal)
    assert deals[1] == deals[2] == deals[3] == {7} and len(deals[4] | deals[5]) == 2


@pytest.mark.parametrize("most_slices", [15, 0])
def test_rows_are_sifted_before_a_join_with_many_ids(spark, monkeypatch, most_slices):
    monkeypatch.setattr(links, "FEW", 100)
    monkeypatch.setattr(links, "MOST_SLICES", most_slices)
    rows = spark.range(50_000).selectExpr("xxhash64(id) id", "id n")
    ids = spark.range(0, 50_000, 25).selectExpr("xxhash64(id) id", "id m")
    sifted = links.sifted(rows, ids, 2_000)
    assert {r.n for r in sifted.collect()} >= set(range(0, 50_000, 25))
    assert sifted.count() < (3_000 if most_slices else 30_000)
    assert sorted((r.n, r.m) for r in links.bounded_join(rows, ids).collect()) == [(k, k) for k in range(0, 50_000, 25)]
    assert links.bounded_join(rows, ids.select("id"), "left_semi").count() == 2_000
