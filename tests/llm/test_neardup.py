import itertools
import random
import re

import numpy as np
import pytest

from docloom.llm.hashing import mix, shingle_sets
from docloom.llm import links as module
from docloom.llm import neardup
from docloom.llm.neardup import near_duplicates, op7_near_dedup
from docloom.llm.registers import collision_rate, estimate, sketches


def brute(rows, k, threshold=80):
    sets = []
    for _, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= threshold * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert got(op7_near_dedup(spark, tiny)) == brute(rows, 2)


def test_chains_groups_and_edge_cases(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(60):  # one large group whose ends are not alike, so that components need their inner links
        base = list(base)
        base[rng.randrange(120)] = f"x{i}"
        rows.append((1000 + i, " ".join(base)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(200 + i, "Same  text\nhere") for i in range(40)] + [(300, "same TEXT here"), (301, None), (302, ""), (303, " \n"), (304, "one"), (305, "ONE")]
    rows += [(None, "null id row"), (None, "null id row"), (7, rows[3][1]), (1005, "clash of ids"), (1005, "clash of ids")]
    rows += [(400, "long " * 50_000), (401, "long " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as sig", "3 as id")
    out = near_duplicates(df, words=2)
    expected = brute(rows, 2)
    assert sorted(((r[0], r[1], r[2]) for r in got(out)), key=str) == sorted(((r[0], r[1], r[2]) for r in expected), key=str)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


def test_components_that_the_hub_misses(spark, monkeypatch):
    """One bucket, whose hub is like all others but linked with none: the blocks have to find the others' links."""
    monkeypatch.setattr(module, "BLOCK", 7)
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[100 * (i % 4) : 100 * (i % 4) + 300] + [f"x{i}"])) for i in range(60)]
    one = lambda regs, number, width: np.zeros((len(regs), 1), dtype=np.int64)
    monkeypatch.setattr(neardup, "bands", one)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1)
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i % 4 for i in range(60)}


@pytest.mark.parametrize("n", [30, 300, 3000])
def test_estimate_is_close(n):
    a = np.arange(n, dtype=np.uint64)
    b = a + np.uint64(n // 9)
    regs = sketches([mix(a), mix(b)], 256)
    true = (n - n // 9) / (n + n // 9)
    assert abs(estimate(np.array([(regs[0] == regs[1]).mean()]), np.array([n]), np.array([n]), 256)[0] - true) < 0.25
    assert 0 < collision_rate(n, n, 256) < 0.01


def test_shingles_do_not_depend_on_neighbours():
    alone = shingle_sets([b"a b c d"], 2)[0]
    assert (shingle_sets([b"z", b"a b c d", b""], 2)[1] == alone).all()
    assert len(alone) == 3 and len(shingle_sets([b"a"], 2)[0]) == 1 and len(shingle_sets([b" "], 2)[0]) == 0
