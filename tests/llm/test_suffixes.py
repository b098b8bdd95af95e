import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import suffixes
from docloom.llm.suffixes import blind_trie, deep_shallow_sort, op10_suffix_dedup, remove_repeats


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], flags.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~flags])
        out.append((d, len(t), int(flags.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    want = brute(rows, 400)
    assert sum(r[2] for r in want) > 0
    assert got(op10_suffix_dedup(spark, tiny)) == want


def passages(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(3, 30)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(0, 20)) for _ in range(rng.randrange(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, rows[i % n][1]) for i in range(n // 4)]
    rows += [(2000, "a" * 300), (2001, "ab" * 200), (2002, None), (2003, ""), (2004, "x"), (None, rows[0][1]), (None, None), (3, rows[1][1]), (2005, "y" * 40), (2006, "y" * 39)]
    return rows


@pytest.mark.parametrize("group", [512, 3])
@pytest.mark.parametrize("length,gram", [(40, 10), (24, 8)])
def test_planted_passages(spark, group, length, gram, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = passages(length, 24)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as place")
    assert got(remove_repeats(df, length, gram)) == brute(rows, length)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("shallow", [8, 64])
def test_deep_shallow_sort(seed, shallow):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(0, 12))) * rng.randrange(1, 9) for _ in range(80)]
    strings += [b"q" * 90 + bytes([rng.randrange(3)]) * rng.randrange(4) for _ in range(30)] + [b"", b"", b"\0", b"\0\0"]
    groups = np.array([rng.randrange(4) for _ in strings])
    order, shared = deep_shallow_sort(strings, groups, shallow)
    want = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    assert [(groups[i], strings[i]) for i in order] == [(groups[i], strings[i]) for i in want]
    for k in range(len(order)):
        same = k > 0 and groups[order[k]] == groups[order[k - 1]]
        assert shared[k] == (prefix(strings[order[k - 1]], strings[order[k]]) if same else -1)


def test_blind_trie_keeps_equal_strings():
    order, shared = blind_trie([b"ab", b"a", b"ab", b"b", b""], [0, 1, 2, 3, 4], 0)
    assert [x for x in order if x not in (0, 2)] == [4, 1, 3] and shared[order.index(2)] in (1, 2)
