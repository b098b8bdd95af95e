import random
import re

import pytest

from docloom.llm import decontaminate as module
from docloom.llm.decontaminate import decontaminate


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + window]), set()).update({str(i)} if i is not None else set())
    out = []
    for d, t in rows:
        w, hit, own = words(t), set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    own |= ids
        out.append((d, len(w), len(hit), sorted(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 3])
@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, block, short, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(short)
    vocabulary = ["the", "of", "Éa", "x1"] + [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(10, 25))) for i in range(12)] + [(None, text(11)), (50, None), (51, " ., "), (52, "The of " * 6), (52, text(12)), (3, text(12))]
    if short:
        items += [(60, "w1 w2 w3"), (61, "w5"), (61, "w5")]
    rows = []
    for i in range(30):
        inner = rng.choice(items[:12])[1]
        rows.append((i, f"{text(rng.randrange(0, 30))}, {inner.upper() if i % 2 else inner}! {text(5)}"))
    rows += [(100, None), (101, ""), (102, "the of " * 4000), (None, items[0][1]), (1, rows[0][1]), (1, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as token", "2 as len", "3 as w")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as win")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(docs, bench).collect()), key=str)
    assert got == brute(rows, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate(docs, none).collect()] == [(2, 0)]
    assert decontaminate(docs.where("false"), none).collect() == []
