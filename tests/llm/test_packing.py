import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.packing import hilbert, pack


def check(rows, pieces, length=1024):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by_doc.pop(doc), key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids) and 0 < p.length <= length
            assert p.ids == ids[at : at + p.length].tobytes() and p.ids_crc32 == zlib.crc32(p.ids)
            at += p.length
        assert at == len(ids)
    assert not by_doc
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    short = 0
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(s))
        short += sum(n for _, n in s) < length
    return short


def test_table_round_trip(spark, tiny, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 100_000)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = pack(docs).collect()
    assert check(rows, pieces) <= -(-sum(len((t or "").encode()) for _, t in rows) // 100_000)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "<|endoftext|> is text"), (5, "word " * 40_000), (6, "é\U0001f600\x00"), (7, "a" * 30_000)]
    rows += [(10 + i, "same text") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "2 as part")
    assert check(rows, pack(df).collect()) == 1
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert len(pack(twice, with_ids=False).collect()) == 3
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " \t\n\u3000" * 250_000, "a" + " " * 300_000 + "b " * 1000, "x" * 300_000 + "\n\n"])
def test_long_runs_equal_the_whole_tokenizer(text):
    whole = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(whole)
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), whole)(text) == tok.encode(text, add_special_tokens=False).ids


def test_failures_of_the_quick_encoder_are_made_good(monkeypatch):
    class Panic(BaseException):
        pass

    class Broken:
        def __init__(self, *args, **kwargs):
            pass

        def encode_ordinary(self, text):
            raise Panic

    monkeypatch.setattr(packing.tiktoken, "Encoding", Broken)
    whole = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), whole)("two words") == Tokenizer.from_file(whole).encode("two words").ids


def test_long_white_space_in_a_table(spark):
    rows = [(1, "before " + " " * 600_000 + " after"), (2, "plain"), (3, "\n" * 200_000)]
    assert check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 1


def test_cuts_have_equal_weight():
    rng = np.random.default_rng(3)
    cells, weights = rng.permutation(500), rng.integers(1, 100, 500)
    weights[7] = 40_000
    cuts = packing.cuts_of(cells, weights, 20)
    assert (np.diff(cuts) >= 0).all()
    width = 1 << (32 + packing.DIMS * packing.BITS - packing.CELLS)
    places, each = [], []
    for c, w in zip(cells.tolist(), weights.tolist()):
        places += (c * width + (np.arange(w) * width) // w).tolist()
    each = np.bincount(np.searchsorted(cuts, places, side="right"), minlength=20)
    assert each.max() - each.min() < 0.02 * weights.sum()


def test_hilbert_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
