"""MinHash near-dedup with HyperMinHash sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.hashing import overlap, set_key, shingle_sets, slices, tidied
from docloom.llm.links import SIGNED, bounded_broadcast, links, local_hubs
from docloom.llm.registers import bands, estimate, least_estimate, sketches
from docloom.session import release, stored, table

REGISTERS, BANDS, WIDTH = 256, 42, 6


def _encoded(texts: pa.Array | pd.Series) -> list[bytes]:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return [t.encode("utf-8", "surrogatepass").lower() if t is not None else b"" for t in texts]


def _sketched(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(_encoded(batch.column("text").to_pylist()), words)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([r.astype("<u2").tobytes() for r in sketches(sets, REGISTERS)], pa.binary()),
            ],
            names=["doc_id", "set_key", "n_shingles", "sig"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The band keys of sketches (id, sig), and their ids."""
    for batch in slices(batches):
        regs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u2").reshape(batch.num_rows, REGISTERS)
        yield bands(regs, BANDS, WIDTH), np.asarray(batch.column("id"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    A text's set holds its distinct shingles of `words` words (runs of other than ASCII white space, A-Z
    lower-cased); fewer words make one shingle; no words, or a null text, make an empty set, linked with nothing.
    Texts are linked if the Jaccard similarity of their sets reaches the threshold; component_id is the least doc_id
    reachable over links (null ids are passed over; a component of null ids only has null), and kept says whether it
    is the row's own. Rows with equal sets are one node, so groups of copies of any size cost one row each after a
    partial aggregate; repeated rows, ties and repeated ids therefore share one fate. Other columns are ignored.

    Sketches have 256 HyperMinHash registers (leading zeros and mantissa bits in two bytes), compared in 42 bands of 6:
    of pairs at similarity 0.8 three in a million share no band. Pairs whose collision-corrected estimate
    falls 4.5 standard errors short of the threshold are dropped; all others are confirmed on their full sets.
    """
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = stored(whole.mapInArrow(lambda it: _sketched(it, words), "doc_id long, set_key binary, n_shingles long, sig binary"))
    rows = sketch.select("doc_id", "set_key", "n_shingles")
    nodes = (
        sketch.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    nodes = stored(nodes)
    sized = nodes.select("id", "size", "sig")
    sets = lambda ts: shingle_sets(_encoded(ts), words)

    def guessed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in tidied(it):
            for at in range(0, len(batch), 4_000):
                p = batch.iloc[at : at + 4_000]
                x = np.frombuffer(b"".join(p.sig_a), dtype="<u2").reshape(len(p), -1)
                y = np.frombuffer(b"".join(p.sig_b), dtype="<u2").reshape(len(p), -1)
                a, b = p.size_a.to_numpy(), p.size_b.to_numpy()
                guess = estimate((x == y).mean(axis=1), a, b, REGISTERS)
                likely = guess >= least_estimate(threshold, np.minimum(a, b), REGISTERS)
                likely &= np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
                yield p[["a", "b", "shared"]].assign(likely=likely)

    def own_set(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in tidied(it):
            for at in range(0, len(batch), 1_000):
                p = batch.iloc[at : at + 1_000]
                keys = [set_key(s) for s in sets(p.text.tolist())]
                yield p.loc[[bytes(k) == own for k, own in zip(p.set_key, keys, strict=True)], ["id", "text"]]

    def texts(ids: DataFrame) -> DataFrame:
        wanted = stored(ids.join(nodes.select("id", "least_id", "set_key"), "id"))
        some = bounded_broadcast(wanted.select(F.col("least_id").alias("doc_id")).distinct())
        # A null id can be the least only where all of a set's ids are null.
        found = whole.join(some, "doc_id", "left_semi").unionByName(whole.where("doc_id is null"))
        found = found.join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id"))).select("id", "set_key", "text")
        return found.mapInPandas(own_set, "id long, text string").groupBy("id").agg(F.first("text").alias("text"))

    def guess(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sized.toDF("a", "size_a", "sig_a"), "a").join(sized.toDF("b", "size_b", "sig_b"), "b")
        return both.mapInPandas(guessed, "a long, b long, shared long, likely boolean")

    def alike(left: list[str], right: list[str]) -> np.ndarray:
        own = list(dict.fromkeys([*left, *right]))
        of = dict(zip(own, sets(own), strict=True))
        out = np.zeros(len(left), dtype=bool)
        for i, (s, t) in enumerate(zip(left, right, strict=True)):
            common = overlap(of[s], of[t])
            out[i] = common >= threshold * (len(of[s]) + len(of[t]) - common) - 1e-9
        return out

    signed = nodes.select("id", "sig").mapInArrow(lambda it: local_hubs(_keys(it)), SIGNED)
    found = links(signed, texts, alike, lambda some, _: some.join(sized, "id"), threshold, guess, lambda regs: bands(regs, BANDS, WIDTH))
    named = found.join(nodes.select("id", "least_id"), "id")
    least = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = named.join(least, "component").select("id", "component_id")
    classes = nodes.join(named, "id", "left").select("set_key", F.coalesce("component_id", "least_id").alias("component_id"))
    classes = stored(classes)
    release(docs.sparkSession)
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    linked = rows.where("n_shingles > 0").join(classes, "set_key")
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, on shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
