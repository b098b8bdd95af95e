"""Packing along a space-filling curve: neighbours by content share training sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm.hashing import NOT_SPACE, chunks, slices, words
from docloom.session import table

DIMS, BITS, HASHED = 3, 10, 256
#: Text of a range, unless there would be more than PARTS ranges; then they are larger.
PART_BYTES, PARTS = 24 << 20, 50_000
#: Bytes are counted in 2 ** CELLS cells of the curve.
CELLS = 16
#: White space of so many characters exceeds the stack of the quick encoder's pattern.
BLANKS = re.compile(r"\s{100000}")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of coordinates, each in range(2 ** bits).

    Coordinates are turned into the transposed Hilbert index (Skilling 2004), whose bits are then interleaved.
    """
    x = points.T.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = (out << 1) | ((row >> b) & 1)
    return out


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """The Hilbert key of each text: its words are hashed to a vector of log counts, projected to DIMS dimensions."""
    out = np.zeros(len(texts), dtype=np.int64)
    project = np.random.default_rng(8).normal(size=(HASHED, DIMS))
    for a, b in chunks(texts):
        h, counts = words(texts[a:b], NOT_SPACE)
        owner = np.repeat(np.arange(b - a), counts)
        vec = np.log1p(np.bincount(owner * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=(b - a) * HASHED).reshape(b - a, HASHED))
        vec /= np.maximum(np.sqrt((vec**2).sum(axis=1)), 1e-12)[:, None]
        place = 1 / (1 + np.exp(-1.702 * (vec @ project)))
        out[a:b] = hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
    return out


def encoder(ranks: str, whole: str) -> Callable[[str], list[int]]:
    """Text to ids of the byte-level BPE of two files, ranks for `tiktoken` and JSON for `tokenizers`.

    Names of special tokens are ordinary text. Both give the same ids; the first needs a quarter of the time, but its
    pattern has a bounded stack. Texts with very long white space, and any at which it fails, go to the second.
    """
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) < 100_000 or not BLANKS.search(text):
            try:
                return quick.encode_ordinary(text)
            except BaseException as e:
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if not slow:
            slow.append(Tokenizer.from_file(whole))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int]]:
    """Each text's place, the Hilbert key above 32 bits of `tie`, and its bytes."""
    texts = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in batch.column("text").to_pylist()]
    return curve_keys(texts) << 32 | (np.asarray(batch.column("tie")) & 0xFFFFFFFF), [len(t) for t in texts]


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, weight): a text's bytes, and one more, in its cell of the curve."""
    for batch in slices(batches):
        places, sizes = _places(batch)
        yield pa.RecordBatch.from_arrays([pa.array(places >> (32 + DIMS * BITS - CELLS)), pa.array(np.array(sizes, dtype=np.int64) + 1)], names=["cell", "weight"])


def cuts_of(cells: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Places that cut the curve into `parts` ranges of equal weight; a cell's weight is taken as even over its places.

    Equal texts are spread evenly over the places of their cell by their ties, so a group that is heavier than a range
    is cut too.
    """
    order = np.argsort(cells)
    upto = np.cumsum(weights[order], dtype=np.float64)
    wanted = upto[-1] * np.arange(1, parts) / parts
    k = np.searchsorted(upto, wanted)
    share = 1 - (upto[k] - wanted) / weights[order][k]
    width = 1 << (32 + DIMS * BITS - CELLS)
    return cells[order][k] * width + (share * width).astype(np.int64)


def _placed(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        places, _ = _places(batch)
        part = np.searchsorted(cuts, places, side="right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(places), pa.array(part)], names=["doc_id", "text", "place", "part"])


def _packed(batches: Iterator[pa.RecordBatch], files: tuple[str, str], length: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Fill one sequence after another; a document that does not fit goes on in the next."""
    encode = encoder(*files)
    sequence, at = TaskContext.get().partitionId() << 33, 0
    for batch in slices(batches):
        out: list[list] = [[] for _ in range(8)]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = np.array([*encode(text or ""), end], dtype="<u4").tobytes()
            start, total = 0, len(raw) // 4
            while start < total:
                n = min(total - start, length - at)
                piece = raw[4 * start : 4 * (start + n)]
                for column, value in zip(out, (doc, start, n, zlib.crc32(piece), total, sequence, at, piece if with_ids else None), strict=True):
                    column.append(value)
                start, at = start + n, at + n
                if at == length:
                    sequence, at = sequence + 1, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in out[:7]]
        if with_ids:
            arrays.append(pa.array(out[7], pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def pack(docs: DataFrame, tokenizer: tuple[str, str] | None = None, length: int = 1024, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens, in the order of the Hilbert curve.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): a row for each piece; ids are
    little-endian unsigned 32-bit. A document is its token ids followed by the id `end`; a null or empty text is that
    id alone. Every id lies in exactly one piece; the pieces of a sequence follow each other from offset 0. All
    sequences are full but the last of each range. Repeated rows are packed each for itself; ties on the
    curve are in order of a hash of doc_id and row; an empty table gives no rows; other columns are ignored. Texts of
    any length and contents are encoded, see encoder.

    A first pass hashes words to a vector, projects it to three dimensions and adds up bytes by cell of the Hilbert
    curve: at most 2 ** CELLS numbers, from which the cuts between ranges of equal bytes are taken, PARTS at most. The
    second deals the texts to those ranges, sorts each by its key, and encodes and packs in one go. The hash below the
    key splits a group of equal texts of any size. `tokenizer`: the paths of a .tiktoken file and of a `tokenizers`
    file of one vocabulary, which executors can read.
    """
    files = tokenizer or (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("tie", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    found = source.select("tie", "text").mapInArrow(_weighed, "cell long, weight long").groupBy("cell").agg(F.sum("weight").alias("weight")).toPandas()
    parts = max(1, min(-(-int(found.weight.sum()) // PART_BYTES), PARTS))
    cuts = cuts_of(found.cell.to_numpy(), found.weight.to_numpy(), parts) if parts > 1 else np.empty(0, dtype=np.int64)
    placed = source.mapInArrow(lambda it: _placed(it, cuts), "doc_id long, text string, place long, part int")
    dealt = placed.repartitionById(parts, "part").sortWithinPartitions("place", "doc_id").select("doc_id", "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.mapInArrow(lambda it: _packed(it, files, length, end, with_ids), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
