"""Removal of repeated byte strings by deep-shallow suffix sorting.

Sorting every suffix of the corpus would move hundreds of bytes for each byte. Only sampled suffixes are sorted: of the
GRAM-byte grams in a string of LENGTH bytes the one with the least hash is its anchor, so equal strings have their
anchors at the same offset, and only strings whose anchors agree can be equal. The suffixes that begin at anchors with
the same gram, and the reversed texts before them, are put in order by deep-shallow sorting: a multikey quicksort over
words of eight bytes to a shallow depth, then a blind trie for each group that is still equal. The common prefixes of
neighbours in the two orders give, for any two anchors, which strings around them are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.hashing import BYTE, chunks, mix, prefix_sums, range_hashes, slices, tidied
from docloom.llm.links import bounded_broadcast
from docloom.session import forget, release, stored, table

LENGTH, GRAM = 400, 100
SHALLOW = 64
#: Anchors of one gram that are compared in one task; larger groups are first split by longer strings.
GROUP = 512


# --- anchors -----------------------------------------------------------------------------------------------------------


def anchors(text_lengths: np.ndarray, buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, gram hash, least offset, greatest offset) of the anchors of texts that lie end to end in buf.

    The strings of an anchor at position a are those that begin at a - o for o from the least to the greatest offset.
    """
    width = length - gram + 1
    begins = np.cumsum(text_lengths) - text_lengths
    strings = np.maximum(text_lengths - length + 1, 0)
    if not strings.sum():
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none, none
    sums, inverse = prefix_sums(BYTE[buf])
    at = np.arange(len(buf) - gram + 1)
    h = range_hashes(sums, inverse, at, at + gram)
    order = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    padded = np.full(-(-(len(order) + width) // width) * width, 2**64 - 1, dtype=np.uint64)
    padded[: len(order)] = order
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = np.repeat(np.arange(len(strings)), strings)
    p = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    anchor = (np.minimum(behind[p], ahead[p + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(p)) - 1
    a = anchor[first]
    return owner[first], a - begins[owner[first]], h[a], a - p[last], a - p[first]


def _raw(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in column.to_pylist()]


def _digests(buf: bytes, starts: np.ndarray, stops: np.ndarray, seeds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """128 bits of each range's bytes, in two columns."""
    raw = b"".join(xxhash.xxh3_128_digest(buf[s:e], k) for s, e, k in zip(starts.tolist(), stops.tolist(), seeds.tolist(), strict=True))
    both = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, i1, i2, place, c1, c2) for each anchor of texts (i1, i2, text).

    place packs position, least and greatest offset; c1 and c2 name the anchor's context, all bytes of its strings.
    """
    for batch in slices(batches):
        texts = _raw(batch.column("text"))
        for a, b in chunks(texts):
            sizes, raw = np.array([len(t) for t in texts[a:b]], dtype=np.int64), b"".join(texts[a:b])
            text, position, h, lo, hi = anchors(sizes, np.frombuffer(raw, dtype=np.uint8), length, gram)
            at = (np.cumsum(sizes) - sizes)[text] + position
            context = _digests(raw, at - hi, at - lo + length, hi)
            own = [batch.column(c).slice(a, b - a).take(pa.array(text)) for c in ("i1", "i2")]
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), *own, pa.array(position << 20 | lo << 10 | hi), *context], names=["gram", "i1", "i2", "place", "c1", "c2"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts: rows (key, c1, c2, lo, hi, anchor, bytes) from texts with their `wanted` anchors."""
    for batch in slices(batches, 200):
        out: list[list] = [[] for _ in range(7)]
        for raw, wanted in zip(_raw(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                at, lo, hi = w["place"] >> 20, w["place"] >> 10 & 1023, w["place"] & 1023
                for column, value in zip(out, (w["gram"], w["c1"], w["c2"], lo, hi, hi, raw[at - hi : at - lo + length]), strict=True):
                    column.append(value)
        arrays = [*[pa.array(c, pa.int64()) for c in out[:6]], pa.array(out[6], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "c1", "c2", "lo", "hi", "anchor", "bytes"])


# --- deep-shallow sorting ----------------------------------------------------------------------------------------------


def common_prefix(s: bytes, t: bytes, known: int = 0) -> int:
    """How many leading bytes two strings share; the first `known` are known to be equal."""
    n = min(len(s), len(t))
    if s[known:n] == t[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if s[lo:mid] == t[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], members: list[int], known: int) -> tuple[list[int], list[int]]:
    """members in the order of their strings, and each one's common prefix with the one before it.

    A node keeps its depth and a child for each byte found there; the bytes between are not looked at on the way
    down but compared once, with a leaf below. -1 stands for the end of a string; equal strings share a leaf.
    """
    root: list = [known, {}]
    for i in members:
        s = strings[i]
        node = root
        while isinstance(node, list):
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte) or (next(iter(children.values())) if children else None)
            if node is None:
                break
        if node is None:
            root[1][s[known] if known < len(s) else -1] = (i,)
            continue
        leaf = strings[node[0]]
        same = common_prefix(s, leaf, known)
        parent, node = None, root
        while isinstance(node, list) and node[0] < same:
            byte = s[node[0]] if node[0] < len(s) else -1
            parent, at = node, byte
            node = node[1][byte]
        byte = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and same == len(s) == len(leaf):
            parent[1][at] = (*node, i)
        elif isinstance(node, list) and node[0] == same:
            node[1][byte] = (*node[1].get(byte, ()), i)
        else:
            other = leaf[same] if same < len(leaf) else -1
            parent[1][at] = [same, {other: node, byte: (i,)}]
    order: list[int] = []
    shared: list[int] = []
    stack: list = [(root, known)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, tuple):
            order += node
            shared += [depth] + [len(strings[node[0]])] * (len(node) - 1)
        else:
            keys = sorted(node[1], reverse=True)
            stack += [(node[1][k], node[0] if k != keys[-1] else depth) for k in keys]
    return order, shared


def deep_shallow_sort(strings: list[bytes], groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Indices by (group, string), and for each place the common prefix with the place before in the same group, else -1."""
    n = len(strings)
    width = -(-shallow // 8) * 8
    matrix = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), dtype=">u8").reshape(n, -1)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    order = np.argsort(groups, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = groups[order][1:] != groups[order][:-1]
    shared = np.where(new, -1, 0)
    for w in range(width // 8):
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        block = np.cumsum(new)[open_]
        rows = order[open_]
        word = matrix[rows, w].astype(np.uint64)
        # A string that ends inside this word comes before one that goes on with zeros.
        cut = np.minimum(lengths[rows], 8 * (w + 1))
        by = np.lexsort((cut, word, block))
        order[open_] = rows[by]
        word, cut = word[by], cut[by]
        inside = np.zeros(len(open_), dtype=bool)
        inside[1:] = block[1:] == block[:-1]
        differ = np.zeros(len(open_), dtype=bool)
        differ[1:] = inside[1:] & ((word[1:] != word[:-1]) | (cut[1:] != cut[:-1]))
        at = np.flatnonzero(differ)
        x = word[at] ^ word[at - 1]
        equal = np.full(len(at), 8, dtype=np.int64)
        some = x != 0
        equal[some] = (64 - np.frexp(np.maximum(x[some], 1).astype(np.float64))[1]) // 8
        # The float may round up to the next power of two; the highest byte itself decides.
        for k in np.flatnonzero(some):
            equal[k] = 8 - (int(x[k]).bit_length() + 7) // 8
        shared[open_[at]] = np.minimum(8 * w + equal, np.minimum(cut[at], cut[at - 1]))
        new[open_[at]] = True
    starts = np.flatnonzero(new)
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
        if b - a > 1:
            members = order[a:b].tolist()
            known = min(width, min(len(strings[i]) for i in members))
            placed, common = blind_trie(strings, members, known)
            order[a:b] = placed
            shared[a + 1 : b] = common[1:]
    return order, shared


def _prefix_table(order: np.ndarray, shared: np.ndarray, size: int) -> np.ndarray:
    """Common prefixes of all of one group's strings; order holds 0 to size - 1."""
    out = np.zeros((size, size), dtype=np.int64)
    for i in range(size - 1):
        run = np.minimum.accumulate(shared[i + 1 :])
        out[order[i], order[i + 1 :]] = run
        out[order[i + 1 :], order[i]] = run
    return out


def repeated_offsets(
    groups: np.ndarray, lows: np.ndarray, highs: np.ndarray, places: np.ndarray, contexts: list[bytes], length: int, gram: int
) -> list[tuple[int, int, int]]:
    """(row, lo, hi): the strings that begin lo to hi bytes before the row's anchor also stand in another row of its group.

    Rows are different contexts of anchors; those of one group have the same gram, at `places` in the contexts.
    """
    after = [c[p + gram :] for c, p in zip(contexts, places.tolist(), strict=True)]
    before = [c[:p][::-1] for c, p in zip(contexts, places.tolist(), strict=True)]
    order_a, shared_a = deep_shallow_sort(after, groups)
    order_b, shared_b = deep_shallow_sort(before, groups)
    edges = np.flatnonzero(shared_a < 0)
    rank = np.empty(len(groups), dtype=np.int64)
    out: list[tuple[int, int, int]] = []
    for s, e in zip(edges.tolist(), np.append(edges[1:], len(groups)).tolist(), strict=True):
        m = e - s
        if m < 2:
            continue
        if m == 2:
            x, y = order_a[s], order_a[s + 1]
            lo, hi = length - gram - int(shared_a[s + 1]), int(shared_b[s + 1])
            out += [(int(r), max(lo, int(lows[r])), min(hi, int(highs[r]))) for r in (x, y) if max(lo, int(lows[r])) <= min(hi, int(highs[r]))]
            continue
        rows = np.sort(order_a[s:e])
        rank[rows] = np.arange(m)
        right = _prefix_table(rank[order_a[s:e]], shared_a[s:e], m) + gram
        left = _prefix_table(rank[order_b[s:e]], shared_b[s:e], m)
        lo = np.maximum(length - right, lows[rows][:, None])
        hi = np.minimum(left, highs[rows][:, None])
        np.fill_diagonal(hi, -1)
        for k, j in zip(*np.nonzero((lo <= hi) & (hi >= 0)), strict=True):
            out.append((int(rows[k]), int(lo[k, j]), int(hi[k, j])))
    return merged(out)


def merged(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Inclusive ranges of each row, without overlaps."""
    out: list[tuple[int, int, int]] = []
    for row, lo, hi in sorted(set(ranges)):
        if out and out[-1][0] == row and lo <= out[-1][2] + 1:
            out[-1] = (row, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((row, lo, hi))
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of key; groups that go on in the next batch wait for it. Rows (c1, c2, lo, hi).

    Keys are hashes, so the grams themselves are compared: rows of one key with different grams are different groups.
    """
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        keys, c1, c2, low, high, anchor, raw = zip(*rows, strict=True)
        names: dict[tuple[int, bytes], int] = {}
        groups = [names.setdefault((k, r[p : p + gram]), len(names)) for k, r, p in zip(keys, raw, anchor, strict=True)]
        found = repeated_offsets(*(np.array(x, dtype=np.int64) for x in (groups, low, high, anchor)), list(raw), length, gram)
        columns = ([c1[r] for r, _, _ in found], [c2[r] for r, _, _ in found], [x for _, x, _ in found], [x for _, _, x in found])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["c1", "c2", "lo", "hi"])

    for batch in tidied(batches):
        for at in range(0, batch.num_rows, 4 * GROUP):
            part = batch.slice(at, 4 * GROUP)
            held += zip(*[part.column(c).to_pylist() for c in ("key", "c1", "c2", "lo", "hi", "anchor", "bytes")], strict=True)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield solve(held[:cut])
                held = held[cut:]
    if held:
        yield solve(held)


# --- groups too large for one task -------------------------------------------------------------------------------------

ROW = "key long, c1 long, c2 long, lo long, hi long, anchor long, bytes binary"


def _halves(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each context's strings in two halves of its key's offsets, from_ to to.

    A half's new key is a hash of the bytes that all its strings share, so only rows with equal ones stay together;
    w1 and w2 name all its strings' bytes, with the offsets they stand for.
    """
    for batch in slices(batches):
        key, c1, c2, low, high, anchor, from_, to = (np.asarray(batch.column(c)) for c in ("key", "c1", "c2", "lo", "hi", "anchor", "from_", "to"))
        raw = batch.column("bytes").to_pylist()
        buf, begins = b"".join(raw), np.cumsum([0] + [len(r) for r in raw])[:-1]
        sums = prefix_sums(BYTE[np.frombuffer(buf, dtype=np.uint8)])
        middle = (from_ + to) // 2
        for a, b in ((from_, middle), (middle + 1, to)):
            lo, hi = np.maximum(low, a), np.minimum(high, b)
            own = np.flatnonzero(lo <= hi)
            at, lo, hi, a, b = (begins + anchor)[own], lo[own], hi[own], a[own], b[own]
            shared = range_hashes(*sums, at - a, at - b + length)
            whole = _digests(buf, at - hi, at - lo + length, lo << 10 | hi)
            new = mix(mix(key[own].astype(np.uint64)) + shared + a.astype(np.uint64))
            columns = (new.astype(np.int64), c1[own], c2[own], lo, hi, anchor[own])
            arrays = [*[pa.array(c) for c in columns], pa.array([raw[i] for i in own], pa.binary()), *whole, pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "c1", "c2", "lo", "hi", "anchor", "bytes", "w1", "w2", "from_", "to"])


def _bounded_groups(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (ROW) with no key of more than GROUP rows, and the answers (c1, c2, lo, hi) found meanwhile.

    All keys that are too large are split at once: each key's strings in two halves of its offsets, at most nine times.
    Of rows whose strings of a half are all equal one goes on, and all of them are answered.
    """
    waiting = rows.withColumns({"from_": F.lit(0).cast("long"), "to": F.lit(length - gram).cast("long")})
    groups, answers = None, None
    while True:
        large = waiting.groupBy("key").agg(F.count("*").alias("n"), F.first("from_").alias("from_"), F.first("to").alias("to"))
        large = stored(large.where((F.col("n") > GROUP) & (F.col("from_") < F.col("to"))).select("key"))
        none = not large.limit(1).count()
        done = (waiting if none else waiting.join(large, "key", "left_anti")).select("key", "c1", "c2", "lo", "hi", "anchor", "bytes")
        groups = done if groups is None else groups.unionByName(done)
        if none:
            return groups, answers
        both = waiting.join(large, "key", "left_semi").mapInArrow(lambda it: _halves(it, length), ROW + ", w1 long, w2 long, from_ long, to long")
        both = stored(both)
        count = stored(both.groupBy("key", "w1", "w2").agg(F.count("*").alias("n"), F.first("c1").alias("one1"), F.first("c2").alias("one2")))
        told = both.select("key", "w1", "w2", "c1", "c2", "lo", "hi").join(count.where("n > 1"), ["key", "w1", "w2"]).select("c1", "c2", "lo", "hi")
        answers = told if answers is None else answers.unionByName(told)
        on = (both.key == count.key) & (both.w1 == count.w1) & (both.w2 == count.w2) & (both.c1 == count.one1) & (both.c2 == count.one2)
        waiting = both.join(count, on, "left_semi").drop("w1", "w2")


# --- the operator ------------------------------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Take the spans out of each text."""
    for batch in slices(batches):
        out: list[list] = [[], [], [], [], []]
        for doc, raw, spans in zip(batch.column("doc_id").to_pylist(), _raw(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            joined: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans):
                if joined and s[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], s[1])
                else:
                    joined.append(list(s))
            at, kept = 0, []
            for start, stop in joined:
                kept.append(raw[at:start])
                at = stop
            left = b"".join([*kept, raw[at:]])
            for column, value in zip(out, (doc, len(raw), len(raw) - len(left), len(joined), hashlib.sha256(left).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def text_ids(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text."""
    return F.xxhash64(text).alias("i1"), F.xxhash64(F.lit(1), text).alias("i2")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(i1, i2, spans) of every text with a string of `length` bytes that also starts anywhere else.

    texts: (i1, i2, text), ids for each different text; a text given twice repeats itself. spans: an array of
    (start, stop) byte ranges, in no order and overlapping, that cover all such strings.

    Anchors and their contexts' names are found in one pass. A context that occurs twice answers for all its
    strings. Of anchors with one gram but different contexts the bytes of each context are fetched once, and sorted.
    """
    some = texts.where(F.octet_length("text") >= length)
    found = stored(some.mapInArrow(lambda it: _anchored(it, length, gram), "gram long, i1 long, i2 long, place long, c1 long, c2 long"))
    context = ["gram", "c1", "c2"]
    # With one place of each context, taken before anything is joined: a context that a third of all rows hold is one row
    # for each task here.
    counts = stored(found.groupBy(*context).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("i1", "i2", "place")]))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]
    mixed = stored(counts.groupBy("gram").agg(*ends).where("min_c1 <> max_c1 or min_c2 <> max_c2").select("gram"))
    ones = stored(counts.join(mixed, "gram").groupBy("i1", "i2").agg(F.collect_list(F.struct("place", *context)).alias("wanted")))
    few = some.join(bounded_broadcast(ones.select("i1", "i2")), ["i1", "i2"], "left_semi").dropDuplicates(["i1", "i2"])
    heavy = stored(few.join(ones, ["i1", "i2"]).select("text", "wanted").mapInArrow(lambda it: _contexts(it, length), ROW), codec="zstd")
    groups, answers = _bounded_groups(heavy, length, gram)
    ranges = groups.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _sorted_groups(it, length, gram), "c1 long, c2 long, lo long, hi long")
    if answers is not None:
        ranges = ranges.unionByName(answers)
    ranges = stored(ranges)
    forget(heavy, ones)

    begin, low, high = F.expr("shiftright(place, 20)"), F.expr("shiftright(place, 10) & 1023"), F.expr("place & 1023")
    copied = found.join(counts.where("n > 1").select(*context), context).select("i1", "i2", begin.alias("at"), low.alias("lo"), high.alias("hi"))
    partly = found.join(ranges, ["c1", "c2"]).select("i1", "i2", begin.alias("at"), "lo", "hi")
    span = F.struct((F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("stop"))
    return copied.unionByName(partly).select("i1", "i2", span.alias("span")).groupBy("i1", "i2").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    Texts are UTF-8 bytes, null is empty. Every byte that lies in a string of `length` bytes which also starts at any
    other place of any text, its own included, is removed, in all places; n_spans counts the maximal removed runs.
    Texts that occur twice or more are removed whole if they have `length` bytes; only one of them is searched.
    Repeated rows are copies like others. Null ids are carried along. Other columns are ignored. An empty table gives
    no rows.

    Different texts, and different contexts of anchors, are told apart by 128 bits; all else by their bytes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    rows = stored(base.select("doc_id", F.sha2("text", 256).alias("sha"), size.alias("n_bytes"), *text_ids(F.col("text"))))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("i1", "i2").agg(F.count("*").alias("n"), F.min("doc_id").alias("one")).where("n > 1")
    copies = stored(copies)
    own = base.select("doc_id", *text_ids(F.col("text")), "text")
    extra = bounded_broadcast(copies.where("one is not null").select("i1", "i2", "one"))
    texts = own.join(extra, ["i1", "i2"], "left").where("one is null or doc_id is null or doc_id = one").select("i1", "i2", "text")
    spans = repeated_spans(texts, length, gram)
    spans = stored(spans.join(copies.select("i1", "i2"), ["i1", "i2"], "left_anti"))
    release(docs.sparkSession)
    changed = bounded_broadcast(spans.select("i1", "i2"))
    cut = own.join(changed, ["i1", "i2"], "left_semi").join(spans, ["i1", "i2"]).select("doc_id", "text", "spans")
    cut = cut.mapInArrow(lambda it: _cut(it, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rest = rows.join(changed, ["i1", "i2"], "left_anti").join(copies.select("i1", "i2", "n"), ["i1", "i2"], "left")
    gone = F.col("n").isNotNull()
    rest = rest.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return rest.unionByName(cut)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that repeat."""
    return remove_repeats(table(spark, sf_dir, "documents"))
