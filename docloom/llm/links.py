"""From band keys to components, without pairing everything that shares a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import connected_components
from docloom.llm.hashing import slices, tidied
from docloom.llm.registers import estimate, least_estimate
from docloom.session import forget, stored

BLOCK = 256
#: Keys whose hubs a task remembers, and ids that it knows to have sent.
SLOTS = 1 << 18
#: Rows of one 64-bit number that are broadcast: two megabytes.
FEW = 250_000
#: Bits of a filter of ids that have one row of it, and the power of two of rows that it has at most: 16 megabytes.
SLICE, MOST_SLICES = 4_096, 15

SIGNED = "key long, id long, hub long"
PACKED = "part int, keys binary, ids binary, hubs binary"
#: A key has 60 bits in rows of PACKED, of which the upper 12 are the part; rows that a task gathers before it packs them.
LOW, PARTS, FLUSH = 48, 1 << 12, 1 << 19
#: Meetings of so few nodes are compared pair by pair, many meetings at a time.
SMALL = 64
MEETING = ("key", "id", "part", "x", "y", "own")
HOPEFUL = "key long, id long, part long, x int, y int, own int, size long, sig binary"


def bounded_broadcast(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, one 64-bit column or a few, as a table; marked for broadcast if it has at most `most` rows."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= most else df


def sifted(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose hashed id is one of ids (id, ...), of which there are n, and few others, without a shuffle of rows.

    What is broadcast has two bits set for each id, in SLICE bits that its lowest bits pick: 16 bits for each id, and
    16 MB at most. Beyond 8 million ids more other rows pass.
    """
    slices_ = 1 << min(max(16 * n // SLICE, 1).bit_length(), MOST_SLICES)
    slot = F.col("id").bitwiseAND(slices_ - 1)
    bits = [F.shiftright("id", k).bitwiseAND(SLICE - 1).cast("int") for k in (32, 44)]
    word, bit = lambda b: F.shiftright(b, 6), lambda b: b.bitwiseAND(63)
    held = ids.coalesce(-(-n // 200_000)).select(slot.alias("slot"), F.explode(F.array(*bits)).alias("b")).groupBy("slot", word(F.col("b")).alias("w"))
    held = held.agg(F.expr("bit_or(shiftleft(1L, b & 63))").alias("word")).groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("w", "word"))).alias("m"))
    held = stored(held.select("slot", F.expr(f"transform(sequence(0, {SLICE // 64 - 1}), w -> coalesce(m[w], 0L))").alias("words")))
    held_too = [F.getbit(F.get("words", word(b)), bit(b)) == 1 for b in bits]
    return rows.join(F.broadcast(held), (slot == F.col("slot")) & held_too[0] & held_too[1], "left_semi")


def bounded_join(rows: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with ids (id, ...) on id: ids are broadcast if they are at most FEW, else rows are sifted first."""
    ids = ids if hasattr(ids, "_docloom_path") else stored(ids)
    n = ids.count()
    return rows.join(F.broadcast(ids), "id", how) if n <= FEW else sifted(rows, ids, n).join(ids, "id", how)


def slots() -> np.ndarray:
    """A memory of ids by their lowest bits; what it holds at first fits no id of its place."""
    return np.arange(SLOTS, dtype=np.int64) ^ 1


def local_hubs(signed: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of SIGNED from (keys, ids): a row of keys for each id.

    The first id that a task sees under a key is the key's hub there. It goes on to where the key's hubs from all tasks
    meet (hub = id); other ids of the key are its spokes already (hub is the other id), and can go anywhere. So a key that a third of all rows share sends little more than one row a task to one place.
    """
    key_at, hub_at, used = np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=bool)
    for keys, ids in signed:
        key, ids = keys.ravel(), np.repeat(ids, keys.shape[1])
        if not len(key):
            continue
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[first], ids[first]
        begins = np.ones(len(key), dtype=bool)
        begins[1:] = key[1:] != key[:-1]
        head, run = np.flatnonzero(begins), np.cumsum(begins) - 1
        slot = (key[head] >> 6) & (SLOTS - 1)
        known = used[slot] & (key_at[slot] == key[head])
        hub = np.where(known, hub_at[slot], ids[head])[run]
        key_at[slot], used[slot] = key[head], True
        hub_at[slot] = hub[head]
        out = (ids != hub) | (begins & ~known[run])
        key, ids, hub = key[out], ids[out], hub[out]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(hub)], names=["key", "id", "hub"])


def _blobs(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row of PACKED for each run of equal parts, from columns of bytes (a row for each number)."""
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    arrays = [pa.array(part[cuts[:-1]].astype(np.int32))]
    for name in ("keys", "ids", "hubs"):
        if name in columns:
            data = np.ascontiguousarray(columns[name])
            ends = (cuts * data.shape[1]).astype(np.int32)
            arrays.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]))
        else:
            arrays.append(pa.nulls(len(cuts) - 1, pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["part", "keys", "ids", "hubs"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from rows of SIGNED: the same numbers, many to a row, so that Spark sorts and deals few rows.

    Hubs (hubs null) are dealt by their key's upper bits, which the row has once; spokes by their id. Two keys of one
    band that agree in 54 bits become one, which costs a comparison and no link.
    """
    raw = lambda c: np.ascontiguousarray(c, dtype="<i8").view(np.uint8).reshape(-1, 8)

    def flushed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, ids, hub = (np.concatenate(c) for c in zip(*held, strict=True))
        key = key & ((PARTS << LOW) - 1)
        head = ids == hub
        for own, part in ((head, key >> LOW), (~head, ids & (PARTS - 1))):
            part = part[own].astype(np.int16)
            order = np.argsort(part, kind="stable")
            if len(order):
                columns = {"keys": raw(key[own][order]), "ids": raw(ids[own][order])}
                if own is head:
                    columns["keys"] = columns["keys"][:, : LOW // 8]
                else:
                    columns["hubs"] = raw(hub[own][order])
                yield _blobs(part[order], columns)

    held, n = [], 0
    for batch in batches:
        held.append(tuple(np.asarray(batch.column(c)) for c in ("key", "id", "hub")))
        n += batch.num_rows
        if n >= FLUSH:
            yield from flushed(held)
            held, n = [], 0
    if n:
        yield from flushed(held)


def _numbers(column: pa.Array, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of `width` bytes in a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]].reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<i8").ravel(), np.diff(at) // width


def unpacked(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows of SIGNED from rows of PACKED in order of part: spokes as they come, hubs in order of (key, id)."""
    names = ["key", "id", "hub"]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def put_in_order(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, key))
        for at in range(0, len(order), rows):
            own = order[at : at + rows]
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(ids[own]), pa.array(ids[own])], names=names)

    for batch in batches:
        head = pc.is_null(batch.column("hubs"))
        spokes, heads = batch.filter(pc.invert(head)), batch.filter(head)
        if spokes.num_rows:
            columns = [pa.array(_numbers(spokes.column(c))[0]) for c in ("keys", "ids", "hubs")]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if heads.num_rows:
            low, n = _numbers(heads.column("keys"), LOW // 8)
            key = low | np.repeat(np.asarray(heads.column("part")).astype(np.int64), n) << LOW
            held.append((key, _numbers(heads.column("ids"))[0]))
            last = key[-1] >> LOW
            if held[0][0][0] >> LOW != last:
                key, ids = (np.concatenate(c) for c in zip(*held, strict=True))
                cut = int(np.searchsorted(key >> LOW, last))
                held = [(key[cut:], ids[cut:])]
                yield from put_in_order(key[:cut], ids[:cut])
    if held:
        yield from put_in_order(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of SIGNED in order of (key, id): spokes (key, hub, id). A key's least hub is the hub of its others."""
    last_key, last_hub, last_id = None, 0, 0
    for batch in tidied(batches):
        key, ids, hub = (np.asarray(batch.column(c)) for c in ("key", "id", "hub"))
        heads = ids == hub
        spokes = [(key[~heads], hub[~heads], ids[~heads])]
        key, ids = key[heads], ids[heads]
        if len(key):
            begins = np.ones(len(key), dtype=bool)
            begins[1:] = key[1:] != key[:-1]
            begins[0] = last_key is None or key[0] != last_key
            again = np.zeros(len(key), dtype=bool)
            again[1:] = (ids[1:] == ids[:-1]) & ~begins[1:]
            again[0] = not begins[0] and ids[0] == last_id
            starts = np.flatnonzero(begins)
            run = np.cumsum(begins) - 1
            hub = np.where(run >= 0, ids[starts][np.maximum(run, 0)] if len(starts) else last_hub, last_hub)
            out = (ids != hub) & ~again
            spokes.append((key[out], hub[out], ids[out]))
            last_key, last_hub, last_id = int(key[-1]), int(hub[-1]), int(ids[-1])
        arrays = [pa.array(np.concatenate(c)) for c in zip(*spokes, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "hub", "id"])


def links(
    signed: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    alike: Callable[[list[str], list[str]], np.ndarray],
    signatures: Callable[[DataFrame, DataFrame], DataFrame] | None,
    threshold: float,
    guess: Callable[[DataFrame], DataFrame] | None = None,
    keys_of: Callable[[np.ndarray], np.ndarray] | None = None,
    matrix: Callable[[list[str], int], np.ndarray] | None = None,
) -> DataFrame:
    """(id, component) of every id that is linked with another; component is the least id that links lead to.

    signed: rows of SIGNED, from local_hubs, or of PACKED. texts: from ids (id) to (id, text). alike: for two lists of texts whether
    each pair is a link. guess: from pairs (a, b, shared) to (a, b, likely), likely saying whether they may be a link;
    without it every pair is compared exactly. signatures: from rows (key, id, ...) and the texts held so far to the rows
    with `size` and `sig` of the id, sig being little-endian 16-bit registers of the sets that the key was made of.
    keys_of: the keys of signatures, if those tell them. matrix: of the texts of one key which are linked with which, all
    at once and exactly; with it, and without guess, signatures are not needed.

    A bucket first gives each of its nodes' pair with a hub: as many pairs as rows, however large it is. Each node is
    compared with the hub that it shares most keys with, then with those that are in other components still. Where a
    bucket of three nodes or more still has nodes of several components, these meet block against block: no task gets
    more than two blocks of some BLOCK nodes at a time. There all pairs of different components that may be alike by
    their signatures are compared exactly, the likeliest first, until they are connected, and a meeting gives links that
    connect what it found connected: fewer than it has nodes. So all nodes that share a band and may be alike are
    compared until they are in one component, whatever their hubs are, and no table has a row for each likely pair.
    """
    spokes = "key long, hub long, id long"
    if "part" in signed.columns:
        met = signed.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: _buckets(unpacked(it)), spokes)
    else:
        deal = F.when(F.col("id") == F.col("hub"), F.col("key")).otherwise(F.xxhash64("key", "id"))
        met = signed.repartition(deal).sortWithinPartitions("key", "id").mapInArrow(_buckets, spokes)
    kept = stored(met)
    low, high = F.least("hub", "id"), F.greatest("hub", "id")
    n = kept.count()
    # Its many small files are read by few tasks, each of which opens a file for every partition of a shuffle.
    met = kept.coalesce(max(1, -(-n // 200_000)))
    pairs = met.groupBy(low.alias("a"), high.alias("b")).agg(F.count("*").alias("shared"))
    told = stored(guess(stored(pairs, rows=n)) if guess else pairs.withColumn("likely", F.lit(True)), rows=n, each=50_000)
    likely = told.where("likely")
    ends = stored(_ends(likely), rows=2 * told.count())
    held = stored(texts(ends), rows=2 * told.count(), each=20_000)

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in tidied(it):
            for at in range(0, len(batch), 1_000):
                p = batch.iloc[at : at + 1_000]
                yield p.loc[alike(p.text_a.tolist(), p.text_b.tolist()), ["a", "b"]]

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b")
        return stored(both.mapInPandas(compare, "a long, b long"), rows=pairs.count(), each=20_000)

    shared = -F.col("shared") if "shared" in told.columns else F.lit(0)
    nearest = likely.groupBy("b").agg(F.min(F.struct(shared.alias("s"), "a"))["a"].alias("a")).select("a", "b")
    nearest = stored(nearest, rows=told.count())
    labels = connected_components(compared(nearest))
    others = stored(_apart(likely.join(nearest, ["a", "b"], "left_anti"), labels), rows=told.count())
    labels = _joined(labels, compared(others))
    mixed = met.withColumns({"a": low, "b": high}).join(_apart(told, labels), ["a", "b"]).select("key").distinct()
    nodes = met.join(stored(mixed, rows=n), "key").select("key", F.explode(F.array("hub", "id")).alias("id")).distinct()
    nodes = stored(nodes, rows=2 * n)
    forget(kept)
    meetings = _meetings_of(nodes.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part")))
    if meetings is None:
        return labels
    edges = "a long, b long"
    if matrix is not None:
        solve = lambda rows, cuts: _matched_all(rows, cuts, matrix, alike)
        found = _dealt(meetings.join(held, "id"), "deal").mapInArrow(lambda it: _by_meeting(it, MEETING + ("text",), None, every=solve), edges)
        return _joined(labels, stored(found, rows=nodes.count(), each=50_000))
    hopeful = _dealt(signatures(meetings, held).select(*MEETING, "size", "sig"))
    hopeful = hopeful.mapInArrow(lambda it: _by_meeting(it, MEETING + ("size", "sig"), lambda rows: _hopeful(rows, threshold, keys_of), HOPEFUL), HOPEFUL)
    hopeful = stored(hopeful, rows=nodes.count(), each=20_000)
    more = hopeful.select("id").distinct().join(held.select("id"), "id", "left_anti")
    if more.limit(1).count():
        held = held.unionByName(stored(texts(stored(more)), rows=nodes.count(), each=20_000))
    found = _dealt(hopeful.join(held, "id"))
    found = found.mapInArrow(lambda it: _by_meeting(it, MEETING + ("size", "sig", "text"), lambda rows: _confirmed(rows, threshold, keys_of, alike)), edges)
    return _joined(labels, stored(found, rows=nodes.count(), each=50_000))


def _ends(pairs: DataFrame) -> DataFrame:
    """(id): what pairs (a, b) are of."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _dealt(rows: DataFrame, by: str = "key") -> DataFrame:
    """Rows of meetings, those of one meeting together in one task and in order."""
    meeting = F.xxhash64(by, "x", "y")
    return rows.repartition(meeting).sortWithinPartitions(*dict.fromkeys((by, "key", "x", "y", "own", "id")))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    of = lambda c: labels.toDF(c, f"l{c}")
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, component) after further edges (a, b)."""
    if not edges.limit(1).count():
        return labels
    of = lambda c: labels.toDF(c, f"l{c}")
    over = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = connected_components(over.where("a <> b"))
    single = top.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    out = labels.unionByName(single).join(top.toDF("component", "top"), "component", "left")
    return stored(out.select("id", F.coalesce("top", "component").alias("component")), rows=labels.count() + 2 * edges.count())


def _meetings_of(tagged: DataFrame) -> DataFrame | None:
    """Of keys with three nodes or more in several parts: rows (key, deal, id, part, own, x, y), one for each meeting of
    blocks x and y that a node, of block own, takes part in; None if there are no such keys.

    tagged: (key, id, part). Every two nodes of different parts of a key meet. Nodes of a key's largest part do not meet
    each other. Small meetings with one least id have one `deal`, as they often have the same nodes; an id has few keys.
    """
    tagged = stored(tagged)
    n = tagged.count()
    several = tagged.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("nodes"))
    several = stored(several.where("lo <> hi and nodes > 2").select("key"), rows=n)
    if not several.limit(1).count():
        return None
    left = stored(tagged.join(several, "key"), rows=n)
    sizes = left.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    major = F.max(F.struct("n", "part"))["part"].alias("major")
    largest = sizes.groupBy("key").agg(major, F.sum("n").alias("nodes"), F.max("n").alias("most"), F.min("least").alias("least"))
    one = F.col("nodes") <= BLOCK
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    largest = largest.select(
        "key", F.when(F.col("nodes") <= SMALL, F.col("least")).otherwise(F.xxhash64("key")).alias("deal"), F.when(~one, F.col("major")).alias("major"), F.when(one, 1).otherwise(blocks(F.col("nodes") - F.col("most"))).alias("minors"),
        F.when(one, 0).otherwise(blocks(F.col("most"))).alias("majors"),
    )
    # Blocks of other nodes are numbered from 0, those of the largest part from -1 downwards. A small group is one block.
    small = F.expr("pmod(xxhash64(id), minors)").cast("int")
    own = F.when(F.col("part") == F.col("major"), -1 - F.expr("pmod(xxhash64(id), majors)").cast("int")).otherwise(small)
    meets = F.when(F.col("own") < 0, F.expr("transform(sequence(0, minors - 1), m -> struct(m as x, own as y))")).otherwise(
        F.concat(
            F.expr("transform(sequence(0, minors - 1), m -> struct(least(m, own) as x, greatest(m, own) as y))"),
            F.expr("if(majors = 0, array(), transform(sequence(1, majors), m -> struct(own as x, -m as y)))"),
        )
    )
    return left.join(stored(largest, rows=n), "key").withColumn("own", own).select("key", "deal", "id", "part", "own", F.inline(meets))


def _by_meeting(
    batches: Iterator[pa.RecordBatch], names: tuple[str, ...], solve: Callable[[list[tuple]], list[tuple]] | None, schema: str = "a long, b long",
    every: Callable[[list[tuple], list[int]], list[tuple]] | None = None,
) -> Iterator[pa.RecordBatch]:
    """The rows that solve gives for each meeting, or `every` for many and where they begin and end. Rows come in order of
    (key, x, y); what a batch ends with waits for the next."""
    held: list[tuple] = []
    place = [names.index(c) for c in ("key", "x", "y")]
    of = lambda r: tuple(r[k] for k in place)
    out_names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t] for t in types]

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        cuts = [0, *(k for k in range(1, len(rows)) if of(rows[k]) != of(rows[k - 1])), len(rows)]
        out = every(rows, cuts) if every else [row for a, b in zip(cuts, cuts[1:]) for row in solve(rows[a:b])]
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(out_names))

    for batch in slices(batches):
        held += zip(*[batch.column(c).to_pylist() for c in names], strict=True)
        cut = len(held)
        while cut and of(held[cut - 1]) == of(held[-1]):
            cut -= 1
        if cut:
            yield solved(held[:cut])
            held = held[cut:]
    if held:
        yield solved(held)


def _pairs(rows: list[tuple], threshold: float, keys_of: Callable[[np.ndarray], np.ndarray] | None, most: int = 1 << 30) -> list[tuple[int, int]]:
    """The pairs (i, j) of rows of one meeting that may be links. With keys_of, those of which this is the first common key."""
    found = _near([r[:8] for r in rows], threshold, most)
    at = {r[1]: k for k, r in enumerate(rows)}
    if keys_of is None or not found:
        return [(at[a], at[b]) for a, b, _ in found]
    i, j = (np.array([at[p[k]] for p in found]) for k in (0, 1))
    keys = keys_of(np.frombuffer(b"".join(r[7] for r in rows), dtype="<u2").reshape(len(rows), -1))
    first = (keys[i] == keys[j]).argmax(axis=1)
    own = keys[i, first] == rows[0][0]
    return list(zip(i[own].tolist(), j[own].tolist(), strict=True))


def _hopeful(rows: list[tuple], threshold: float, keys_of: Callable[[np.ndarray], np.ndarray] | None) -> list[tuple]:
    """The rows of one meeting whose nodes may be linked with another."""
    return [rows[k] for k in sorted({k for pair in _pairs(rows, threshold, keys_of) for k in pair})]


class _Union:
    """Which parts a meeting has found connected, and by which links."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids, self.parts = [r[1] for r in rows], [r[2] for r in rows]
        self.root = {p: p for p in self.parts}
        self.links: list[tuple[int, int]] = []

    def of(self, k: int) -> int:
        p = self.parts[k]
        while self.root[p] != p:
            self.root[p] = self.root[self.root[p]]
            p = self.root[p]
        return p

    def join(self, i: int, j: int) -> None:
        a, b = self.of(i), self.of(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((self.ids[i], self.ids[j]))


def _confirmed(rows: list[tuple], threshold: float, keys_of, alike, step: int = 1 << 15) -> list[tuple[int, int]]:
    """Links (a, b) that connect all of a meeting's nodes that are connected by links: each node's two likeliest partners
    are compared first, then all others that are not connected yet."""
    union = _Union(rows)
    for most in (2, 1 << 30):
        now = [(*r[:2], union.of(k), *r[3:]) for k, r in enumerate(rows)]
        pairs = _pairs(now, threshold, keys_of, most)
        for at in range(0, len(pairs), step):
            left = [(i, j) for i, j in pairs[at : at + step] if union.of(i) != union.of(j)]
            if left:
                good = alike([rows[i][8] for i, _ in left], [rows[j][8] for _, j in left])
                for k in np.flatnonzero(good).tolist():
                    union.join(*left[k])
    return union.links


def _matched(rows: list[tuple], matrix: Callable[[list[str], int], np.ndarray]) -> list[tuple[int, int]]:
    """As _confirmed, from the matrix of a meeting's links."""
    x, y = rows[0][3], rows[0][4]
    own, part = np.array([r[5] for r in rows]), np.array([r[2] for r in rows])
    met = (own == x)[:, None] & (own == y)[None, :] & (part[:, None] != part[None, :])
    i, j = np.nonzero(met & matrix([r[6] for r in rows], rows[0][0]))
    union = _Union(rows)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        union.join(a, b)
    return union.links


def _matched_all(rows: list[tuple], cuts: list[int], matrix, alike) -> list[tuple[int, int]]:
    """The links of many meetings: small ones compare their pairs together, one that several have once; each other one has
    its matrix."""
    out, first, second = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        if b - a > SMALL or rows[a][3] != rows[a][4]:
            out += _matched(rows[a:b], matrix)
            continue
        i, j = np.triu_indices(b - a, 1)
        first.append(i + a)
        second.append(j + a)
    if not first:
        return out
    _, at, node = np.unique(np.array([r[1] for r in rows]), return_index=True, return_inverse=True)
    part = np.array([r[2] for r in rows])[at]
    one, two = node[np.concatenate(first)], node[np.concatenate(second)]
    pairs, seen = np.unique(np.minimum(one, two) * len(at) + np.maximum(one, two), return_index=True)
    pairs = pairs[np.argsort(seen)]
    one, two = pairs // len(at), pairs % len(at)
    apart = part[one] != part[two]
    one, two = one[apart].tolist(), two[apart].tolist()
    nodes = [rows[k] for k in at.tolist()]
    union = _Union(nodes)
    for k in np.flatnonzero(alike([nodes[i][6] for i in one], [nodes[j][6] for j in two])).tolist():
        union.join(one[k], two[k])
    return out + union.links


def _near(rows: list[tuple], threshold: float, most: int) -> list[tuple[int, int, bool]]:
    """(least id, other id, more) of one meeting's two blocks: for each node the `most` likeliest nodes of the other block
    that are of another part and may be links; more says that there are others."""
    _, ids, part, x, y, own, size, sig = (np.array(c) if k < 7 else c for k, c in enumerate(zip(*rows, strict=True)))
    sig = np.frombuffer(b"".join(sig), dtype="<u2").reshape(len(rows), -1)
    first, second = np.flatnonzero(own == x[0]), np.flatnonzero(own == y[0])
    out = {}
    for i in np.union1d(first, second).tolist():
        js = second if own[i] == x[0] else first
        js = js[part[js] != part[i]]
        js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i]) - 1e-9]
        if len(js):
            guess = estimate((sig[js] == sig[i]).mean(axis=1), np.full(len(js), size[i]), size[js], sig.shape[1])
            near = guess >= least_estimate(threshold, np.minimum(size[js], size[i]), sig.shape[1])
            js, guess = js[near], guess[near]
            for j in js[np.lexsort((ids[js], -guess))[:most]].tolist():
                pair = (int(min(ids[i], ids[j])), int(max(ids[i], ids[j])))
                out[pair] = out.get(pair, False) or len(js) > most
    return [(a, b, more) for (a, b), more in out.items()]
