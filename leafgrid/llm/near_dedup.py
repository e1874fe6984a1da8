"""MinHash near-duplicate removal by a multi-index Hamming join.

Each text becomes the set of its distinct runs of ``width`` words, each set a
signature of ``SLOTS`` b-bit minima.  Two sets of similarity s differ in a slot
with probability 1 - s, so of pairs at a similarity of 0.8 all but about one in
10^5 differ in at most ``ERRORS`` = 35 of 90 slots.  The join finds *every* pair
within that distance: the signature is split into 18 chunks of 5 slots; by the
pigeonhole principle some chunk of such a pair has at most one differing slot,
and each chunk is indexed once for every slot that may differ (5 keys of 4
slots).

Sets within the distance make families, whose complete sets are then compared:
each set travels once, with its family, not once for each pair.

No bucket of the index is expanded into all its pairs.  Of a bucket with more
than ``cap`` members neighbours are compared, a chain; a task sends on the
first of many members only.  Where the chain leaves members of a bucket in
different families, all members outside the bucket's commonest family are
compared with all of the bucket, in groups of bounded size.  A family too large
for one task is treated likewise: it is dealt into blocks, each compared in
itself and with a few representatives; what that leaves outside the commonest
component meets every block.  So a family of n sets of which u stay apart costs
about n + n * u / block, not n * n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import Tables, matching, only

CHUNKS, CHUNK = 18, 5
SLOTS = CHUNKS * CHUNK
#: The largest distance at which some chunk must have at most one error.
ERRORS = 2 * CHUNKS - 1
#: Members of a bucket that are compared pair by pair, rows and bytes of sets
#: that one task compares at once, representatives of a large family, members
#: outside a bucket's commonest family, in groups, from which a second chunk
#: splits it, and edges up to which tables of nodes are broadcast.
CAP, GROUP, ROOM, FACES, AGAIN, EDGES = 16, 2048, 16 << 20, 64, 170, 250_000
#: Members of a bucket that a task sends on, and neighbours in a chain.
LOCAL, LINKS = 4, 2

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1))[:, None]
_LEFT_OUT = np.array([[j for j in range(CHUNK) if j != d] for d in range(CHUNK)])
_LEFT_TWO = np.array([[j for j in range(CHUNK) if j not in d] for d in combinations(range(CHUNK), 2)])


# ---------------------------------------------------------------- signatures


def shingles(block: ts.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word runs, and bounds.  A
    text with fewer words gives one hash of all its words, one without words
    none.  A-Z count as a-z."""
    block = block.lowered()
    start, end, at = ts.words(block)
    h = ts.span_hash(block, start, end)
    runs = ts.window_hash(h, width)
    found = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= width:
            own = runs[a : z - width + 1]
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            found.append(own)
        else:
            found.append(ts.window_hash(h[a:z], z - a) if z > a else h[:0])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
    return (np.concatenate(found) if found else h[:0]), bounds


def minima(x: np.ndarray, bounds: np.ndarray, room: int = 1 << 14) -> np.ndarray:
    """Signatures (uint16, one row for each text, which must not be empty)."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    low = np.full((SLOTS, len(bounds) - 1), 0xFFFFFFFF, np.uint32)
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + room, side="right")) - 1)
        for lo in range(bounds[first], bounds[last], room * 4):  # one text may be longer than the room
            y = (x[lo : min(lo + room * 4, bounds[last])] ^ _XOR) * _MUL
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(12)
            cuts = bounds[first:last] - lo if last > first + 1 else np.zeros(1, np.int64)
            np.minimum(low[:, first:last], np.minimum.reduceat(y, cuts, axis=1), out=low[:, first:last])
        first = last
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).T.copy()


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    """One byte of every slot, a row for each signature."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8, offset=int(at[0]), count=at[-1] - at[0]).reshape(len(column), SLOTS)


def _set_ids(own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identities of whole sets, in two parts."""
    out = []
    for k in (0, 1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ts.mix(own + np.uint64(k)), dtype=np.uint64)])
        out.append(ts.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ ts.mix(np.diff(bounds).astype(np.uint64))).view(np.int64))
    return out[0], out[1]


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in ts.blocks(batch.column(1)):
                own, bounds = shingles(block, width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sig = np.zeros((hi - lo, SLOTS), np.uint16)
                if len(full):
                    sig[full] = minima(own, np.concatenate([bounds[full], bounds[-1:]]))
                ids = [pa.array(x, mask=n == 0) for x in _set_ids(own, bounds)]
                halves = [_binary((sig >> np.uint16(8)).astype(np.uint8)), _binary(sig.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *ids, *halves], ["id", "n", "h1", "h2", "hi", "lo"])

    return run


# ------------------------------------------------------- multi-index join


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The index keys of each signature, CHUNKS x CHUNK of them: every chunk
    with one slot left out."""
    four = sig.reshape(-1, CHUNKS, CHUNK)[:, :, _LEFT_OUT].astype(np.uint64)
    key = four[..., 0] | four[..., 1] << np.uint64(16) | four[..., 2] << np.uint64(32) | four[..., 3] << np.uint64(48)
    number = np.arange(CHUNKS * CHUNK, dtype=np.uint64).reshape(CHUNKS, CHUNK)
    return ts.mix(key ^ ts.mix(number + np.uint64(0x51ED27))).reshape(len(sig), -1)


#: Kinds of rows around the index: a pair (a, b) to compare; a member b of the
#: crowded bucket a; an entry b of the bucket a, which has more; any entry.
PAIR, MEMBER, CROWDED, ENTRY = range(4)


def _rows(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kinds = np.concatenate([np.full(len(a), kind, np.int8) for kind, a, _ in parts])
    a, b = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the index.  Of a bucket with over LOCAL members in the batch
    only the first goes on, the others are chained to it here."""
    for batch in batches:
        if not len(batch):
            continue
        sid = batch.column(0).to_numpy()
        keys = chunk_keys(_matrix(batch.column(1)).astype(np.uint16) << np.uint16(8) | _matrix(batch.column(2)))
        key, own = keys.reshape(-1).view(np.int64), np.repeat(sid, keys.shape[1])
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(key)))
        many = np.repeat(size > LOCAL, size)
        later = np.flatnonzero(many & ~fresh)
        head = first[size > LOCAL]
        rest = np.flatnonzero(~many)
        yield _rows([(PAIR, *_distinct(own[later - 1], own[later])), (MEMBER, key[later], own[later]), (CROWDED, key[head], own[head]), (ENTRY, key[rest], own[rest])])


def _scan(cap: int):
    """Walks over rows sorted by (a, kind, b), entries of one bucket together:
    all pairs among its first ``cap`` members, later ones with LINKS members
    before them; members of crowded buckets are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, met, hot = None, np.empty(0, np.int64), 0, False
        for batch in batches:
            kind, key, sid = (batch.column(k).to_numpy() for k in range(3))
            done = kind < CROWDED
            out = [(k, key[kind == k], sid[kind == k]) for k in (PAIR, MEMBER)]
            kind, key, sid = kind[~done], key[~done], sid[~done]
            if len(key):
                if key[0] != held_key:
                    held, met, hot = held[:0], 0, False
                old = len(held)
                key, sid = np.concatenate([np.full(old, key[0]), key]), np.concatenate([held, sid])
                kind = np.concatenate([np.full(old, ENTRY, np.int8), kind])
                fresh = np.concatenate([[True], key[1:] != key[:-1]])
                first = np.flatnonzero(fresh)
                group = np.cumsum(fresh) - 1
                crowded = kind[first] == CROWDED
                crowded[0] |= hot
                place = np.arange(len(key)) - first[group]
                place[group == 0] += met - old
                crowd, new = crowded[group], np.arange(len(key)) >= old
                reach = np.where(crowd | (place >= cap), LINKS, cap)
                live = np.flatnonzero(new & (place > 0))
                pairs = []
                for back in range(1, cap):
                    live = live[(place[live] >= back) & (reach[live] >= back)]
                    if not len(live):
                        break
                    pairs.append((sid[live - back], sid[live]))
                if pairs:
                    out.append((PAIR, *_distinct(*(np.concatenate(x) for x in zip(*pairs, strict=True)))))
                crossed = np.flatnonzero(new & ~crowd & (place == cap))
                listed = np.concatenate([np.flatnonzero(new & (crowd | (place >= cap))), (crossed[:, None] - np.arange(1, cap + 1)).reshape(-1)])
                out.append((MEMBER, key[listed], sid[listed]))
                held_key, met, hot = key[-1], int(place[-1]) + 1, bool(crowded[-1])
                held = sid[max(first[-1], len(sid) - cap) :].copy()
            if any(len(a) for _, a, _ in out):
                yield _rows(out)

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, lo of a, lo of b) those within ERRORS."""
    for batch in batches:
        near = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1) <= ERRORS if len(batch) else np.empty(0, bool)
        yield batch.select([0, 1]).filter(pa.array(near))


def _split_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (key, sid, label, n, lo, hi) of a large bucket, under the keys of
    every other chunk: those have at most ERRORS errors together, so one of the
    17 has at most two, and keys of 3 of 5 slots find it."""
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            key = part.column(0).to_numpy().view(np.uint64)
            sig = _matrix(part.column(5)).astype(np.uint16) << np.uint16(8) | _matrix(part.column(4))
            own = (chunk_keys(sig) == key[:, None]).argmax(1) // CHUNK
            three = sig.reshape(-1, CHUNKS, CHUNK)[:, :, _LEFT_TWO].astype(np.uint64)
            number = np.arange(CHUNKS * len(_LEFT_TWO), dtype=np.uint64).reshape(CHUNKS, -1)
            made = ts.mix((three[..., 0] | three[..., 1] << np.uint64(16) | three[..., 2] << np.uint64(32) | number << np.uint64(48)) ^ ts.mix(key + np.uint64(7))[:, None, None])
            rest = np.repeat((np.arange(CHUNKS) != own[:, None])[:, :, None], len(_LEFT_TWO), 2)
            row = pa.array(np.broadcast_to(np.arange(len(part))[:, None, None], made.shape)[rest])
            yield pa.RecordBatch.from_arrays([pa.array(made[rest].view(np.int64)), *(part.column(k).take(row) for k in range(1, 5))], ["key", "sid", "label", "n", "lo"])


# --------------------------------------------------- comparisons in groups


def _grouped(work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]):
    """Runs ``work`` on the rows of each key (the first column, which the rows
    are sorted by); it returns edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None

        def sent(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            key, out = batch.column(0).to_numpy(), []
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            for lo, hi in zip([0, *edge], [*edge, len(key)], strict=True):
                if hi == lo:
                    continue
                if held and key[lo] != held_key:
                    out.append(work(pa.Table.from_batches(held)))
                    held = []
                held_key = key[lo]
                held.append(batch.slice(lo, hi - lo))
            if out:
                yield sent(out)
        if held:
            yield sent([work(pa.Table.from_batches(held))])

    return run


def _merged(label: np.ndarray, near: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and what they join: of all pairs with different labels, those
    where ``near(i)`` marks the other are joined.  Only members outside the
    commonest label are asked."""
    names, at = np.unique(label, return_inverse=True)
    group = np.arange(len(names))
    for i in np.flatnonzero(at != np.bincount(at).argmax()).tolist():
        now = group[at]
        joined = np.unique(now[near(i) & (now != now[i])])
        if len(joined):
            joined = np.append(joined, now[i])
            group[np.isin(group, joined)] = joined.min()
    moved = np.flatnonzero(group != np.arange(len(names)))
    return names[moved], names[group[moved]]


def _families(percent: int):
    """Edges between labels of members (key, sid, label, n, lo) of a group with
    signatures within ERRORS and sizes that allow a link."""

    def work(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        label, n = rows.column(2).to_numpy(), rows.column(3).to_numpy()
        if (label == label[0]).all():
            return label[:0], label[:0]
        sig = _matrix(rows.column(4).combine_chunks())
        return _merged(label, lambda i: ((sig != sig[i]).sum(1) <= ERRORS) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))

    return _grouped(work)


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in ts.blocks(batch.column(0)):
                own, bounds = shingles(block, width)
                sets = [own[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, _set_ids(own, bounds)), pa.array(sets, pa.binary())], ["h1", "h2", "set"])

    return run


def _confirmed(percent: int):
    """Edges between labels of members (key, sid, label, set) of a group whose
    sets are linked.  Shared elements of pairs are counted as products of 0/1
    columns, a bounded number at a time."""

    def work(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sid, once = np.unique(rows.column(1).to_numpy(), return_index=True)
        label = rows.column(2).to_numpy()[once]
        if (label == label[0]).all():
            return label[:0], label[:0]
        column = rows.column(3).combine_chunks()
        sets = [np.frombuffer(column[k].as_buffer(), np.uint64) for k in once.tolist()]
        size = np.array([len(x) for x in sets])
        value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        if len(sets) == 2:
            both = int(np.count_nonzero(value[1:] == value[:-1]))
            hit = 100 * both >= percent * (len(value) - both)
            return (label.max()[None], label.min()[None]) if hit else (label[:0], label[:0])
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        column = np.cumsum(fresh) - 1
        often = np.bincount(column)[column] > 1
        owner, column = owner[often], column[often]
        # a number for each element that two sets have
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
        shared = np.zeros((len(sets), len(sets)))
        lo, wide = 0, 2048
        while lo < len(column):
            hi = int(np.searchsorted(column, column[lo] + wide))
            part = np.zeros((len(sets), min(wide, int(column[hi - 1] - column[lo]) + 1)), np.float32)
            part[owner[lo:hi], column[lo:hi] - column[lo]] = 1
            shared += part @ part.T
            lo = hi
        return _merged(label, lambda i: 100 * shared[i] >= percent * (size + size[i] - shared[i]))

    return _grouped(work)


def components(edges: DataFrame, tables: Tables, bound: int = EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots, each the
    smallest node of its component: alternating large and small stars until
    nothing changes.

    Up to ``bound`` edges (counted), the table of nodes' least neighbours is
    broadcast.  Above, those of hubs are, the nodes with over 2 / ``bound`` of
    the edges, of which there are ``bound`` / 2 at most; the others join by a
    shuffle, in which no key is large."""
    edges = tables.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.toDF("node", "root")
        seen, few = state, state[0] <= bound

        def placed(rows: DataFrame, by: str, least: DataFrame) -> DataFrame:
            """``rows`` with ``m``, what ``least`` (u, m) has for column ``by``."""
            own = least.withColumnRenamed("u", by)
            if few:
                return rows.join(F.broadcast(own), by, "left")
            hubs = rows.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * seen[0] / bound).select(by)
            hubs = tables.keep(hubs.join(own, by, "left").withColumn("hub", F.lit(True)))
            marked = rows.join(F.broadcast(hubs), by, "left")
            rest = marked.filter("hub is null").drop("hub", "m").join(own, by, "left")
            return marked.filter("hub").select(rest.columns).unionByName(rest)

        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        least = least if few else tables.keep(least)
        large = placed(edges, "v", least).select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = large if few else tables.keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = least if few else tables.keep(least)
        small = placed(large, "u", least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = tables.keep(edges.coalesce(1 + state[0] // 20_000) if few else edges)


def _apart(members: DataFrame) -> DataFrame:
    """Members (whole, label, weight, ...) of those wholes that have several
    labels, with the weight of ``all``, of those ``apart`` from the commonest
    label, and ``far`` for these."""
    votes = members.groupBy("whole", "label").agg(F.sum("weight").alias("w"))
    kinds = votes.groupBy("whole").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.sum("w").alias("all"), (F.sum("w") - F.max("w")).alias("apart"), F.count("*").alias("labels"))
    return members.join(kinds.filter("labels > 1").drop("labels"), "whole").withColumn("far", F.col("label") != F.col("main")).drop("main")


def _dealt(members: DataFrame, room: int) -> DataFrame:
    """``members`` (whole, sid, all, apart, far, ...) with ``key``, so that each
    ``far`` one shares a key with every other of its whole, and a key has about
    ``room`` of weight at most: a whole beyond that is dealt into parts, its far
    members into chunks, and each part meets each chunk."""
    fits = F.col("all") <= room
    rows = members.withColumn("_parts", F.when(fits, 1).otherwise(F.ceil(2 * F.col("all") / room)).cast("int"))
    rows = rows.withColumn("_chunks", F.when(fits, 1).otherwise(F.greatest(F.lit(1), F.ceil(2 * F.col("apart") / room))).cast("int"))
    part, chunk = (F.pmod(F.xxhash64("sid", F.lit(k)), n).cast("int") for k, n in ((3, "_parts"), (4, "_chunks")))
    near = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: part * F.col("_chunks") + c)
    far = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: p * F.col("_chunks") + chunk)
    rows = rows.withColumn("_cell", F.explode(F.when(F.col("far"), F.array_union(near, far)).otherwise(near)))
    return rows.withColumn("key", F.when(fits, F.col("whole")).otherwise(F.xxhash64("whole", "_cell"))).drop("_parts", "_chunks", "_cell")


def _by_key(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("key", *columns).repartition("key").sortWithinPartitions("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, cap: int = CAP, group: int = GROUP, room: int = ROOM, again: int = AGAIN, bound: int = EDGES) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_shingles, component_id, kept).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a
    text's set holds its distinct runs of ``width`` words, as 64-bit hashes;
    equal sets are those with equal 128-bit hashes.  Texts are linked if
    100 * shared >= ``percent`` * united.  ``component_id`` is the smallest id
    reachable over links; a row is kept if that is its own id.

    Null or empty texts, and texts without words, have 0 shingles, are linked
    with nothing and kept.  A text with fewer than ``width`` words has one
    shingle, all its words.  A null id is never a component's id; its row is
    kept only if all of its component lack an id (component_id null).  Rows that
    repeat an id keep their own verdicts, so equal rows are kept or dropped
    together.  Any other columns are ignored.  An empty table gives an empty
    result.  ``percent`` must be 80 or more: below, the signature distance no
    longer covers the links.  ``cap``, ``group``, ``room``, ``again`` and
    ``bound`` bound what is compared at once and choose paths; the result does
    not depend on them.
    """
    if percent < 80:
        raise ValueError("signatures are sized for similarities of 0.8 or more")
    source = only(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    with Tables(docs.sparkSession) as tables:
        rows = tables.keep(source.mapInArrow(_sketch(width), f"id {kind}, n bigint, h1 bigint, h2 bigint, hi binary, lo binary"))
        one = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "hi", "lo")))
        sets = tables.keep(one.withColumn("sid", F.monotonically_increasing_id()))
        families = _candidates(sets, tables, percent, cap, group, again, bound)
        roots = _linked(source, sets, families, tables, width, percent, room, bound)

        named = sets.select("sid", "h1", "h2", "id").join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        least = named.groupBy("root").agg(F.min("id").alias("component_id"))
        named = named.join(least, "root").select("h1", "h2", "component_id")
        out = rows.select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
        part = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
        return tables.result(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(F.col("id") == part, part.isNull()).alias("kept")))


def _candidates(sets: DataFrame, tables: Tables, percent: int, cap: int, group: int, again: int, bound: int) -> DataFrame:
    """(node, root): the families of sets with signatures within ERRORS, over
    any number of steps, roots left out."""
    index = sets.select("sid", "hi", "lo").mapInArrow(_index, "kind tinyint, a bigint, b bigint")
    # what needs no meeting is spread evenly
    to = F.when(F.col("kind") >= CROWDED, F.col("a")).otherwise(F.xxhash64("a", "b"))
    found = tables.keep(index.repartition(to).sortWithinPartitions("a", "kind", "b").mapInArrow(_scan(cap), "kind tinyint, a bigint, b bigint"))
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    left, right = (sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("lo").alias(f"s{x}")) for x in "ab")
    likely = pairs.join(left, "a").join(right, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = likely.select("a", "b", "sa", "sb").mapInArrow(_close, "a bigint, b bigint")
    families = components(near, tables, bound)

    crowd = found.filter(F.col("kind") == MEMBER).select(F.col("a").alias("whole"), F.col("b").alias("sid"), F.lit(1).alias("weight"))
    open_ = tables.keep(_apart(_labelled(crowd, families)))
    if not open_.limit(1).count():
        return families

    def compared(members: DataFrame) -> DataFrame:
        return _by_key(_dealt(members, group), "sid", "label", "n", "lo").mapInArrow(_families(percent), "a bigint, b bigint")

    large = F.col("apart") > again * group
    more = compared(open_.filter(~large).join(sets.select("sid", "n", "lo"), "sid"))
    rest = open_.filter(large)
    if rest.limit(1).count():
        signed = rest.join(sets.select("sid", "n", "lo", "hi"), "sid").select(F.col("whole").alias("key"), "sid", "label", "n", "lo", "hi")
        split = tables.keep(signed.mapInArrow(_split_again, "key bigint, sid bigint, label bigint, n bigint, lo binary"))
        more = more.unionByName(compared(_apart(split.withColumnsRenamed({"key": "whole"}).withColumn("weight", F.lit(1)))))
    return components(families.toDF("a", "b").unionByName(more), tables, bound)


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.toDF("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _linked(source: DataFrame, sets: DataFrame, families: DataFrame, tables: Tables, width: int, percent: int, room: int, bound: int) -> DataFrame:
    """(node, root) of the components of confirmed links, roots left out."""
    whole = families.toDF("sid", "whole")
    whole = whole.unionByName(whole.select(F.col("whole").alias("sid"), "whole").distinct())
    # a group has GROUP sets at most, however small they are
    weight = F.greatest(8 * F.col("n"), F.lit(room // GROUP + 1))
    members = whole.join(sets.select("sid", "id", "h1", "h2", "n"), "sid").withColumn("weight", weight)
    sizes = members.groupBy("whole").agg(F.sum("weight").alias("all"), F.count("*").alias("sets"))
    members = tables.keep(members.join(sizes, "whole").withColumn("label", F.col("sid")))

    def complete(some: DataFrame) -> DataFrame:
        """(h1, h2, set) of sets, made anew from the texts of their ids."""
        ids = tables.keep(some.select("id").distinct())
        texts = matching(source, "id", ids, "left_semi").select("text")
        return texts.mapInArrow(_full_sets(width), "h1 bigint, h2 bigint, set binary").groupBy("h1", "h2").agg(F.first("set").alias("set"))

    def confirmed(dealt: DataFrame, full: DataFrame) -> DataFrame:
        rows = _by_key(dealt.join(full, ["h1", "h2"]), "sid", "label", "set")
        return tables.keep(rows.mapInArrow(_confirmed(percent), "a bigint, b bigint"))

    fits = F.col("all") <= room
    small = members.filter(fits)
    roots = confirmed(small.withColumn("key", F.col("whole")), complete(small))
    large = members.filter(~fits)
    if large.limit(1).count():
        full = tables.keep(complete(large).join(large.select("h1", "h2"), ["h1", "h2"], "left_semi"))
        share = F.greatest(F.lit(1), F.floor(F.col("sets") / FACES))
        faces = large.withColumns({"far": F.pmod(F.xxhash64("sid", F.lit(9)), share) == 0, "apart": F.col("all") / share})
        first = confirmed(_dealt(faces, room), full)
        settled = _labelled(large.drop("label", "all"), components(first, tables, bound))
        second = confirmed(_dealt(_apart(settled), room), full)
        roots = roots.unionByName(components(first.unionByName(second), tables, bound).toDF("a", "b"))
    return roots


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``near_duplicates``
    does not keep.  Rows that share an id go only if none of them is kept, so
    all copies of a row that repeats both id and text stay."""
    with Tables(docs.sparkSession) as tables:
        verdict = near_duplicates(docs, id_col, text_col, width, percent)
        gone = verdict.groupBy(id_col).agg(F.max("kept").alias("any")).filter("not any").select(id_col)
        return matching(docs, id_col, tables.result(gone), "left_anti")
