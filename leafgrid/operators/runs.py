"""Passes over cells in curve order, chunk by chunk.

Rows are dealt by ranges of the key and sorted, so that a cell's points are
neighbours. A chunk of a task's rows finds all cells that lie inside it; cells
that may go on in another chunk contain its first or last row (``depth`` cells
each), and for these every chunk gives its share, which are then summed. So no
row is listed once a level, and no task has to hold a whole cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk at least, if the task has as many.
CHUNK = 1 << 18


#: Cells of a chunk that ``balanced`` starts from; it lists several for each.
STARTS = 1 << 16

#: Rows of a task, about, where the number of rows is known.
ROWS = 1 << 20


def tasks(rows: DataFrame, total: int) -> list[int]:
    """The number of partitions for ``total`` rows, if it has to be over that of
    the session's shuffles, as an argument of ``repartition``."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [-(-total // ROWS)] if total > ROWS * usual else []


def in_order(rows: DataFrame, *by: str, total: int = 0, parts: int = 0) -> DataFrame:
    return rows.repartitionByRange(*([parts] if parts else tasks(rows, total)), *by).sortWithinPartitions(*by)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """Columns of chunks of rows, those with nulls left out."""

    def chunk(held: list[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        rows = pa.Table.from_batches(held).drop_null()
        if rows.num_rows:
            yield [c.to_numpy() for c in rows.columns]

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield from chunk(held)
            held, n = [], 0
    if n:
        yield from chunk(held)


def by_chunk(rows: DataFrame, work: Callable[..., list[np.ndarray]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """What ``work`` makes of the columns of each chunk, as columns."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _chunks(batches, chunk):
            made = pa.RecordBatch.from_arrays([pa.array(c) for c in work(*columns)], names=names)
            for at in range(0, made.num_rows, 1 << 16):
                yield made.slice(at, 1 << 16)

    return rows.mapInArrow(run, schema)


def bits(value: np.ndarray) -> np.ndarray:
    """Numbers of binary digits, 0 for 0; halves, as floats are exact to 53."""
    high = value >> 32
    return np.where(high > 0, 32 + np.frexp(high.astype(float))[1], np.frexp((value & 0xFFFFFFFF).astype(float))[1])


def shared(keys: list[np.ndarray], depths: list[int], dim: int) -> np.ndarray:
    """Of each row the deepest level at which it lies in one cell with the row
    before, -1 for the first row. ``depths``: the levels that each key adds."""
    out = np.full(len(keys[0]), -1)
    level, same = np.zeros(len(out) - 1, np.int64), np.ones(len(out) - 1, bool)
    for key, depth in zip(keys, depths, strict=True):
        apart = key[1:] ^ key[:-1]
        level += np.where(same, depth - -(-bits(apart) // dim), 0)
        same &= apart == 0
    out[1:] = level
    return out


def prefixes(keys: list[np.ndarray], depths: list[int], level: int, dim: int) -> list[np.ndarray]:
    out = []
    for key, depth in zip(keys, depths, strict=True):
        own = min(max(level, 0), depth)
        out.append(key >> dim * (depth - own) if own else key * 0)
        level -= depth
    return out


def _merged(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, the rows in that order and where each key starts."""
    row = np.lexsort(keys[::-1])
    keys = [k[row] for k in keys]
    starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    return [k[starts] for k in keys], row, starts


def tallied(points: DataFrame, *names: str, chunk: int = CHUNK) -> DataFrame:
    """(the keys, _n): keys without nulls and their numbers, each once a chunk;
    no task has to hold all its keys."""

    def work(*columns: np.ndarray) -> list[np.ndarray]:
        keys, _, starts = _merged(list(columns))
        return [*keys, np.diff(np.append(starts, len(columns[0])))]

    return by_chunk(points.select(*names), work, f"{', '.join(f'{n} bigint' for n in names)}, _n bigint", chunk)


def crowded(counts: DataFrame, depths: dict[str, int], most: int, dim: int = 3, leaves: bool = False, chunk: int = CHUNK, total: int = 0) -> DataFrame:
    """(level, the keys, _n): all cells with over ``most`` points, above full
    depth, and possibly others, with their exact counts. With ``leaves`` also
    the cells with points whose parent has over ``most``. ``counts``: (the keys,
    _n) at full depth, ``total`` at most; ``depths``: the levels that each key
    adds."""
    names, parts = list(depths), list(depths.values())
    depth = sum(parts)

    def work(*columns: np.ndarray) -> list[np.ndarray]:
        *keys, n = columns
        before = shared(keys, parts, dim)
        found, open_, above = [], None, None
        for level in range(depth + (1 if leaves else 0)):
            starts = np.flatnonzero(before < level)
            total = np.add.reduceat(n, starts)
            go_on = total > most
            go_on[[0, -1]] = True
            if above is not None:  # inside a crowded cell, or one that goes on elsewhere
                inside = open_[np.searchsorted(above, starts, "right") - 1]
                go_on &= inside
                listed = inside if leaves else go_on
            else:
                listed = np.ones(1, bool)
            at = starts[listed]
            found.append([np.full(len(at), level, np.int32), *prefixes([k[at] for k in keys], parts, level, dim), total[listed]])
            above, open_ = starts, go_on
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    listed = by_chunk(in_order(counts.select(*names, "_n"), *names, total=total), work, f"level int, {', '.join(f'{k} bigint' for k in names)}, _n bigint", chunk)
    return listed.groupBy("level", *names).agg({"_n": "sum"}).withColumnRenamed("sum(_n)", "_n")


def _cells_in_order(cells: DataFrame, dim: int, depth: int) -> DataFrame:
    """Cells (level, prefix) as (key, level), key being that of full depth; a
    cell comes before all that it contains."""
    key = F.call_function("shiftleft", F.col("prefix"), ((F.lit(depth) - F.col("level")) * dim).cast("int"))
    return in_order(cells.select(key.alias("key"), "level"), "key", "level")


def _new_above(key: np.ndarray, level: np.ndarray, dim: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the levels, from the first to below the second, of its strict
    ancestors that are not those of rows before it."""
    first = np.minimum(shared([key], [depth], dim), np.append(-1, level[:-1] - 1)) + 1
    return np.minimum(first, level), level


def _listed(key: np.ndarray, first: np.ndarray, end: np.ndarray, dim: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    n = end - first
    row = np.repeat(np.arange(len(n)), n)
    level = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    return level.astype(np.int32), key[row] >> dim * (depth - level)


def ancestors(cells: DataFrame, dim: int, depth: int, chunk: int = CHUNK) -> DataFrame:
    """(level, prefix) of all strict ancestors, each once a chunk."""

    def work(key: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
        return list(_listed(key, *_new_above(key, level.astype(np.int64), dim, depth), dim, depth))

    return by_chunk(_cells_in_order(cells, dim, depth), work, "level int, prefix bigint", chunk)


#: Kinds of rows of ``finest``.
KEPT, LAST, ABOVE = range(3)


def finest(cells: DataFrame, dim: int, depth: int, chunk: int = CHUNK) -> DataFrame:
    """(level, prefix, kind) of distinct ``cells``: KEPT for those that contain
    no other, LAST for a chunk's last, which stays if no later chunk's first cell
    lies in it, and ABOVE for the ancestors of a chunk's first cell."""

    def work(key: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
        level = level.astype(np.int64)
        inside = np.append(shared([key], [depth], dim)[1:] >= level[:-1], False)
        own = ~inside
        kind = np.full(len(key), KEPT, np.int32)
        kind[-1] = LAST
        top, prefix = _listed(key[:1], level[:1] * 0, level[:1], dim, depth)
        kinds = np.concatenate([kind[own], np.full(len(top), ABOVE, np.int32)])
        return [np.append(level[own].astype(np.int32), top), np.append((key >> dim * (depth - level))[own], prefix), kinds]

    return by_chunk(_cells_in_order(cells, dim, depth), work, "level int, prefix bigint, kind int", chunk)


def _own(level: np.ndarray | int, depths: list[int]) -> list[np.ndarray | int]:
    """How many of the levels of a cell each key has."""
    before = np.cumsum([0, *depths[:-1]])
    return [np.clip(level - b, 0, d) for b, d in zip(before.tolist(), depths, strict=True)]


def _moved(keys: list[np.ndarray], own: list[int], axis: int, by: int, dim: int) -> tuple[list[np.ndarray], np.ndarray]:
    """An axis's bits of the keys, moved by -1, 0 or 1, from the last key on
    with carry, and whether that is inside the domain."""
    out, carry = [], np.full(len(keys[0]), by != 0)
    for key, levels in zip(keys[::-1], own[::-1], strict=True):
        mask = sum(1 << dim * b + axis for b in range(levels))
        at = key & mask
        if by and levels:
            to = ((key | ~mask) + 1 if by > 0 else at - 1) & mask
            out.append(np.where(carry, to, at))
            carry = carry & (at == (mask if by > 0 else 0))
        else:
            out.append(at)
    return out[::-1], ~carry


def _asked(dim: int, corners: bool) -> np.ndarray:
    """For each step from a cell to one around it or itself, by the bits of the
    cell's split children: whether that one has to be split."""
    most = dim if corners or dim == 1 else dim - 1
    out, bits_ = np.zeros((3**dim, 1 << 2**dim), bool), np.arange(1 << 2**dim)
    for k, step in enumerate(product((-1, 0, 1), repeat=dim)):
        for c in range(2**dim):
            if sum(map(abs, step)) <= most and all(not s or s == (1 if c >> a & 1 else -1) for a, s in enumerate(step)):
                out[k] |= (bits_ >> c & 1).astype(bool)
    return out


def balanced(cells: DataFrame, depths: dict[str, int], dim: int = 3, corners: bool = True, chunk: int = STARTS, total: int = 0) -> DataFrame:
    """(level, the keys, _kids): the cells that are split in the balanced tree,
    if ``cells`` (level, the keys), ``total`` at most, are, with their split
    children as bits.

    What a cell asks to be split does not depend on other cells, so a chunk
    lists all levels for its own cells; cells that several chunks ask for come
    from each of them, with bits to be united."""
    names, parts = list(depths), list(depths.values())
    asked, steps = _asked(dim, corners), list(product((-1, 0, 1), repeat=dim))

    def work(level: np.ndarray, *full: np.ndarray) -> list[np.ndarray]:
        seeds = [k >> dim * (d - o) for k, d, o in zip(full, parts, _own(level.astype(np.int64), parts), strict=True)]
        at, kids, found = [k[:0] for k in seeds], np.zeros(0, np.int32), []
        for l in range(int(level.max()), -1, -1):
            here = level == l
            at = [np.concatenate([a, k[here]]) for a, k in zip(at, seeds, strict=True)]
            own = _own(l, parts)
            used = max(1, sum(o > 0 for o in own))  # the keys below have no levels and are 0
            _, row, starts = _merged(at[:used])
            at = [k[row[starts]] for k in at]
            kids = np.bitwise_or.reduceat(np.append(kids, np.zeros(here.sum(), np.int32))[row], starts)
            found.append([np.full(len(kids), l, np.int32), *at, kids])
            if not l:
                break
            bit = (1 << (at[used - 1] & (1 << dim) - 1)).astype(np.int32)
            up = [k >> dim if j == used - 1 else k for j, k in enumerate(at)]
            starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in up])))
            up, bits_ = [k[starts] for k in up], np.bitwise_or.reduceat(bit, starts)
            moved = [{by: _moved(up, _own(l - 1, parts), a, by, dim) for by in (-1, 0, 1)} for a in range(dim)]
            next_, kids_ = [], []
            for k, step in enumerate(steps):
                to = [moved[a][by] for a, by in enumerate(step)]
                take = np.flatnonzero(np.logical_and.reduce([asked[k][bits_], *(inside for _, inside in to)]))
                next_.append([np.bitwise_or.reduce([keys[j][take] for keys, _ in to]) for j in range(len(up))])
                kids_.append(np.zeros(len(take), np.int32) if any(step) else bits_[take])
            at, kids = [np.concatenate(k) for k in zip(*next_, strict=True)], np.concatenate(kids_)
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    level, before = F.col("level"), 0
    full = []
    for name, depth in depths.items():
        own = F.greatest(F.least(level - before, F.lit(depth)), F.lit(0))
        full.append(F.call_function("shiftleft", F.col(name), ((F.lit(depth) - own) * dim).cast("int")).alias(name))
        before += depth
    rows = in_order(cells.select("level", *full), *names, parts=max(1, -(-total // STARTS)))
    return by_chunk(rows, work, f"level int, {', '.join(f'{k} bigint' for k in names)}, _kids int", chunk)
