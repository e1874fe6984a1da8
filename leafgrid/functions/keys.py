"""Hierarchical cell keys as column expressions.

An octant is (level, prefix): ``prefix`` interleaves the bits of its integer
position at that level, x lowest, so the child number is 4z + 2y + x in 3-D.
``key`` is a point's prefix at full depth; a cell's descendants have the keys
from ``first_key`` to ``last_key``.  Depths up to 20 fit a BIGINT.  All
functions take and give columns, for 1 to 3 dimensions, and stay in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 20
AXES = ("x", "y", "z")


def _long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def axis_mask(axis: int, dim: int = 3) -> int:
    """The bits of a prefix that belong to an axis."""
    return sum(1 << dim * b + axis for b in range(MAX_DEPTH + 1) if dim * b + axis < 63)


def spread(value: Column, dim: int = 3) -> Column:
    """The bits of a number with ``dim - 1`` zero bits between them: its binary
    digits read in base 2**dim."""
    return _long(value) if dim == 1 else F.conv(F.bin(_long(value)), 2**dim, 10).cast("long")


def gather(value: Column, dim: int = 3) -> Column:
    """Inverse of ``spread``: every ``dim``-th bit, moved together."""
    if dim == 1:
        return _long(value)
    digits = F.conv(_long(value).bitwiseAND(F.lit(axis_mask(0, dim))).cast("string"), 10, 2**dim)
    return F.conv(digits, 2, 10).cast("long")


def _on(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask))


def _stepped(value: Column, mask: int, by: int) -> Column:
    """A coordinate inside a prefix moved by -1, 0 or 1, without unpacking."""
    if by > 0:
        return _on(value.bitwiseOR(F.lit(~mask)) + 1, mask)
    return _on(_on(value, mask) - 1, mask) if by else _on(value, mask)


def _united(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def interleave(*position: Column) -> Column:
    """Prefix of an integer position (x, then y, then z)."""
    dim, out = len(position), None
    for axis, value in enumerate(position):
        part = F.shiftleft(spread(value, dim), axis) if axis else spread(value, dim)
        out = part if out is None else out.bitwiseOR(part)
    return out


def position(prefix: Column | str, dim: int = 3) -> list[Column]:
    """Integer position of a cell at its level."""
    prefix = _long(prefix)
    return [gather(F.shiftright(prefix, axis) if axis else prefix, dim) for axis in range(dim)]


def quantise(value: Column, depth: int, length: Column | float) -> Column:
    """Cell number of a coordinate in [0, length) at full depth."""
    return F.floor(value * F.lit(float(2**depth)) / (F.lit(length) if isinstance(length, (int, float)) else length)).cast("long")


def up(prefix: Column | str, levels: Column | int, dim: int = 3) -> Column:
    """Prefix of the ancestor that is ``levels`` above."""
    if isinstance(levels, int):
        return F.shiftright(_long(prefix), dim * levels)
    return F.call_function("shiftright", _long(prefix), (levels * dim).cast("int"))


def down(prefix: Column | str, levels: Column | int, dim: int = 3) -> Column:
    """Prefix of the first descendant that is ``levels`` below."""
    if isinstance(levels, int):
        return F.shiftleft(_long(prefix), dim * levels)
    return F.call_function("shiftleft", _long(prefix), (levels * dim).cast("int"))


def first_key(level: Column, prefix: Column, depth: int, dim: int = 3) -> Column:
    """Key of the deepest first descendant."""
    return down(prefix, F.lit(depth) - level, dim)


def last_key(level: Column, prefix: Column, depth: int, dim: int = 3) -> Column:
    """Key of the deepest last descendant."""
    return down(prefix + 1, F.lit(depth) - level, dim) - 1


def child_number(prefix: Column | str, dim: int = 3) -> Column:
    return _long(prefix).bitwiseAND(F.lit(2**dim - 1)).cast("int")


def parent_level(level: Column) -> Column:
    """The root is its own parent."""
    return F.greatest(level - 1, F.lit(0))


def children(prefix: Column | str, dim: int = 3) -> Column:
    """Array of the children's prefixes, in order."""
    base = F.shiftleft(_long(prefix), dim)
    return F.transform(F.sequence(F.lit(0), F.lit(2**dim - 1)), lambda c: base + c)


def siblings(prefix: Column | str, dim: int = 3) -> Column:
    """Array of the prefixes of the other children of a cell's parent."""
    own = _long(prefix)
    return F.filter(children(F.shiftright(own, dim), dim), lambda s: s != own)


def is_ancestor(level: Column, prefix: Column, other_level: Column, other: Column, dim: int = 3) -> Column:
    """Whether the first cell is a strict ancestor of the second."""
    return (level < other_level) & (up(other, F.greatest(other_level - level, F.lit(0)), dim) == prefix)


def comparable(level: Column, prefix: Column, other_level: Column, other: Column, dim: int = 3) -> Column:
    """Whether two cells overlap: one is the other or contains it."""
    least = F.least(level, other_level)
    return up(prefix, level - least, dim) == up(other, other_level - least, dim)


def cell_centre(*position_: Column, depth: int) -> list[Column]:
    """Centre in the unit cube of an integer position at full depth."""
    return [(p + 0.5) / F.lit(float(2**depth)) for p in position_]


def next_cell(level: Column, prefix: Column, dim: int = 3) -> tuple[Column, Column]:
    """(level, prefix) of the coarsest cell that starts where a cell ends; for
    the last cell of the domain the root's successor (0, 1)."""
    after = _long(prefix) + 1
    low = after.bitwiseAND(-after)
    zeros = F.length(F.bin(low)) - 1
    by = F.least(F.floor(zeros / dim).cast("int"), level)
    return level - by, up(after, by, dim)


def common_ancestor(level: Column, prefix: Column, other_level: Column, other: Column, dim: int = 3) -> tuple[Column, Column]:
    """(level, prefix) of the nearest common ancestor; a cell counts as its own."""
    least = F.least(level, other_level)
    a, b = up(prefix, level - least, dim), up(other, other_level - least, dim)
    apart = a.bitwiseXOR(b)
    by = F.when(apart == 0, 0).otherwise(F.ceil(F.length(F.bin(apart)) / dim)).cast("int")
    return least - by, up(a, by, dim)


def _all_bits(level: Column, dim: int) -> Column:
    """The prefix of the last cell of a level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (level * dim).cast("int")) - 1


def boundary_flags(level: Column, prefix: Column, dim: int = 3) -> Column:
    """Bits 1, 2, 4 for touching the domain at the low end of x, y, z and 32,
    64, 128 at the high end."""
    last, out = _all_bits(level, dim), F.lit(0)
    for axis in range(dim):
        mask = axis_mask(axis, dim)
        at = _on(_long(prefix), mask)
        out = out + F.when(at == 0, 1 << axis).otherwise(0) + F.when(at == _on(last, mask), 32 << axis).otherwise(0)
    return out.cast("int")


def offsets(dim: int = 3, corners: bool = True) -> list[tuple[int, ...]]:
    """The directions of neighbours: all, or without those over corners."""
    out = [()]
    for _ in range(dim):
        out = [(*o, d) for o in out for d in (-1, 0, 1)]
    most = dim if corners or dim == 1 else dim - 1
    return [o for o in out if 0 < sum(map(abs, o)) <= most]


def neighbours(level: Column, prefix: Column, dim: int = 3, corners: bool = True, itself: bool = False) -> Column:
    """Array of the prefixes of the same-level cells around, inside the domain."""
    own, last = _long(prefix), _all_bits(level, dim)
    masks = [axis_mask(a, dim) for a in range(dim)]
    found = []
    for step in [*offsets(dim, corners), *([(0,) * dim] if itself else [])]:
        moved = _united([_stepped(own, m, d) for m, d in zip(masks, step, strict=True)])
        inside = F.lit(True)
        for m, d in zip(masks, step, strict=True):
            if d:
                inside = inside & (_on(own, m) != (_on(last, m) if d > 0 else 0))
        found.append(F.when(inside, moved))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def parents_around(level: Column, prefix: Column, dim: int = 3, corners: bool = True) -> Column:
    """Array of the prefixes of the parents of a cell (not the root) and of the
    same-level cells around it: the own parent and those on the cell's side."""
    own = _long(prefix)
    parent, last = F.shiftright(own, dim), _all_bits(level - 1, dim)
    masks = [axis_mask(a, dim) for a in range(dim)]
    same = [_on(parent, m) for m in masks]
    upper = [_on(own, 1 << a) != 0 for a in range(dim)]
    moved = [F.when(u, _stepped(parent, m, 1)).otherwise(_stepped(parent, m, -1)) for u, m in zip(upper, masks, strict=True)]
    at_end = [F.when(u, s == _on(last, m)).otherwise(s == 0) for u, s, m in zip(upper, same, masks, strict=True)]
    most = dim if corners or dim == 1 else dim - 1
    found = []
    for step in range(2**dim):
        if step.bit_count() <= most:
            inside = F.lit(True)
            for axis in range(dim):
                if step >> axis & 1:
                    inside = inside & ~at_end[axis]
            found.append(F.when(inside, _united([moved[a] if step >> a & 1 else same[a] for a in range(dim)])))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def search_keys(level: Column, prefix: Column, depth: int, dim: int = 3, corners: bool = True) -> Column:
    """Keys of the deepest cells that lie outside a cell's parent, diagonally
    off the corner where the cell and its parent meet; outside the domain left
    out."""
    own = _long(prefix)
    low, high = first_key(level, own, depth, dim), last_key(level, own, depth, dim)
    masks = [axis_mask(a, dim) for a in range(dim)]
    upper = [_on(own, 1 << a) != 0 for a in range(dim)]
    inner = [F.when(u, _on(high, m)).otherwise(_on(low, m)) for u, m in zip(upper, masks, strict=True)]
    outer = [F.when(u, _stepped(high, m, 1)).otherwise(_stepped(low, m, -1)) for u, m in zip(upper, masks, strict=True)]
    at_end = [F.when(u, _on(high, m) == m & (1 << dim * depth) - 1).otherwise(_on(low, m) == 0) for u, m in zip(upper, masks, strict=True)]
    found = []
    for step in range(1, 2**dim):
        if not corners and dim > 1 and step == 2**dim - 1:
            continue
        inside = F.lit(True)
        for axis in range(dim):
            if step >> axis & 1:
                inside = inside & ~at_end[axis]
        found.append(F.when(inside, _united([outer[a] if step >> a & 1 else inner[a] for a in range(dim)])))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def hilbert(*position_: Column, depth: int) -> Column:
    """Place of an integer position on the Hilbert curve of the given depth,
    by Skilling's transform, as plain bit operations for each level."""
    x = [_long(p) for p in position_]
    n = len(x)
    # every level reads all coordinates, so each is bound once in a struct array
    state = F.struct(*(v.alias(f"c{a}") for a, v in enumerate(x)))

    def undo(s: Column, q: Column) -> Column:
        c = [s[f"c{a}"] for a in range(n)]
        low = q - 1
        for a in range(n):
            both = c[0].bitwiseXOR(c[a]).bitwiseAND(low)
            hit = c[a].bitwiseAND(q) != 0
            first = F.when(hit, c[0].bitwiseXOR(low)).otherwise(c[0].bitwiseXOR(both))
            own = F.when(hit, c[a]).otherwise(c[a].bitwiseXOR(both))
            c = [first, *c[1:]] if a == 0 else [first, *c[1:a], own, *c[a + 1 :]]
        return F.struct(*(v.alias(f"c{a}") for a, v in enumerate(c)))

    masks = F.array(*(F.lit(1 << b).cast("long") for b in range(depth - 1, 0, -1))) if depth > 1 else F.array().cast("array<bigint>")

    def place(s: Column) -> Column:
        c = [s["c0"]]
        for a in range(1, n):
            c.append(s[f"c{a}"].bitwiseXOR(c[-1]))
        turn = F.lit(0).cast("long")
        for b in range(depth - 1, 0, -1):
            turn = turn.bitwiseXOR(F.when(_on(c[-1], 1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return interleave(*(v.bitwiseXOR(turn) for v in reversed(c)))

    # an array of one, so that the state is worked out once
    return F.transform(F.array(F.aggregate(masks, state, undo)), place)[0]
