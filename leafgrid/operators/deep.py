"""Linear octrees deeper than one 64-bit key holds, to level 35.

A cell is (level, hi, lo): ``hi`` is the prefix of its ancestor at level ``TOP``
(its own prefix, if it is not finer) and ``lo`` its prefix below that ancestor
(0, if it is not finer).  So a deep tree is a tree of trees, each of which has
ordinary keys; joins and sums are by (level, hi, lo), and neighbours carry from
``lo`` to ``hi``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from . import runs, tree

TOP, DEEPEST = 15, 35
CELL = ("level", "hi", "lo")


def _zero() -> Column:
    return F.lit(0).cast("long")


def key(*position: Column, depth: int) -> tuple[Column, Column]:
    """(hi, lo) of an integer position at ``depth``, which is TOP or more."""
    low = depth - TOP
    return K.interleave(*(F.shiftright(p, low) for p in position)), K.interleave(*(p.bitwiseAND(F.lit((1 << low) - 1)) for p in position))


def position(dim: int = 3) -> list[Column]:
    """Integer position at its own level of a cell (level, hi, lo)."""
    below = F.greatest(F.col("level") - TOP, F.lit(0)).cast("int")
    return [F.call_function("shiftleft", h, below).bitwiseOR(l) for h, l in zip(K.position("hi", dim), K.position("lo", dim), strict=True)]


def _parents(cells: DataFrame, dim: int, *more: Column) -> DataFrame:
    """Parents of cells, none of which is the root."""
    fine = F.col("level") > TOP
    hi = F.when(fine, F.col("hi")).otherwise(F.shiftright("hi", dim))
    return cells.select((F.col("level") - 1).alias("level"), hi.alias("hi"), F.shiftright("lo", dim).alias("lo"), *more)


def _children(each: DataFrame, dim: int) -> DataFrame:
    """The children with the numbers ``_c``."""
    coarse, child = F.col("level") < TOP, F.col("_c")
    hi = F.when(coarse, F.shiftleft("hi", dim) + child).otherwise(F.col("hi"))
    lo = F.when(coarse, F.col("lo")).otherwise(F.shiftleft("lo", dim) + child)
    return each.select((F.col("level") + 1).alias("level"), hi.alias("hi"), lo.alias("lo"))


def _root(like: DataFrame) -> DataFrame:
    return tree.root(like).select("level", F.col("prefix").alias("hi"), _zero().alias("lo"))


def _leaves_of(kids: DataFrame, internal: DataFrame, dim: int) -> DataFrame:
    """As in ``tree``."""
    leaves = _children(tree.unsplit(kids, dim), dim)
    return leaves.unionByName(_root(kids).join(internal.filter("level = 0"), list(CELL), "left_anti"))


def _leaves_below(internal: DataFrame, dim: int, total: int = 0) -> DataFrame:
    """As ``tree.leaves_below``."""
    own = F.when(F.col("level") > TOP, F.col("lo")).otherwise(F.col("hi")).bitwiseAND(F.lit(2**dim - 1))
    above = _parents(internal.filter("level > 0"), dim, F.call_function("shiftleft", F.lit(1), own.cast("int")).alias("_kids"))
    rows = internal.select(*CELL, F.lit(0).alias("_kids")).unionByName(above)
    return _leaves_of(tree.gathered(rows, CELL, 2 * total), internal, dim)


def ancestors(cells: DataFrame, dim: int = 3) -> DataFrame:
    """Distinct strict ancestors."""
    above = _parents(cells.filter("level > 0"), dim).distinct().withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("level"))))
    fine, at = F.col("_l") > TOP, F.col("_l")
    hi = K.up("hi", F.greatest(F.least(F.col("level"), F.lit(TOP)) - at, F.lit(0)), dim)
    lo = F.when(fine, K.up("lo", F.col("level") - at, dim)).otherwise(_zero())
    return above.select(at.alias("level"), hi.alias("hi"), lo.alias("lo")).distinct()


def _rolled(points: DataFrame, depth: int, dim: int, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """(level, hi, lo, _n) of the cells of all levels that hold points and pass
    ``keep``: the levels below TOP inside each ``hi``, then those of ``hi``."""
    out, top = None, depth
    at = points.filter("hi is not null and lo is not null").groupBy("hi", "lo").agg(F.count("*").alias("_n"))
    while top > TOP:
        low = max(top - tree.STRIDE + 1, TOP + 1)
        each = at.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(top))))
        rows = tree.cut(each.groupBy("level", "hi", K.up("lo", F.lit(top) - F.col("level"), dim).alias("lo")).agg(F.sum("_n").alias("_n")))
        at = rows.filter(F.col("level") == low).select("hi", F.shiftright("lo", dim).alias("lo"), "_n")
        kept = rows.filter(keep(F.col("_n"), F.col("level")))
        out = kept if out is None else out.unionByName(kept)
        top = low - 1
    coarse = at.groupBy(F.col("hi").alias("prefix")).agg(F.sum("_n").alias("_n"))
    upper = tree._rolled(coarse, TOP, dim, keep).select("level", F.col("prefix").alias("hi"), _zero().alias("lo"), "_n")
    return upper if out is None else out.unionByName(upper)


def crowded(points: DataFrame, depth: int, most: int, dim: int = 3) -> DataFrame:
    """The cells above ``depth`` that have over ``most`` points (hi, lo)."""
    return tree.cut(_crowded(points, depth, most, dim).filter((F.col("_n") > most) & (F.col("level") < depth)).select(*CELL))


def construct(points: DataFrame, depth: int, most: int, dim: int = 3) -> DataFrame:
    """The complete octree of points (hi, lo) at ``depth``: a cell above
    ``depth`` is split iff it has over ``most`` points.  Points without a key
    are left out; no points make the root."""
    internal = crowded(points, depth, most, dim)
    return _leaves_below(internal, dim, internal.count())


def _crowded(points: DataFrame, depth: int, most: int, dim: int, leaves: bool = False) -> DataFrame:
    return runs.crowded(runs.tallied(points, "hi", "lo"), {"hi": TOP, "lo": depth - TOP}, most, dim, leaves, total=points.count())


def counted(points: DataFrame, depth: int, most: int, dim: int = 3) -> DataFrame:
    """The leaves that ``construct`` makes with ``n``, their numbers of points:
    both from one pass, where ``leaf_counts`` takes any leaves."""
    cells = tree.cut(_crowded(points, depth, most, dim, leaves=True))
    leaves = _leaves_below(cells.filter((F.col("_n") > most) & (F.col("level") < depth)).select(*CELL), dim)
    return leaves.join(cells.withColumnRenamed("_n", "n"), list(CELL), "left").select(*CELL, F.coalesce("n", _zero()).alias("n"))


def leaf_counts(points: DataFrame, leaves: DataFrame, depth: int, dim: int = 3) -> DataFrame:
    """Leaves with ``n``, the number of points in each, 0 included."""
    counts = _rolled(points, depth, dim, lambda n, _: n > 0).withColumnRenamed("_n", "n")
    return leaves.join(counts, list(CELL), "left").select(*CELL, F.coalesce("n", _zero()).alias("n"))


def linearise(cells: DataFrame, dim: int = 3) -> DataFrame:
    """Distinct cells without those that contain another."""
    cells = cells.select(*CELL).distinct()
    return cells.join(ancestors(cells, dim), list(CELL), "left_anti")


def complete(cells: DataFrame, dim: int = 3) -> DataFrame:
    """The coarsest complete octree that has the finest of ``cells``."""
    return _leaves_below(ancestors(cells, dim), dim)


def neighbours(fine: bool, dim: int = 3, corners: bool = True, itself: bool = False) -> Column:
    """Array of (hi, lo) of the cells around each of (level, hi, lo) at its
    level, inside the domain.  All cells are below TOP (``fine``) or none is.
    Levels are read from the column, so that one compiled form serves them all."""
    hi, lo, found = F.col("hi"), F.col("lo"), []
    if not fine:
        return F.transform(K.neighbours(F.col("level"), hi, dim, corners, itself), lambda p: F.struct(p.alias("hi"), _zero().alias("lo")))
    inner, outer = K._all_bits(F.col("level") - TOP, dim), (1 << dim * TOP) - 1
    for step in [*K.offsets(dim, corners), *([(0,) * dim] if itself else [])]:
        his, los, inside = [], [], F.lit(True)
        for axis, by in enumerate(step):
            mask = K.axis_mask(axis, dim)
            los.append(K._stepped(lo, mask, by).bitwiseAND(inner))
            if by:
                wraps = K._on(lo, mask) == (K._on(inner, mask) if by > 0 else 0)
                his.append(F.when(wraps, K._stepped(hi, mask & outer, by)).otherwise(K._on(hi, mask)))
                inside = inside & ~(wraps & (K._on(hi, mask) == (mask & outer if by > 0 else 0)))
            else:
                his.append(K._on(hi, mask))
        found.append(F.when(inside, F.struct(K._united(his).alias("hi"), K._united(los).alias("lo"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def balance_below(internal: DataFrame, dim: int = 3, corners: bool = True) -> DataFrame:
    """The coarsest balanced octree in which all ``internal`` are split."""
    split = tree.split_in_balanced(internal, {"hi": TOP, "lo": DEEPEST - TOP}, dim, corners)
    return _leaves_of(split, split, dim)


def balance(leaves: DataFrame, dim: int = 3, corners: bool = True) -> DataFrame:
    """The coarsest refinement of a complete octree in which neighbouring
    leaves differ by one level at most, by the steps of ``tree.balance``; a tree
    with gaps is completed."""
    leaves = leaves.select(*CELL)
    above = tree.cut(_parents(leaves.filter("level > 0"), dim).distinct())
    return leaves.distinct() if above.isEmpty() else balance_below(above, dim, corners)
