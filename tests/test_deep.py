import random

import pytest
from pyspark.sql import functions as F

from leafgrid.functions import keys as K
from leafgrid.operators import deep, runs, tree


def _points(spark, rows, depth):
    df = spark.createDataFrame(rows, "x long, y long, z long")
    hi, lo = deep.key(F.col("x"), F.col("y"), F.col("z"), depth=depth)
    return df.withColumns({"hi": hi, "lo": lo, "key": K.interleave(F.col("x"), F.col("y"), F.col("z"))})


def _cells(df, *more):
    return sorted(map(tuple, df.select("level", *(p.alias(a) for a, p in zip("xyz", deep.position(), strict=True)), *more).collect()))


def _plain(df, *more):
    return sorted(map(tuple, df.select("level", *(p.alias(a) for a, p in zip("xyz", K.position("prefix"), strict=True)), *more).collect()))


def _some(depth, n, seed=7):
    draw, side = random.Random(seed), 1 << depth
    middle = side // 2  # on both sides of a face between two cells of TOP
    return [tuple(min(side - 1, max(0, middle + draw.choice((-1, 1)) * (draw.randrange(side // 2) >> draw.randrange(depth)) - draw.randrange(2))) for _ in range(3)) for _ in range(n)]


def test_as_one_key(spark):
    depth = 18
    points = _points(spark, _some(depth, 120), depth)
    own, one = deep.construct(points, depth, 2), tree.construct(points, depth, 2)
    assert _cells(own) == _plain(one)
    assert _cells(deep.leaf_counts(points, own, depth), "n") == _plain(tree.leaf_counts(points, one, depth), "n")
    assert _cells(deep.balance(own)) == _plain(tree.balance(one))


@pytest.mark.parametrize("depth", [30, 35])
def test_full_depth(spark, depth):
    rows = _some(depth, 40)
    rows += rows[:3]
    leaves = deep.construct(_points(spark, rows, depth), depth, 1)
    cells = _cells(leaves)
    inner = set()
    for level in range(depth):
        at = [tuple(c >> depth - level for c in p) for p in rows]
        inner |= {(level, *c) for c in at if at.count(c) > 1}
    kids = {(l + 1, 2 * x + (c & 1), 2 * y + (c >> 1 & 1), 2 * z + (c >> 2)) for l, x, y, z in inner for c in range(8)}
    assert cells == sorted(kids - inner) and cells[-1][0] == depth


def test_complete_linearise_balance_at_30(spark):
    side = 1 << 30
    rows = [(side // 2 - 1, side // 2, side - 1), (0, 0, 0), (side // 2, side // 2 - 1, 5)]
    fine = _points(spark, rows, 30).select(F.lit(30).alias("level"), "hi", "lo")
    above = deep.ancestors(fine)
    assert sorted(_cells(fine)) == sorted(_cells(deep.linearise(fine.unionByName(above))))
    cells = _cells(deep.complete(fine))
    assert sum(8 ** (30 - c[0]) for c in cells) == 8**30 and {(30, *r) for r in rows} <= set(cells)
    balanced = _cells(deep.balance(deep.complete(fine.limit(1))))
    assert sum(8 ** (30 - c[0]) for c in balanced) == 8**30
    known = set(balanced)
    for level, x, y, z in balanced:
        for axis in range(3):
            for by in (-1, 1):
                at = [x, y, z]
                at[axis] += by
                for up in range(2, level + 1):
                    assert (level - up, *(c >> up for c in at)) not in known or not 0 <= at[axis] < 1 << level


def test_no_points(spark):
    none = _points(spark, [(1, 2, 3)], 30).filter("x > 5")
    assert _cells(deep.construct(none, 30, 1)) == [(0, 0, 0, 0)]
    assert _cells(deep.balance(deep.construct(none, 30, 1))) == [(0, 0, 0, 0)]


def test_chunks_share_their_cells(spark):
    """Cells that go over several chunks or tasks are counted whole; no row is
    listed once a level."""
    depth = 21
    rows = _some(depth, 150, seed=3)
    rows += rows[:9] * 4
    counts = _points(spark, rows, depth).groupBy("hi", "lo").agg(F.count("*").alias("_n"))
    inner = {}
    for level in range(depth + 1):
        for p in rows:
            at = (level, *(c >> depth - level for c in p))
            inner[at] = inner.get(at, 0) + 1
    want = sorted((*c, n) for c, n in inner.items() if n > 3 and c[0] < depth)
    for chunk in (1, 7, 1 << 18):
        cells = tree.cut(runs.crowded(counts, {"hi": deep.TOP, "lo": depth - deep.TOP}, 3, chunk=chunk))
        assert _cells(cells.filter("_n > 3"), "_n") == want
    assert cells.count() < 2 * len(want) + 3 * 3 * 2 * depth
    points = _points(spark, rows, depth)
    assert _cells(deep.counted(points, depth, 3), "n") == _cells(deep.leaf_counts(points, deep.construct(points, depth, 3), depth), "n")
