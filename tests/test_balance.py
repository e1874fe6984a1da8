"""Balance in passes over chunks, against brute force on positions."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from leafgrid.functions import keys as K
from leafgrid.operators import deep, runs, tree


def key(at, level):
    return sum((c >> b & 1) << len(at) * b + a for a, c in enumerate(at) for b in range(level))


def split_around(cells, dim, corners):
    """From the finest level up: a split cell's neighbours exist, so their parents are split."""
    most = dim if corners or dim == 1 else dim - 1
    steps = [s for s in product((-1, 0, 1), repeat=dim) if sum(map(abs, s)) <= most]
    out = set(cells)
    for level in range(max(c[0] for c in cells), 0, -1):
        for l, *at in [c for c in out if c[0] == level]:
            around = ([c + d for c, d in zip(at, s, strict=True)] for s in steps)
            out |= {(level - 1, *(c >> 1 for c in n)) for n in around if min(n) >= 0 and max(n) < 1 << level}
    return out


def some(dim, depth, n, seed):
    """Cells of all levels, close to the domain's ends and its middle."""
    rng = random.Random(seed)
    for _ in range(n):
        level = rng.randrange(depth + 1)
        ends = (0, (1 << level) - 1, 1 << level >> 1, max(0, (1 << level >> 1) - 1))
        yield (level, *(min((1 << level) - 1, max(0, rng.choice(ends) + rng.randrange(-2, 3))) for _ in range(dim)))


def with_kids(split):
    kids = dict.fromkeys(split, 0)
    for level, *at in split:
        if level:
            kids[(level - 1, *(c >> 1 for c in at))] |= 1 << sum((c & 1) << a for a, c in enumerate(at))
    return kids


@pytest.mark.parametrize("dim,corners", [(1, True), (2, True), (2, False), (3, True), (3, False)])
def test_any_chunks_make_the_same_tree(spark, dim, corners):
    cells = set(some(dim, 20, 25, seed=dim))
    want = with_kids(split_around(cells, dim, corners))
    table = spark.createDataFrame([(c[0], key(c[1:], c[0])) for c in cells], "level int, prefix bigint")
    table = table.unionByName(table.limit(7))
    for chunk in (1, 4, 1 << 16):
        made = runs.balanced(table, {"prefix": 20}, dim, corners, chunk=chunk)
        got = {(r.level, r.prefix): r._kids for r in tree.gathered(made, tree.OCTANT).collect()}
        assert got == {(c[0], key(c[1:], c[0])): bits for c, bits in want.items()}
    assert made.count() < 4 * len(want)  # cells of one chunk are listed once


@pytest.mark.parametrize("depth", [30, 35])
def test_deep_cells_in_any_chunks(spark, depth):
    cells = set(some(3, depth, 12, seed=depth))
    want = with_kids(split_around(cells, 3, True))

    def two(level, *at):
        low = max(level - deep.TOP, 0)
        return level, key([c >> low for c in at], level - low), key([c & (1 << low) - 1 for c in at], low)

    table = spark.createDataFrame([two(*c) for c in cells], "level int, hi bigint, lo bigint")
    for chunk in (3, 1 << 16):
        made = runs.balanced(table, {"hi": deep.TOP, "lo": deep.DEEPEST - deep.TOP}, chunk=chunk)
        got = {(r.level, r.hi, r.lo): r._kids for r in tree.gathered(made, deep.CELL).collect()}
        assert got == {two(*c): bits for c, bits in want.items()}


def test_jobs_do_not_grow_with_levels(spark):
    """Balance took several jobs a level."""
    context = spark.sparkContext
    rows = spark.createDataFrame([(30, 5, 7), (29, 0, 1)], "level int, hi bigint, lo bigint")
    context.setJobGroup("balance of 30 levels", "")
    try:
        deep.balance(deep.complete(rows)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("balance of 30 levels")) < 30


def test_tasks_grow_with_rows(spark, monkeypatch):
    """A task had its share of the rows for a fixed number of tasks, and one of
    a table's file all distinct keys of it."""
    points = spark.range(0, 4000, 1, 2).select((F.col("id") * 37 % 4096).alias("key"))
    want = sorted(map(tuple, tree.construct(points, 4, 3).collect()))
    assert "HashAggregate" not in runs.tallied(points, "key")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(runs, "ROWS", 100)
    ordered = runs.in_order(points, "key", total=4000)
    assert ordered.rdd.getNumPartitions() == 40
    kids = tree.gathered(points.select(F.col("key").alias("prefix"), (F.col("key") % 5).cast("int").alias("level"), F.lit(0).alias("_kids")), tree.OCTANT, 4000)
    assert kids.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, tree.construct(points, 4, 3).collect())) == want


def test_points_without_keys_and_many_of_one(spark):
    rows = [(None,)] * 30 + [(5,)] * 70 + [(6,)]
    points = spark.createDataFrame(rows, "key bigint")
    assert runs.tallied(points, "key", chunk=40).groupBy("key").agg(F.sum("_n")).orderBy("key").collect() == [(5, 70), (6, 1)]
    assert tree.leaf_counts(points, tree.construct(points, 2, 3), 2).agg(F.sum("n")).first()[0] == 71
    assert tree.construct(points.filter("key is null"), 2, 3).collect() == [(0, 0)]


def test_difference_counts_copies_in_one_sum(spark):
    one = spark.createDataFrame([(1, 1)] * 3 + [(1, 2), (2, 9)], tree_schema := "level int, prefix bigint")
    two = spark.createDataFrame([(1, 1)] + [(1, 2)] * 2 + [(2, 9), (3, 0)], tree_schema)
    found = tree.difference(one, two)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1), (1, 1, 1), (1, 2, 2), (3, 0, 2)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") <= 2
    assert tree.difference(one, one).isEmpty()
