"""Key functions against plain arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from leafgrid.functions import keys as K


def spread(x, dim):
    return sum((x >> b & 1) << dim * b for b in range(22))


def key(position):
    return sum(spread(p, len(position)) << a for a, p in enumerate(position))


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_positions_and_keys(spark, dim):
    rng = random.Random(dim)
    rows = [tuple(rng.randrange(1 << 20) for _ in range(dim)) for _ in range(200)] + [(0,) * dim, ((1 << 20) - 1,) * dim]
    df = spark.createDataFrame(rows, ", ".join(f"{a} bigint" for a in K.AXES[:dim]))
    made = df.withColumn("k", K.interleave(*(F.col(a) for a in K.AXES[:dim])))
    got = made.select("*", *(p.alias(f"d{i}") for i, p in enumerate(K.position("k", dim)))).collect()
    for r in got:
        assert r.k == key(r[:dim]) and r[dim + 1 :] == r[:dim]


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_neighbours_flags_and_search_keys(spark, dim):
    cells = [(level, p) for level in (0, 1, 3) for p in range(min(1 << dim * level, 512))]
    df = spark.createDataFrame(cells, "level int, prefix bigint")
    level, prefix = F.col("level"), F.col("prefix")
    got = df.select("*", K.neighbours(level, prefix, dim).alias("n"), K.boundary_flags(level, prefix, dim).alias("f"), K.search_keys(level, prefix, 5, dim).alias("s")).collect()

    def at(p):
        return [sum((p >> dim * b + a & 1) << b for b in range(10)) for a in range(dim)]

    for r in got:
        here, end = at(r.prefix), 1 << r.level
        around = [[h + d for h, d in zip(here, o, strict=True)] for o in K.offsets(dim)]
        assert sorted(r.n) == sorted(key(a) for a in around if min(a) >= 0 and max(a) < end)
        assert r.f == sum((1 << a) * (h == 0) + (32 << a) * (h == end - 1) for a, h in enumerate(here))
        size, want = 1 << 5 - r.level, []
        for step in range(1, 1 << dim):
            spot = []
            for a, h in enumerate(here):
                inner, outer = ((h + 1) * size - 1, (h + 1) * size) if h & 1 else (h * size, h * size - 1)
                spot.append(outer if step >> a & 1 else inner)
            if min(spot) >= 0 and max(spot) < 32:
                want.append(key(spot))
        assert sorted(r.s) == sorted(want)


@pytest.mark.parametrize("dim", [2, 3])
def test_hilbert_visits_neighbours_in_turn(spark, dim):
    n = 1 << 3
    df = spark.range(n**dim).select(*(F.expr(f"(id div {n**a}) % {n}").alias(K.AXES[a]) for a in range(dim)))
    got = df.withColumn("h", K.hilbert(*(F.col(K.AXES[a]) for a in range(dim)), depth=3)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(n**dim))
    for one, two in zip(got, got[1:], strict=False):
        assert sum(abs(a - b) for a, b in zip(one[:dim], two[:dim], strict=True)) == 1


def test_relations_between_cells(spark):
    rng = random.Random(5)
    cells = [(l, rng.randrange(8**l), m, rng.randrange(8**m)) for l, m in ((rng.randrange(5), rng.randrange(5)) for _ in range(300))]
    df = spark.createDataFrame(cells, "l int, p bigint, m int, q bigint")
    l, p, m, q = (F.col(c) for c in "lpmq")
    level, prefix = K.common_ancestor(l, p, m, q)
    after = K.next_cell(l, p)
    got = df.select("*", K.is_ancestor(l, p, m, q).alias("anc"), level.alias("cl"), prefix.alias("cp"), after[0].alias("nl"), after[1].alias("np"), K.children(p).alias("kids"), K.siblings(p).alias("sib")).collect()
    for r in got:
        assert r.anc == (r.l < r.m and r.q >> 3 * (r.m - r.l) == r.p)
        common = max(k for k in range(min(r.l, r.m) + 1) if r.p >> 3 * (r.l - k) == r.q >> 3 * (r.m - k))
        assert (r.cl, r.cp) == (common, r.p >> 3 * (r.l - common))
        coarsest = min(k for k in range(r.l + 1) if (r.p + 1) % 8 ** (r.l - k) == 0)
        assert (r.nl, r.np) == (coarsest, (r.p + 1) >> 3 * (r.l - coarsest))
        assert r.kids == [8 * r.p + c for c in range(8)] and len(r.sib) == 7 and r.p not in r.sib


@pytest.mark.parametrize(("dim", "corners"), [(1, True), (2, True), (2, False), (3, True), (3, False)])
def test_parents_around(spark, dim, corners):
    level, cells = F.col("level"), spark.range(2 ** (dim * 2)).withColumn("level", F.lit(2))
    around = F.transform(K.neighbours(level, F.col("id"), dim, corners, itself=True), lambda p: F.shiftright(p, dim))
    got = cells.select(F.array_sort(K.parents_around(level, F.col("id"), dim, corners)).alias("a"), F.array_sort(F.array_distinct(around)).alias("b"))
    assert got.filter("a = b").count() == 2 ** (dim * 2)
