"""Embedded trees and the order by density against brute force."""

from itertools import product

import pytest

from leafgrid.functions import keys as K
from leafgrid.operators import tree


def test_embedded_cells_give_every_vertex(spark):
    leaves = tree.regular(spark, 1, 2)
    rows = tree.embedded(leaves, 2)
    x, y = K.position("prefix", 2)
    got = sorted((r.x, r.y, r.level) for r in rows.select(x.alias("x"), y.alias("y"), "level").collect())
    assert got == [(a, b, 2) for a, b in product(range(3), repeat=2)]
    assert rows.filter("beyond = 0").count() == 4
    assert tree.embedded(leaves.limit(0), 2).count() == 0


@pytest.mark.parametrize("few", [0, 1, 40])
def test_order_by_density(spark, few):
    rows = [(k % 3, k * 37 % 1500, [0, 1, 5, 5][k % 4]) for k in range(few)]
    cells = spark.createDataFrame(sorted(set(rows)), "level int, prefix bigint, weight bigint")
    got = [(r.level, r.prefix, r.weight) for r in tree.by_density(cells).orderBy("place").collect()]
    assert got == sorted(set(rows), key=lambda r: (-r[2], -r[0] if r[2] > 1 else r[0], r[1]))
    assert sorted(r.place for r in tree.by_density(cells).collect()) == list(range(1, len(got) + 1))
