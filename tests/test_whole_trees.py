"""Queries over every order line against brute force on a small table."""

import random

import pytest

from leafgrid import catalog
from leafgrid.operators import fem, mesh, runs, tree

DEPTH, MOST = catalog.FINE_DEPTH, catalog.MOST


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    near = [(509 + rng.randrange(3), rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    rows = [(a, b, c, k, "O", float(k % 50)) for k, (a, b, c) in enumerate([*near, *((rng.randrange(1 << 12), rng.randrange(2000), rng.randrange(2000)) for _ in range(60))])]
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_linestatus string, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    side = 1 << DEPTH
    return at, [(a % side, (b % side) ** 2 // side, side // 2 - 1 - (c % side) ** 2 // (2 * side)) for a, b, c, *_ in rows]


def key(x, y, z, bits=DEPTH):
    return sum((((x >> b) & 1) | ((y >> b) & 1) << 1 | ((z >> b) & 1) << 2) << 3 * b for b in range(bits))


def position(prefix):
    return tuple(sum(((prefix >> 3 * b + a) & 1) << b for b in range(DEPTH)) for a in range(3))


def split(keys, level=0, prefix=0):
    if len(keys) <= MOST or level == DEPTH:
        return {(level, prefix)}
    return set().union(*(split([k for k in keys if k >> 3 * (DEPTH - level - 1) == prefix * 8 + c], level + 1, prefix * 8 + c) for c in range(8)))


def around(level, prefix, corners=True):
    at = position(prefix)
    for d in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)):
        to = [p + s for p, s in zip(at, d, strict=True)]
        if any(d) and (corners or 0 in d) and min(to) >= 0 and max(to) < 1 << level:
            yield key(*to)


def too_coarse(leaves, level, prefix, corners=True):
    """Leaves next to a cell that are two or more levels coarser."""
    return {(l, n >> 3 * (level - l)) for n in around(level, prefix, corners) for l in range(level - 1) if (l, n >> 3 * (level - l)) in leaves}


def balanced(leaves, corners=True):
    """Splits coarse neighbours one by one until none is left."""
    leaves = set(leaves)
    while wrong := set().union(*(too_coarse(leaves, *c, corners) for c in leaves)):
        leaves = (leaves - wrong) | {(l + 1, p * 8 + c) for l, p in wrong for c in range(8)}
    return leaves


def rows(spark, name, at):
    return sorted(map(tuple, catalog.QUERIES[name](spark, at).collect()))


def test_whole_trees_hold_every_order_line(spark, folder):
    at, points = folder
    keys = [key(*p) for p in points]
    leaves = split(keys)
    even = balanced(leaves)
    assert len(even) > len(leaves)
    assert rows(spark, "balance_octree", at) == sorted(even)
    assert rows(spark, "balance_violations", at) == [(0,)]
    assert rows(spark, "balance_without_corners", at) == sorted(balanced(leaves, False))
    assert rows(spark, "unbalanced_leaves", at) == sorted(c for c in leaves if too_coarse(leaves, *c))
    assert rows(spark, "tree_difference", at) == sorted([(*c, 1) for c in even - leaves] + [(*c, 2) for c in leaves - even])


def test_whole_cells_are_those_of_every_order_line(spark, folder):
    at, points = folder
    keys = {key(*p) for p in points}
    inner = {(l, k >> 3 * (DEPTH - l)) for k in keys for l in range(DEPTH)}
    assert rows(spark, "linearise", at) == sorted((DEPTH, k) for k in keys)
    assert rows(spark, "complete_octree", at) == sorted({(l + 1, p * 8 + c) for l, p in inner for c in range(8)} - inner)


def test_meshes_of_whole_trees_keep_their_hanging_vertices(spark, folder):
    at, points = folder
    even = balanced(split([key(*p) for p in points]))
    own = set()
    for l, p in even:
        size = 2 << DEPTH - l
        for v in range(8):
            c = [a + (v >> k & 1) << DEPTH - l for k, a in enumerate(position(p))]
            sides = [[(n - s) // size for s in (0, 1) if 0 <= n - s < 1 << DEPTH] for n in c]
            if l and any(n % size for n in c) and any((l - 1, key(x, y, z)) in even for x in sides[0] for y in sides[1] for z in sides[2]):
                own.add((l, p, v))
    cells = tree.cut(tree.balance(catalog.fine_leaves(spark, at)))
    assert own and sorted(map(tuple, mesh.hanging(cells, DEPTH).collect())) == sorted(own)
    grid = tree.cut(mesh.elements(cells, DEPTH))
    elements = grid.collect()
    assert len(elements) == 8 * len(even)
    assert {(r.level, r.prefix, r.vertex) for r in elements if r.hangs} == own
    # a linear field's stiffness sums to 0, its mass to its integral
    nodal = catalog._linear(mesh.nodes(grid, DEPTH))
    got = fem.product(grid, nodal, 1.0, 1.0).collect()
    assert sum(r.value for r in got) == pytest.approx(3 * (1 << DEPTH))
    assembled = {tuple(r)[:3]: r.value for r in fem.times(fem.matrix(grid, DEPTH, 1.0, 1.0), nodal).collect()}
    assert {tuple(r)[:3]: pytest.approx(r.value, abs=1e-9) for r in got} == assembled


@pytest.mark.parametrize("dim", [1, 3])
def test_nested_cells_over_several_chunks(spark, dim, monkeypatch):
    """Ancestors are listed once a chunk, not once a cell; a cell whose parts
    begin in the next chunk is dropped."""
    rng = random.Random(dim)
    cells = {(l, rng.randrange(1 << min(dim * l, 6))) for l in range(8) for _ in range(12)} | {(20, (1 << 20 * dim) - 1)}
    above = {(u, p >> dim * (l - u)) for l, p in cells for u in range(l)}
    for chunk in (1, 5, 1 << 18):
        for name in ("ancestors", "finest"):
            monkeypatch.setattr(runs, name, lambda *a, f=getattr(runs, name): f(*a[:3], chunk))
        table = spark.createDataFrame([*cells, *cells], "level int, prefix bigint")
        assert sorted(map(tuple, tree.ancestors(table, dim).collect())) == sorted(above)
        assert sorted(map(tuple, tree.linearise(table, dim).collect())) == sorted(cells - above)
        monkeypatch.undo()
    assert runs.ancestors(table, dim, 20).count() < len(above) + 3 * 20


def test_gaps_are_no_coarse_leaves(spark):
    """Only leaves two levels coarser count, wherever they lie around."""
    leaves = {(1, 0), (3, 0o100), (3, 0o444), (6, 0o111111), (2, 0o77)}
    table = spark.createDataFrame(sorted(leaves), "level int, prefix bigint")
    for corners in (True, False):
        want = sorted(c for c in leaves if too_coarse(leaves, *c, corners))
        assert sorted(map(tuple, tree.unbalanced(table, corners=corners).collect())) == want
