"""Trees against brute force; meshes and operators against invariants."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.functions import keys as K
from leafgrid.operators import fem, mesh, search, tree
from leafgrid.plans import multigrid
from leafgrid.sources import points as files

DEPTH = 4


def cells(df):
    return sorted((r.level, r.prefix) for r in df.select("level", "prefix").collect())


def keyed(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key bigint")


def split(values, most, dim, level=0, prefix=0):
    inside = [v for v in values if v >> dim * (DEPTH - level) == prefix]
    if len(inside) <= most or level == DEPTH:
        return [(level, prefix)]
    return [leaf for c in range(1 << dim) for leaf in split(inside, most, dim, level + 1, (prefix << dim) + c)]


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_construct_balance_and_coarsen(spark, dim):
    rng = random.Random(dim)
    values = [min(rng.randrange(1 << dim * DEPTH) for _ in range(4)) for _ in range(60)]
    leaves = tree.cut(tree.construct(keyed(spark, values), DEPTH, 2, dim))
    assert cells(leaves) == sorted(split(values, 2, dim))
    assert tree.volume(leaves, DEPTH, dim).first().volume == 1 << dim * DEPTH
    even = tree.cut(tree.balance(leaves, dim))
    assert tree.volume(even, DEPTH, dim).first().volume == 1 << dim * DEPTH
    assert tree.unbalanced(even, dim).count() == 0
    assert tree.linearise(leaves.unionByName(even), dim).exceptAll(even).count() == 0  # a refinement
    full = set(cells(even))
    want = {c for c in full if c[0] == 0 or any((c[0], c[1] >> dim << dim | k) not in full for k in range(1 << dim))}
    want |= {(l - 1, p >> dim) for l, p in full - want}
    assert cells(tree.coarsen(even, dim)) == sorted(want)
    assert tree.leaf_counts(keyed(spark, values), leaves, DEPTH, dim).agg(F.sum("n")).first()[0] == len(values)


def test_trees_of_nothing_and_of_everything(spark):
    none = tree.construct(keyed(spark, []), DEPTH, 1)
    assert cells(none) == [(0, 0)] == cells(tree.complete(none.limit(0))) == cells(tree.balance(none))
    assert cells(tree.construct(keyed(spark, [3] * 9), 1, 1)) == [(1, p) for p in range(8)]
    mixed = spark.createDataFrame([(0, 0), (2, 5), (2, 5), (1, 0), (1, 3)], "level int, prefix bigint")
    assert cells(tree.linearise(mixed)) == [(1, 3), (2, 5)]
    assert cells(tree.complete(mixed)) == [(1, p) for p in range(1, 8)] + [(2, p) for p in range(8)]
    assert cells(tree.refine(mixed.filter("level = 2"), 2)) == [(2, 5), (2, 5)]
    grid = tree.regular(spark, 2).withColumn("value", F.when(F.col("prefix") < 8, F.col("prefix")).otherwise(1))
    assert cells(tree.from_grid(grid, 2, 0.5)) == [(1, p) for p in range(1, 8)] + [(2, p) for p in range(8)]


def test_searches_and_numbers(spark):
    rng = random.Random(1)
    listed, asked = (sorted({rng.randrange(4096) for _ in range(150)}) for _ in range(2))
    low = F.shiftright("key", 6)
    got = search.as_of(keyed(spark, asked), keyed(spark, listed), "key", low).collect()
    assert {r.key: r.found for r in got} == {a: max((x for x in listed if x <= a), default=None) for a in asked}
    got = search.numbered(keyed(spark, asked), ["key"], low).collect()
    assert {r.key: r.id for r in got} == {a: k for k, a in enumerate(asked)}
    got = search.weighted_parts(keyed(spark, asked), ["key"], F.lit(1), 4, low).groupBy("part").count().collect()
    assert max(r["count"] for r in got) - min(r["count"] for r in got) <= 1


@pytest.fixture(scope="module")
def grids(spark):
    """An adaptive balanced mesh and the next coarser one."""
    values = [0, 1, 2, 3, 9, 77, 511, 512, 4095, 300, 301, 302]
    fine = tree.cut(tree.balance(tree.construct(keyed(spark, values), DEPTH, 1)))
    low = tree.balance(tree.coarsen(fine))
    return [tree.cut(mesh.elements(t, DEPTH)) for t in (fine, tree.cut(low))]


def field(nodes, expression):
    return nodes.select(*mesh.AT, F.expr(expression).cast("double").alias("value"))


def test_operators_on_a_mesh_with_hanging_vertices(grids):
    fine = grids[0]
    assert fine.filter("hangs").count() > 0
    nodes = mesh.nodes(fine, DEPTH)
    flat = field(nodes, "1")
    stiff = tree.cut(fem.matrix(fine, DEPTH, 1.0, 0.0))
    mass = tree.cut(fem.matrix(fine, DEPTH, 0.0, 1.0))
    assert fem.times(stiff, flat).agg(F.max(F.abs("value"))).first()[0] < 1e-12
    assert abs(fem.dot(flat, fem.times(mass, flat)) - 1) < 1e-12
    line = field(nodes, f"(nx + 2 * ny - nz) / {2**DEPTH}")
    assert abs(fem.dot(line, fem.times(stiff, line)) - 6) < 1e-9  # |gradient|^2 over the unit cube
    other = stiff.selectExpr("mx as nx", "my as ny", "mz as nz", "nx as mx", "ny as my", "nz as mz", "-value as value")
    gap = stiff.unionByName(other).groupBy(*mesh.AT, "mx", "my", "mz").agg(F.sum("value").alias("v"))
    assert gap.agg(F.max(F.abs("v"))).first()[0] < 1e-12  # symmetric


def test_transfers_reproduce_linear_fields(grids):
    fine, coarse = grids
    table = tree.cut(multigrid.transfer(fine, coarse, DEPTH))
    rule = "nx + 2 * ny - 3 * nz"
    got = multigrid.prolong(table, field(mesh.nodes(coarse, DEPTH), rule)).collect()
    assert len(got) == mesh.nodes(fine, DEPTH).count()
    assert np.allclose([r.value for r in got], [r.nx + 2 * r.ny - 3 * r.nz for r in got])
    x, y = field(mesh.nodes(fine, DEPTH), "nx * ny + 1"), field(mesh.nodes(coarse, DEPTH), "nz - nx")
    assert abs(fem.dot(multigrid.restrict(table, x), y) - fem.dot(x, multigrid.prolong(table, y))) < 1e-6


def test_files_are_read_back(spark, tmp_path):
    rows = [(0.1, 0.2, 0.3, 5.0), (0.9, 0.5, 0.25, -1.0)]
    points = spark.createDataFrame(rows, "x double, y double, z double, w double").coalesce(1)
    for value in (None, "w"):
        for r in files.pts_bytes(points, value).collect():
            Path(tmp_path / f"a{value}.pts").write_bytes(r.content)
        back = files.read_pts(spark, str(tmp_path / f"a{value}.pts"), value is not None).drop("path").collect()
        assert sorted(map(tuple, back)) == sorted(r if value else r[:3] for r in rows)
    Path(tmp_path / "none.pts").write_bytes(b"")
    assert files.read_pts(spark, str(tmp_path / "none.pts")).count() == 0
    leaves = tree.construct(keyed(spark, [1, 2, 3, 9]), DEPTH, 1)
    lines = files.octree_lines(leaves, DEPTH).orderBy("ordinal").collect()
    Path(tmp_path / "t.ot").write_text("\n".join(r.value for r in lines) + "\n")
    back, depth = files.read_octree(spark, str(tmp_path / "t.ot"))
    assert depth == DEPTH and cells(back) == cells(leaves)
    assert files.gaussian(spark, 50, 1, log=True).filter("x < 0 or x >= 1").count() == 0


def test_keys_quantise(spark):
    got = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (0.999,)], "v double").select(K.quantise(F.col("v"), 3, 1.0).alias("q")).collect()
    assert [r.q for r in got] == [0, 3, 4, 7]
