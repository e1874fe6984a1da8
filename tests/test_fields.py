"""Fields, boundary conditions, elasticity and solvers against exact values."""

import pytest
from pyspark.sql import functions as F

from leafgrid.operators import fem, fields, mesh, tree
from leafgrid.plans import multigrid

DEPTH = 3
RULE = "(nx + 2 * ny - nz) / 8"


def formula(x, y, z):
    return x + 2 * y - z


@pytest.fixture(scope="module")
def grids(spark):
    points = spark.createDataFrame([(v,) for v in (0, 1, 9, 77, 511)], "key bigint")
    fine = tree.cut(tree.balance(tree.construct(points, DEPTH, 1)))
    coarse = tree.cut(tree.balance(tree.coarsen(fine)))
    return [tree.cut(mesh.elements(t, DEPTH)) for t in (fine, coarse)]


def field(grid, expression):
    return mesh.nodes(grid, DEPTH).select(*mesh.AT, F.expr(expression).cast("double").alias("value"))


def gap(one, two):
    return fem.axpy(-1.0, one, two).agg(F.max(F.abs("value"))).first()[0]


def test_loads_errors_and_values_at_points(spark, grids):
    grid = grids[0]
    assert grid.filter("hangs").count() > 0
    line = tree.cut(field(grid, RULE))
    mass = tree.cut(fem.matrix(grid, DEPTH, 0.0, 1.0))
    assert gap(fields.load(grid, formula), fem.times(mass, line)) < 1e-12
    assert fields.l2_error(grid, line, formula) < 1e-12
    assert abs(fields.l2_error(grid, line.limit(0), lambda x, y, z: F.lit(2.0)) - 2) < 1e-12
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.3, 0.9, 0.11), (2, 0.99, 0.5, 0.5), (3, 1.0, 0.0, 0.0)], "pid int, x double, y double, z double")
    found = {r.pid: r for r in fields.at_points(points, grid, line, DEPTH).collect()}
    assert sorted(found) == [0, 1, 2]
    for r in found.values():
        assert (r.value, r.dx, r.dy, r.dz) == pytest.approx((r.x + 2 * r.y - r.z, 1, 2, -1))


def test_injection(grids):
    fine, coarse = grids
    got = mesh.inject(field(fine, RULE), mesh.nodes(coarse, DEPTH))
    assert got.count() == mesh.nodes(coarse, DEPTH).count() and gap(got, field(coarse, RULE)) < 1e-12


def test_coefficients_and_fixed_nodes(grids):
    grid = grids[0]
    leaves = grid.select("level", "prefix").distinct()
    twice = fem.matrix(grid, DEPTH, F.col("c"), 0.0, leaves.withColumn("c", F.lit(2.0)))
    once = tree.cut(fem.matrix(grid, DEPTH))
    line = tree.cut(field(grid, RULE + " * nx"))
    assert gap(fem.times(twice, line), fem.axpy(1.0, fem.times(once, line), fem.times(once, line))) < 1e-12
    nodes = tree.cut(mesh.nodes(grid, DEPTH))
    bound = tree.cut(fem.dirichlet(once, nodes.filter("boundary > 0")))
    assert fem.diagonal(bound).count() == nodes.count()
    got = fem.times(bound, line).join(nodes.filter("boundary > 0"), mesh.AT, "left_semi")
    assert gap(got, line.join(nodes.filter("boundary > 0"), mesh.AT, "left_semi")) < 1e-12


def test_elements_values_between_grids(spark, grids):
    fine, coarse = (g.select("level", "prefix").distinct() for g in grids)
    ones = fine.withColumn("value", F.lit(3.0))
    merged = fields.to_coarser(ones, tree.coarsen(fine))
    assert merged.filter("value is null or value <> 3").count() == 0
    assert fields.to_finer(merged, fine).filter("value is null or value <> 3").count() == 0
    points = spark.createDataFrame([(0, 4.0), (1, 6.0)], "key bigint, value double")
    assert fields.from_points(points, coarse, DEPTH, 1.0).filter("value > 1").agg(F.avg("value")).first()[0] == pytest.approx(5.0)


def test_elasticity(grids):
    grid = grids[0]
    stiff = tree.cut(fem.elastic_matrix(grid, DEPTH, 2.0, 3.0))
    shift = field(grid, "1").crossJoin(F.broadcast(grid.sparkSession.range(3).select(F.col("id").cast("int").alias("dof"))))
    assert fem.times(stiff, shift).agg(F.max(F.abs("value"))).first()[0] < 1e-12
    pull = tree.cut(field(grid, "nx / 8").withColumn("dof", F.lit(0)))
    both = fem.times(stiff, pull).join(pull.withColumnRenamed("value", "u"), [*mesh.AT, "dof"])
    assert both.agg(F.sum(F.col("value") * F.col("u"))).first()[0] == pytest.approx(2 + 2 + 3)
    blocks = stiff.filter("nx = mx and ny = my and nz = mz")
    back = fem.times(fem.block_inverse(stiff), fem.times(blocks, shift)).join(shift.withColumnRenamed("value", "u"), [*mesh.AT, "dof"])
    assert back.count() == shift.count()
    assert back.agg(F.max(F.abs(F.col("value") - F.col("u")))).first()[0] < 1e-9


def test_a_cycle_over_two_grids_speeds_up_the_solver(grids):
    operators = [tree.cut(fem.matrix(g, DEPTH, 1.0, 1.0)) for g in grids]
    table = tree.cut(multigrid.transfer(*grids, DEPTH))
    right = tree.cut(fields.load(grids[0], lambda x, y, z: x * y))
    cycle = multigrid.v_cycle(operators, [table], coarse_rounds=3)
    _, plain = fem.conjugate_gradients(lambda v: fem.times(operators[0], v), right, 2)
    _, with_cycle = fem.conjugate_gradients(lambda v: fem.times(operators[0], v), right, 2, condition=cycle)
    assert with_cycle < plain
