"""Whole problems against dense solutions; binary mesh lists round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators import fem, fields, mesh, tree
from leafgrid.plans import problems, whole
from leafgrid.sources import meshes

DEPTH = 3


@pytest.fixture(scope="module")
def grids(spark):
    points = spark.createDataFrame([(v,) for v in (0, 1, 9, 511)], "key bigint")
    return problems.Grids(tree.balance(tree.construct(points, DEPTH, 1)), DEPTH, levels=2, fewest=2)


def dense(operator, right, keys, held=()):
    """The exact solution, without the rows and columns of ``held`` nodes."""
    rows = [r for r in operator.collect() if (r.nx, r.ny, r.nz) not in held and (r.mx, r.my, r.mz) not in held]
    at = {k: i for i, k in enumerate(sorted({tuple(r[c] for c in keys) for r in rows}))}
    a, b = np.zeros((len(at), len(at))), np.zeros(len(at))
    for r in rows:
        a[at[tuple(r[c] for c in keys)], at[tuple(r[fem.OTHER[c]] for c in keys)]] += r.value
    for r in right.collect():
        if tuple(r[c] for c in keys) in at:
            b[at[tuple(r[c] for c in keys)]] = r.value
    return dict(zip(at, np.linalg.solve(a, b), strict=True))


def worst(found, expected, keys):
    rows = {tuple(r[c] for c in keys): r.value for r in found.collect()}
    assert set(expected) <= set(rows)
    assert all(rows[k] == 0 for k in set(rows) - set(expected))
    return max(abs(rows[k] - v) for k, v in expected.items()) / max(map(abs, expected.values()))


def test_report(grids):
    rows = grids.report().orderBy("grid").collect()
    assert [r.elements for r in rows] == [t.count() for t in grids.trees] and len(rows) == 2
    assert [r.nodes for r in rows] == [grids.nodes(k).count() for k in range(2)]


def test_natural_boundary_with_coefficients(grids):
    given = fields.centres(grids.trees[0]).select("level", "prefix", (1 + F.col("x")).alias("a"), (2 - F.col("y")).alias("b"))
    operators = grids.operators(problems.scalar(DEPTH, F.col("a"), F.col("b")), given)
    right = tree.cut(fields.load(grids.meshes[0], lambda x, y, z: x * y - z))
    found, residual = problems.solve(grids, operators, right, rounds=12)
    assert residual < 1e-6
    assert worst(found, dense(operators[0], right, mesh.AT), mesh.AT) < 1e-5


def test_fixed_boundary_and_first_guess(grids):
    operators = grids.operators(problems.scalar(DEPTH))
    right = tree.cut(fields.load(grids.meshes[0], lambda x, y, z: x + 1))
    held = {(r.nx, r.ny, r.nz) for r in grids.nodes().filter("boundary > 0").collect()}
    expected = dense(operators[0], right, mesh.AT, held)
    found, _ = problems.solve(grids, operators, right, fixed="boundary > 0", sequenced=True, rounds=12)
    assert found.count() == grids.nodes().count()
    assert worst(found, expected, mesh.AT) < 1e-5


def test_elasticity(grids):
    keys = [*mesh.AT, "dof"]
    operators = grids.operators(problems.elastic(DEPTH))
    right = tree.cut(problems.forces(grids.meshes[0], [lambda x, y, z: x, lambda x, y, z: y * 0 + 1.0, lambda x, y, z: -z]))
    held = {(r.nx, r.ny, r.nz) for r in grids.nodes().filter("nx = 0").collect()}
    expected = dense(operators[0], right, keys, held)
    found, _ = problems.solve(grids, operators, right, fixed="nx = 0", rounds=25)
    assert worst(found, expected, keys) < 1e-4


def test_mesh_lists_round_trip(grids):
    grid = grids.meshes[0]
    lists = {
        "nodes": mesh.node_numbers(grid),
        "elements": meshes.element_rows(mesh.element_numbers(grid, DEPTH), DEPTH),
        "corners": meshes.corner_rows(mesh.numbered(grid, DEPTH)),
    }
    for kind, rows in lists.items():
        back = meshes.decode(meshes.encode(rows, kind, DEPTH), kind)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select(*back.columns).collect()))
    assert meshes.decode(meshes.encode(lists["nodes"].limit(0), "nodes"), "nodes").count() == 0
    first = meshes.encode(lists["elements"].coalesce(1), "elements", DEPTH).first().content
    assert np.frombuffer(first, "<u4", 2).tolist() == [DEPTH, grids.trees[0].count()]


def test_a_tolerance_that_is_not_met_fails(grids):
    right = tree.cut(fields.load(grids.meshes[0], lambda x, y, z: x * y - z))
    with pytest.raises(ArithmeticError):
        problems.solve(grids, grids.operators(problems.scalar(DEPTH, 1.0, 1.0)), right, rounds=1, must=True)


def test_problems_solved_from_their_elements(grids):
    """Hanging vertices, factors by element, fixed nodes, displacements."""
    grid, held = grids.meshes[0], grids.nodes().filter("nx = 0").select(*mesh.AT)
    assert grid.filter("hangs").count()
    given = fields.centres(grids.trees[0]).select("level", "prefix", (1 + F.col("x")).alias("a"), (2 - F.col("y")).alias("b"))
    right = tree.cut(fields.load(grid, lambda x, y, z: x * y - z))
    expected = dense(fem.matrix(grid, DEPTH, F.col("a"), F.col("b"), given), right, mesh.AT)
    assert worst(whole.Whole(grid, F.col("a"), F.col("b"), given).solve(right), expected, mesh.AT) < 1e-8
    known = tree.cut(grids.nodes().select(*mesh.AT, F.explode(F.array(*map(F.lit, range(3)))).alias("dof")).withColumn("value", F.expr("(nx * (dof + 1) + ny * nz) / 1000D")))
    operator = tree.cut(fem.elastic_matrix(grid, DEPTH, 2.0, 3.0))
    keys = [*mesh.AT, "dof"]
    load = tree.cut(fem.elastic_product(grid, known, 2.0, 3.0))
    assert worst(load, {tuple(r[k] for k in keys): r.value for r in fem.times(operator, known).collect()}, keys) < 1e-12
    found = whole.Whole(grid, elastic=(2.0, 3.0)).solve(load, held)
    assert worst(found, dense(operator, load, keys, {tuple(r) for r in held.collect()}), keys) < 1e-8
    assert found.schema["dof"].dataType == operator.schema["dof"].dataType
    with pytest.raises(ArithmeticError):
        whole.Whole(grid, elastic=(2.0, 3.0)).solve(load, held, rounds=2)
