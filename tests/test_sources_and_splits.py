"""Generated clouds, VTK lines, splits, numbered meshes and block boundaries."""

from pyspark.sql import functions as F

from leafgrid.functions import keys as K
from leafgrid.operators import mesh, search, tree
from leafgrid.sources import points as files


def test_generated_clouds_stay_inside(spark):
    ball = files.sphere(spark, 200, 1)
    off = F.abs(F.sqrt(sum(((F.col(a) - 0.5) ** 2 for a in K.AXES), F.lit(0.0))) - 0.4)
    assert ball.filter(off > 1e-9).count() == 0
    clouds = [ball, files.corners(spark, 200, 2), files.doubled(ball), files.peaks(spark, 12)]
    assert [c.select("pid").distinct().count() for c in clouds] == [200, 200, 400, 144]
    for cloud in clouds:
        assert cloud.filter(" or ".join(f"{a} < 0 or {a} >= 1 or {a} is null" for a in K.AXES)).count() == 0


def test_vtk_lines(spark):
    points = spark.createDataFrame([(1, 0.5, 0.25, 0.0), (0, 1.0, 2.0, 3.0)], "pid long, x double, y double, z double")
    got = [r.value for r in files.vtk_point_lines(points).orderBy("ordinal").collect()]
    assert got[3:] == ["DATASET POLYDATA", "POINTS 2 double", "1.0 2.0 3.0", "0.5 0.25 0.0"]
    grid = spark.range(8).select(F.col("id").alias("prefix"), F.col("id").cast("double").alias("value"))
    got = [r.value for r in files.vtk_grid_lines(grid, 1).orderBy("ordinal").collect()]
    assert got[4:6] == ["DIMENSIONS 2 2 2", "ORIGIN 0 0 0"] and got[-8:] == [f"{k}.0" for k in range(8)]
    assert files.vtk_point_lines(points.limit(0)).count() == 5


def test_splits_and_numbers(spark):
    rows = spark.range(11).select((F.col("id") * 7).alias("key"))
    got = {r.key // 7: r.part for r in search.split(rows, ["key"], 3, F.shiftright("key", 4)).collect()}
    assert got == {k: min(k // 3, 2) for k in range(11)}
    assert search.split(rows.limit(0), ["key"], 3, F.shiftright("key", 4)).count() == 0
    grid = tree.cut(mesh.elements(tree.regular(spark, 1), 1))
    got = mesh.numbered(grid, 1).collect()
    assert sorted({r.element for r in got}) == list(range(8)) and sorted({r.node for r in got}) == list(range(27))


def test_block_boundary_and_difference(spark):
    cells = tree.regular(spark, 3)
    assert cells.count() - tree.block_boundary(cells, 1).count() == 8 * 2**3
    assert cells.count() - tree.block_boundary(cells, 0).count() == 6**3
    assert tree.difference(cells, cells).count() == 0
    assert {r.side for r in tree.difference(cells, tree.regular(spark, 2)).collect()} == {1, 2}


def test_trees_of_full_depth_are_written_and_read(spark, tmp_path):
    last = (1 << 3 * 20) - 1
    cells = [(20, last), (20, 0), (1, 3), (20, last - 9)]
    table = spark.createDataFrame(cells, "level int, prefix bigint")
    at = str(tmp_path / "tree")
    files.write_lines(files.octree_lines(table, 20), at, ["ordinal", "level"])
    rows, depth = files.read_octree(spark, at)
    assert depth == 20 and sorted(map(tuple, rows.collect())) == sorted(cells)


def test_the_header_is_found_in_the_first_of_several_files(spark, tmp_path):
    """Spark lists the largest file first, whatever its name."""
    at = tmp_path / "tree"
    at.mkdir()
    cells = [(6, k) for k in range(40, 90)]
    lines = [r.value for r in files.octree_lines(spark.createDataFrame(cells, "level int, prefix bigint"), 6).orderBy("ordinal", "level").collect()]
    for k, part in enumerate(([], lines[:4], lines[4:])):
        (at / f"part-0000{k}.txt").write_text("".join(f"{line}\n" for line in part))
    rows, depth = files.read_octree(spark, str(at))
    assert depth == 6 and sorted(map(tuple, rows.collect())) == cells
