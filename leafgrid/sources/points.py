"""Point and octree files, read and written by Spark's own readers.

``.pts``: uint32 number of points, then x, y, z of each as float64, then with
values one float64 for each point; an empty file has no points.  ``.ot``: text,
a line "dim depth", a line with the number of octants, a line "x y z level"
for each, positions in cells of full depth.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import search


def read_pts(spark: SparkSession, path: str, values: bool = False) -> DataFrame:
    """(path, x, y, z[, value]) of all ``.pts`` files; a file is one task's."""
    return decode_pts(spark.read.format("binaryFile").load(path), values)


def decode_pts(files: DataFrame, values: bool = False) -> DataFrame:
    """The points of files (path, content); one without content has none."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                n = int(np.frombuffer(content, "<u4", 1)[0]) if len(content) else 0
                data = np.frombuffer(content, "<f8", n * (4 if values else 3), offset=4) if n else np.zeros(0)
                at = data[: 3 * n].reshape(n, 3)
                out = {"path": name, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}
                yield pd.DataFrame(out | ({"value": data[3 * n :]} if values else {}), index=range(n))

    return files.select("path", "content").mapInPandas(decode, "path string, x double, y double, z double" + (", value double" if values else ""))


def pts_bytes(points: DataFrame, value: str | None = None) -> DataFrame:
    """(part, content): the content of one ``.pts`` file for each partition."""
    columns = ["x", "y", "z"] + ([value] if value else [])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        data = [f[columns].to_numpy("<f8") for f in frames]
        rows = np.concatenate(data) if data else np.zeros((0, len(columns)))
        content = b""
        if len(rows):
            content = np.array([len(rows)], "<u4").tobytes() + rows[:, :3].tobytes() + (rows[:, 3].tobytes() if value else b"")
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [content]})

    return points.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInPandas(encode, "part int, content binary")


def read_octree(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(level, prefix) of an ``.ot`` file and its depth, from its first line."""
    # Spark reads the largest file first, so the header is looked up by name:
    # a line's number grows inside a file's first block
    lines = spark.read.text(path).filter("_metadata.file_block_start = 0").select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    dim, depth = map(int, lines.agg(F.min_by("value", F.struct("_f", "_i"))).first()[0].split())
    part = F.split(F.trim("value"), r"\s+")
    cells = spark.read.text(path).select(part.alias("p")).filter(F.size("p") == dim + 1)
    at = [F.col("p")[a].cast("long") for a in range(dim)]
    level = F.col("p")[dim].cast("int")
    rows = cells.select(level.alias("level"), K.up(K.interleave(*at), F.lit(depth) - level, dim).alias("prefix"))
    return rows, depth


def octree_lines(cells: DataFrame, depth: int, dim: int = 3) -> DataFrame:
    """(ordinal, level, value): the lines of an ``.ot`` file, in curve order by
    ``ordinal`` and ``level``; the header has the ordinals -2 and -1."""
    key = K.first_key(F.col("level"), F.col("prefix"), depth, dim)
    body = cells.select(key.alias("ordinal"), F.col("level").cast("int").alias("level"), F.concat_ws(" ", *(p for p in K.position(key, dim)), F.col("level")).alias("value"))
    head = cells.agg(F.array(F.lit(f"{dim} {depth}"), F.count("*").cast("string")).alias("h")).select(F.posexplode("h").alias("i", "value")).select((F.col("i") - 2).cast("long").alias("ordinal"), F.lit(0).alias("level"), "value")
    return head.unionByName(body)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leafgrid-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Writes the column ``value`` as text files, by the executors: the lines
    in ``order`` when the files are read by name."""
    lines.orderBy(*order).select("value").write.text(path)


def vtk_octree_lines(cells: DataFrame, depth: int, bits: int = 9) -> DataFrame:
    """(section, ordinal, value): the lines of a VTK file of the cells (level,
    prefix, owner) as voxels with their owner, in the order of the first two:
    head, points in units of full depth, cells, their types, their owners."""
    named = search.numbered(cells.select("level", "prefix", "owner", K.first_key(F.col("level"), F.col("prefix"), depth).alias("key")), ["key"], F.shiftright("key", bits))
    each = named.select("id", "owner", "level", *(p.alias(a) for a, p in zip(K.AXES, K.position("prefix"), strict=True)))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("level")).cast("int"))
    corner = each.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    at = [((F.col(a) + F.shiftright("c", k).bitwiseAND(F.lit(1))) * step).cast("string") for k, a in enumerate(K.AXES)]
    body = [
        corner.select(F.lit(1).alias("section"), (F.col("id") * 8 + F.col("c")).alias("ordinal"), F.concat_ws(" ", *at).alias("value")),
        named.select(F.lit(2).alias("section"), F.col("id").alias("ordinal"), F.concat_ws(" ", F.lit("8"), *((F.col("id") * 8 + k).cast("string") for k in range(8))).alias("value")),
        named.select(F.lit(3).alias("section"), F.col("id").alias("ordinal"), F.lit("11").alias("value")),
        named.select(F.lit(4).alias("section"), F.col("id").alias("ordinal"), F.col("owner").cast("string").alias("value")),
    ]
    n = F.count("*")
    head = [(0, k, F.lit(v)) for k, v in enumerate(("# vtk DataFile Version 2.0", "octree", "ASCII", "DATASET UNSTRUCTURED_GRID"))]
    head += [(1, -1, F.concat(F.lit("POINTS "), n * 8, F.lit(" int"))), (2, -1, F.concat(F.lit("CELLS "), n, F.lit(" "), n * 9)), (3, -1, F.concat(F.lit("CELL_TYPES "), n)), (4, -3, F.concat(F.lit("CELL_DATA "), n))]
    head += [(4, -2, F.lit("SCALARS owner int")), (4, -1, F.lit("LOOKUP_TABLE default"))]
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(o).cast("long").alias("ordinal"), v.alias("value")) for s, o, v in head))
    out = cells.agg(rows.alias("h")).select(F.explode("h").alias("r")).select("r.*")
    for part in body:
        out = out.unionByName(part)
    return out


def vtk_corners(cells: DataFrame, dim: int = 3) -> DataFrame:
    """(level, prefix, corner, x, y, z): the corners of each cell in the unit
    cube, in the order of a VTK voxel (cell type 11)."""
    h = F.pow(F.lit(0.5), F.col("level"))
    each = cells.select("level", "prefix", F.explode(F.sequence(F.lit(0), F.lit(2**dim - 1))).alias("corner"))
    at = K.position("prefix", dim)
    return each.select("level", "prefix", "corner", *(((p + F.shiftright("corner", a).bitwiseAND(F.lit(1))) * h).alias(K.AXES[a]) for a, p in enumerate(at)))


def gaussian(spark: SparkSession, n: int, seed: int, mean: float = 0.5, spread: float = 0.12, log: bool = False) -> DataFrame:
    """(pid, x, y, z): normal or log-normal points, kept inside [0, 1)."""

    def draw(k: int) -> Column:
        value = mean + spread * F.randn(seed + k)
        value = F.exp(spread * 4 * F.randn(seed + k)) * mean / 2 if log else value
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0 - 2.0**-31))

    return spark.range(n).select(F.col("id").alias("pid"), draw(0).alias("x"), draw(1).alias("y"), draw(2).alias("z"))


def _numbered(parts: list[Column], rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("pid"), *(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0 - 2.0**-31)).alias(a) for a, p in zip(K.AXES, parts, strict=True)))


def sphere(spark: SparkSession, n: int, seed: int, radius: float = 0.4) -> DataFrame:
    """(pid, x, y, z): points spread evenly over a sphere around the centre."""
    rows = spark.range(n).withColumns({"u": F.rand(seed) * 2 - 1, "t": F.rand(seed + 1) * (2 * np.pi)})
    flat = F.sqrt(1 - F.col("u") * F.col("u"))
    return _numbered([0.5 + radius * flat * F.cos("t"), 0.5 + radius * flat * F.sin("t"), 0.5 + radius * F.col("u")], rows)


def corners(spark: SparkSession, n: int, seed: int, spread: float = 0.1) -> DataFrame:
    """(pid, x, y, z): half normals into the domain from each of its corners."""
    rows = spark.range(n)
    parts = [F.abs(F.randn(seed + k)) * spread for k in range(3)]
    return _numbered([F.when(F.shiftright("id", k) % 2 == 1, 1 - p).otherwise(p) for k, p in enumerate(parts)], rows)


def doubled(points: DataFrame) -> DataFrame:
    """The points, and those mirrored in the centre, with ids 2 pid, 2 pid + 1."""
    both = points.withColumn("_m", F.explode(F.array(F.lit(0), F.lit(1))))
    end = 1.0 - 2.0**-31
    return both.select((F.col("pid") * 2 + F.col("_m")).alias("pid"), *(F.when(F.col("_m") == 1, end - F.col(a)).otherwise(F.col(a)).alias(a) for a in K.AXES))


def peaks(spark: SparkSession, side: int) -> DataFrame:
    """(pid, x, y, z): a regular grid of side x side points on a surface of
    three hills, its heights scaled into the domain."""
    rows = spark.range(side * side).withColumns({"a": (F.col("id") % side) / side, "b": F.floor(F.col("id") / side) / side})
    hills = [(0.3, 0.3, 0.5), (0.7, 0.4, 0.3), (0.5, 0.8, 0.2)]
    height = sum((h * F.exp(-((F.col("a") - p) ** 2 + (F.col("b") - q) ** 2) * 20) for p, q, h in hills), F.lit(0.0))
    return _numbered([F.col("a"), F.col("b"), height], rows)


def vtk_point_lines(points: DataFrame, order: str = "pid") -> DataFrame:
    """(ordinal, value): the lines of a VTK file of points numbered from 0 in
    ``order``; the header has negative ordinals."""
    body = points.select(F.col(order).cast("long").alias("ordinal"), F.concat_ws(" ", *(F.col(a) for a in K.AXES)).alias("value"))
    head = ["# vtk DataFile Version 2.0", "points", "ASCII", "DATASET POLYDATA"]
    lines = F.concat(F.array(*map(F.lit, head)), F.array(F.concat(F.lit("POINTS "), F.count("*").cast("string"), F.lit(" double"))))
    top = points.agg(lines.alias("h")).select(F.posexplode("h").alias("i", "value"))
    return top.select((F.col("i") - len(head) - 1).cast("long").alias("ordinal"), "value").unionByName(body)


def vtk_grid_lines(values: DataFrame, level: int) -> DataFrame:
    """(ordinal, value): the lines of a VTK file of structured points from the
    cells (prefix, value) of a regular grid, x fastest."""
    side = 2**level
    x, y, z = K.position("prefix")
    body = values.select((x + side * (y + side * z)).alias("ordinal"), F.col("value").cast("string").alias("value"))
    head = ["# vtk DataFile Version 2.0", "grid", "ASCII", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {side} {side} {side}", "ORIGIN 0 0 0", f"SPACING {1 / side} {1 / side} {1 / side}", f"POINT_DATA {side**3}", "SCALARS value double", "LOOKUP_TABLE default"]
    top = values.sparkSession.range(len(head)).select((F.col("id") - len(head)).alias("ordinal"), F.element_at(F.array(*map(F.lit, head)), (F.col("id") + 1).cast("int")).alias("value"))
    return top.unionByName(body)
