"""Finite-element meshes of balanced 3-D octrees.

Elements are leaves; a vertex is its integer position at full depth.  A vertex
of a leaf hangs if a leaf one level coarser touches it without having it as a
corner.  Nodes are the vertices that hang nowhere; an element's node at a
hanging vertex i is vertex i of the element's parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from . import search

AT = ["nx", "ny", "nz"]


def corners(leaves: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, vertex, nx, ny, nz): the eight vertices of each leaf."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("level")).cast("int"))
    each = leaves.select("level", "prefix", *(p.alias(f"_{a}") for a, p in zip("xyz", K.position("prefix"), strict=True)), size.alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("vertex"))
    bit = [F.shiftright("vertex", a).bitwiseAND(F.lit(1)) for a in range(3)]
    return each.select("level", "prefix", "vertex", *(((F.col(f"_{a}") + b) * F.col("_h")).alias(f"n{a}") for a, b in zip("xyz", bit, strict=True)))


def hanging(leaves: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, vertex) of the vertices that hang."""
    each = corners(leaves.filter("level > 0"), depth)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth + 1) - F.col("level")).cast("int"))
    odd = sum((F.when(F.col(n) % size != 0, 1).otherwise(0) for n in AT), F.lit(0))
    each = each.withColumn("_s", size).filter(odd > 0)
    # an odd coordinate lies inside one coarse cell, an even one between two
    sides = [F.when(F.col(n) % F.col("_s") != 0, F.array(F.expr(f"{n} div _s"))).otherwise(F.array(F.expr(f"{n} div _s - 1"), F.expr(f"{n} div _s"))) for n in AT]
    for axis, side in enumerate(sides):
        each = each.withColumn(f"_c{axis}", F.explode(side))
    end = F.expr("shiftleft(1L, level - 1)")
    cells = [F.col(f"_c{a}") for a in range(3)]
    inside = (F.least(*cells) >= 0) & (F.greatest(*cells) < end)
    each = each.filter(inside).withColumn("_level", F.col("level") - 1).withColumn("_prefix", K.interleave(*cells))
    coarse = leaves.select(F.col("level").alias("_level"), F.col("prefix").alias("_prefix"))
    return each.join(coarse, ["_level", "_prefix"], "left_semi").select("level", "prefix", "vertex").distinct()


def elements(leaves: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, vertex, hangs, nx, ny, nz): each element's eight nodes."""
    own = corners(leaves, depth)
    marks = hanging(leaves, depth).withColumn("_h", F.lit(True))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth + 1) - F.col("level")).cast("int"))
    up = K.position(F.shiftright("prefix", 3))
    hangs = F.coalesce("_h", F.lit(False))
    above = [(p + F.shiftright("vertex", a).bitwiseAND(F.lit(1))) * size for a, p in enumerate(up)]
    rows = own.join(marks, ["level", "prefix", "vertex"], "left")
    return rows.select("level", "prefix", "vertex", hangs.alias("hangs"), *(F.when(hangs, u).otherwise(F.col(n)).alias(n) for n, u in zip(AT, above, strict=True)))


def nodes(mesh: DataFrame, depth: int) -> DataFrame:
    """(nx, ny, nz, boundary): boundary is the number of coordinates at an end
    of the domain (1 face, 2 edge, 3 corner)."""
    at_end = sum((F.when((F.col(n) == 0) | (F.col(n) == 2**depth), 1).otherwise(0) for n in AT), F.lit(0))
    return mesh.select(*AT).distinct().withColumn("boundary", at_end.cast("int"))


def node_numbers(mesh: DataFrame, bits: int = 9) -> DataFrame:
    """(nx, ny, nz, node): nodes numbered from 0 along the curve.  Numbers are
    dealt by buckets of ``bits`` low bits of the key."""
    points = mesh.select(*AT).distinct().withColumn("_key", K.interleave(*(F.col(n) for n in AT)))
    return search.numbered(points, ["_key"], F.shiftright("_key", bits), "node").drop("_key")


def element_numbers(mesh: DataFrame, depth: int, bits: int = 9) -> DataFrame:
    """(level, prefix, element): elements numbered likewise."""
    cells = mesh.select("level", "prefix").distinct().withColumn("_key", K.first_key(F.col("level"), F.col("prefix"), depth))
    return search.numbered(cells, ["_key"], F.shiftright("_key", bits), "element").drop("_key")


def numbered(mesh: DataFrame, depth: int, bits: int = 9) -> DataFrame:
    """(element, vertex, node): each element's nodes, by their numbers."""
    listed, named = element_numbers(mesh, depth, bits), node_numbers(mesh, bits)
    return mesh.join(listed, ["level", "prefix"]).join(named, AT).select("element", "vertex", "node")


def masks(mesh: DataFrame) -> DataFrame:
    """(level, prefix, child, mask): bit i of the mask for a hanging vertex i."""
    bit = F.when(F.col("hangs"), F.expr("shiftleft(1, vertex)")).otherwise(0)
    return mesh.groupBy("level", "prefix").agg(F.sum(bit).cast("int").alias("mask")).withColumn("child", F.when(F.col("level") > 0, K.child_number("prefix")).otherwise(0))


def inject(values: DataFrame, coarse_nodes: DataFrame) -> DataFrame:
    """Fine nodal values at the coarse nodes; a node without one gets 0."""
    return coarse_nodes.select(*AT).join(values, AT, "left").select(*AT, F.coalesce("value", F.lit(0.0)).alias("value"))


def shape(local: list[Column], vertex: Column) -> Column:
    """Trilinear shape function of a vertex at local coordinates in [0, 1]."""
    out = F.lit(1.0)
    for axis, t in enumerate(local):
        out = out * F.when(F.shiftright(vertex, axis).bitwiseAND(F.lit(1)) == 1, t).otherwise(1 - t)
    return out
