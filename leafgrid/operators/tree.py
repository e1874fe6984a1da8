"""Linear octrees as tables of (level, prefix), for 1 to 3 dimensions.

Every operator works on (level, prefix) by equality: ancestors are listed by
exploding levels, never by comparing key ranges, so all joins hash or sort on
keys.  Steps over levels are made in passes over chunks (``runs``); tables that
are read again are cut in the shared folder.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from . import runs

OCTANT = ("level", "prefix")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints ``df`` in ``spark.checkpoint.dir``, or, only where that is
    unset and the master is this machine, in a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafgrid-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A checkpointed table in as many partitions as there are cores, at least:
    small tables come in one, though what is made of them may be large."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def octants(df: DataFrame) -> DataFrame:
    return df.select(F.col("level").cast("int").alias("level"), F.col("prefix").cast("long").alias("prefix"))


def root(like: DataFrame) -> DataFrame:
    return like.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("prefix"))


def ancestors(cells: DataFrame, dim: int = 3) -> DataFrame:
    """Distinct strict ancestors."""
    return runs.ancestors(octants(cells), dim, K.MAX_DEPTH).distinct()


def _children(cells: DataFrame, dim: int) -> DataFrame:
    return cells.select((F.col("level") + 1).alias("level"), F.explode(K.children("prefix", dim)).alias("prefix"))


def gathered(rows: DataFrame, keys: tuple[str, ...], total: int = 0) -> DataFrame:
    """Cells with ``_kids``, the united bits of all their rows, of which there
    are ``total`` at most; dealt first, as few rows share a cell."""
    return rows.repartition(*runs.tasks(rows, total), *keys).groupBy(*keys).agg(F.bit_or("_kids").alias("_kids"))


def unsplit(cells: DataFrame, dim: int) -> DataFrame:
    """Cells by each child ``_c`` that is not among their bits ``_kids``."""
    each = cells.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**dim - 1).cast("long"))))
    return each.filter(F.call_function("shiftright", F.col("_kids"), F.col("_c").cast("int")).bitwiseAND(F.lit(1)) == 0)


def _leaves_of(kids: DataFrame, internal: DataFrame, dim: int) -> DataFrame:
    """Children of split cells that are not split; the root if none of
    ``internal``, from which they come, is there."""
    leaves = unsplit(kids, dim).select((F.col("level") + 1).alias("level"), (F.shiftleft("prefix", dim) + F.col("_c")).alias("prefix"))
    return leaves.unionByName(root(kids).join(internal.filter("level = 0"), list(OCTANT), "left_anti"))


def leaves_below(internal: DataFrame, dim: int = 3, total: int = 0) -> DataFrame:
    """The complete octree in which all ``internal``, ``total`` cells with all
    their ancestors, are split."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("prefix").bitwiseAND(F.lit(2**dim - 1)).cast("int"))
    above = internal.filter("level > 0").select((F.col("level") - 1).alias("level"), F.shiftright("prefix", dim).alias("prefix"), bit.alias("_kids"))
    rows = internal.select(*OCTANT, F.lit(0).alias("_kids")).unionByName(above)
    return _leaves_of(gathered(rows, OCTANT, 2 * total), internal, dim)


def crowded(points: DataFrame, depth: int, most: int, dim: int = 3, key: str = "key") -> DataFrame:
    """The cells above ``depth`` that have over ``most`` points, by their
    full-depth ``key``."""
    counts = runs.tallied(points.select(F.col(key).alias("prefix")), "prefix")
    cells = runs.crowded(counts, {"prefix": depth}, most, dim, total=points.count())
    return cut(cells.filter(F.col("_n") > most).select(*OCTANT))


def construct(points: DataFrame, depth: int, most: int, dim: int = 3, key: str = "key") -> DataFrame:
    """The complete octree of points with a full-depth ``key``: a cell above
    ``depth`` is split iff it has over ``most`` points.  Repeated points count;
    empty leaves are part of the tree; no points make the root."""
    internal = crowded(points, depth, most, dim, key)
    return leaves_below(internal, dim, internal.count())


#: Levels that one step of a roll-up lists.
STRIDE = 4


def _counted(points: DataFrame, key: str) -> DataFrame:
    return points.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("prefix")).agg(F.count("*").alias("_n"))


def _rolled(counts: DataFrame, depth: int, dim: int, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """(level, prefix, _n) of the cells of all levels that hold points and pass
    ``keep``, from ``counts`` (prefix, _n) at full depth: STRIDE levels at a
    time, each step from the sums of the one before, of which there are fewer
    and fewer."""
    out, at, top = None, counts, depth
    while top >= 0:
        low = max(top - STRIDE + 1, 0)
        each = at.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(top))))
        rows = each.groupBy("level", K.up("prefix", F.lit(top) - F.col("level"), dim).alias("prefix")).agg(F.sum("_n").alias("_n"))
        if low:
            rows = cut(rows)
            at = rows.filter(F.col("level") == low).select(F.shiftright("prefix", dim).alias("prefix"), "_n")
        kept = rows.filter(keep(F.col("_n"), F.col("level")))
        out = kept if out is None else out.unionByName(kept)
        top = low - 1
    return out


def leaf_counts(points: DataFrame, leaves: DataFrame, depth: int, dim: int = 3, key: str = "key") -> DataFrame:
    """Leaves with ``n``, the number of points in each, 0 included."""
    cells = _rolled(_counted(points, key), depth, dim, lambda n, level: n > 0)
    counts = cells.select(*OCTANT, F.col("_n").alias("n"))
    return leaves.join(counts, list(OCTANT), "left").select(*OCTANT, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def linearise(cells: DataFrame, dim: int = 3) -> DataFrame:
    """Distinct cells without those that contain another."""
    found = cut(runs.finest(octants(cells).distinct(), dim, K.MAX_DEPTH))
    above = found.filter(F.col("kind") == runs.ABOVE).select(*OCTANT)
    last = found.filter(F.col("kind") == runs.LAST).select(*OCTANT).join(above, list(OCTANT), "left_anti")
    return found.filter(F.col("kind") == runs.KEPT).select(*OCTANT).unionByName(last)


def complete(cells: DataFrame, dim: int = 3) -> DataFrame:
    """The coarsest complete octree that has the finest of ``cells``."""
    return leaves_below(ancestors(octants(cells), dim), dim)


def merge(one: DataFrame, two: DataFrame, dim: int = 3) -> DataFrame:
    return linearise(octants(one).unionByName(octants(two)), dim)


def refine(cells: DataFrame, depth: int, dim: int = 3) -> DataFrame:
    """Every cell's children; cells at ``depth`` stay."""
    cells = octants(cells)
    return _children(cells.filter(F.col("level") < depth), dim).unionByName(cells.filter(F.col("level") >= depth))


def coarsen(cells: DataFrame, dim: int = 3) -> DataFrame:
    """One pass: each full set of siblings becomes its parent."""
    cells = octants(cells).distinct()
    above = F.shiftright("prefix", dim)
    full = cells.filter("level > 0").groupBy("level", above.alias("_p")).agg(F.count("*").alias("_n")).filter(F.col("_n") == 2**dim).select("level", "_p")
    rest = cells.withColumn("_p", above).join(full, ["level", "_p"], "left_anti").select(*OCTANT)
    return rest.unionByName(full.select((F.col("level") - 1).alias("level"), F.col("_p").alias("prefix")))


def simple_coarsen(cells: DataFrame, dim: int = 3) -> DataFrame:
    """All parents, completed."""
    cells = octants(cells)
    return complete(cells.select(K.parent_level(F.col("level")).alias("level"), F.when(F.col("level") > 0, F.shiftright("prefix", dim)).otherwise(F.col("prefix")).alias("prefix")), dim)


def regular(spark, level: int, dim: int = 3) -> DataFrame:
    return spark.range(2 ** (dim * level)).select(F.lit(level).alias("level"), F.col("id").alias("prefix"))


def split_in_balanced(internal: DataFrame, depths: dict[str, int], dim: int, corners: bool) -> DataFrame:
    """The cells with their bits ``_kids`` that are split in the balanced tree,
    if ``internal`` are: listed chunk by chunk, then united."""
    made = cut(runs.balanced(internal, depths, dim, corners, total=internal.count()))
    return cut(gathered(made, ("level", *depths), made.count()))


def balance_below(internal: DataFrame, dim: int = 3, corners: bool = True) -> DataFrame:
    """The coarsest balanced octree in which all ``internal`` are split."""
    split = split_in_balanced(internal, {"prefix": K.MAX_DEPTH}, dim, corners)
    return _leaves_of(split, split, dim)


def balance(leaves: DataFrame, dim: int = 3, corners: bool = True) -> DataFrame:
    """The coarsest refinement of a complete octree in which neighbouring
    leaves differ by one level at most; a tree with gaps is completed."""
    leaves = octants(leaves)
    above = cut(leaves.filter("level > 0").select((F.col("level") - 1).alias("level"), F.shiftright("prefix", dim).alias("prefix")).distinct())
    return leaves.distinct() if above.isEmpty() else balance_below(above, dim, corners)


def balance_candidates(cells: DataFrame, depth: int, dim: int = 3, corners: bool = True) -> DataFrame:
    """(level, prefix, at, candidate): the cells that may lie around each of
    ``cells`` in a balanced tree, those of its own level, of the next coarser
    one outside its parent, and of the next finer one, down to ``depth``."""
    around = cells.select(*OCTANT, F.explode(K.neighbours(F.col("level"), F.col("prefix"), dim, corners)).alias("_n"))
    own = F.array(F.struct(F.col("level").alias("at"), F.col("_n").alias("candidate")))
    above = F.struct((F.col("level") - 1).alias("at"), F.shiftright("_n", dim).alias("candidate"))
    outside = (F.col("level") > 0) & (F.shiftright("_n", dim) != F.shiftright("prefix", dim))
    finer = F.transform(K.children("_n", dim), lambda c: F.struct((F.col("level") + 1).alias("at"), c.alias("candidate")))
    none = F.filter(own, lambda _: F.lit(False))
    every = F.concat(own, F.when(outside, F.array(above)).otherwise(none), F.when(F.col("level") < depth, finer).otherwise(none))
    return around.select(*OCTANT, F.explode(every).alias("_c")).select(*OCTANT, "_c.*").distinct()


def between(first: tuple[int, int], second: tuple[int, int], like: DataFrame, depth: int, dim: int = 3, low: bool = False, high: bool = False) -> DataFrame:
    """The coarsest cells strictly between two cells on the curve, with the
    ends if asked."""
    spark = like.sparkSession
    ends = spark.createDataFrame([first, second], "level int, prefix bigint")
    key = K.first_key(F.col("level"), F.col("prefix"), depth, dim)
    lo, hi = ((p + 1) << dim * (depth - l) for l, p in (first, (second[0], second[1] - 1)))
    inner = complete(ends, dim).filter((key >= lo) & (key < hi))
    extra = ([first] if low else []) + ([second] if high else [])
    return inner.unionByName(spark.createDataFrame(extra, "level int, prefix bigint")) if extra else inner


def from_grid(values: DataFrame, level: int, threshold: float, dim: int = 3, fewest: int = 10) -> DataFrame:
    """An octree of a regular grid (prefix, value) of 2**level cells a side:
    full sets of siblings whose values differ by less than ``threshold`` are
    merged to their mean, pass by pass, while at least ``fewest`` cells are
    left and a pass changes something."""
    cells = cut(values.select(F.lit(level).alias("level"), F.col("prefix").cast("long").alias("prefix"), F.col("value").cast("double").alias("value")))
    count = cells.count()
    while count >= fewest:
        groups = cells.filter("level > 0").groupBy("level", F.shiftright("prefix", dim).alias("_p")).agg(F.count("*").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.avg("value").alias("value"))
        merged = groups.filter((F.col("_n") == 2**dim) & (F.col("_hi") - F.col("_lo") < threshold))
        rest = cells.withColumn("_p", F.shiftright("prefix", dim)).join(merged.select("level", "_p"), ["level", "_p"], "left_anti").drop("_p")
        cells = cut(rest.unionByName(merged.select((F.col("level") - 1).alias("level"), F.col("_p").alias("prefix"), "value")))
        before, count = count, cells.count()
        if before == count:
            break
    return cells.select(*OCTANT)


def volume(cells: DataFrame, depth: int, dim: int = 3) -> DataFrame:
    """``cells``: their number; ``volume``: cells of full depth they cover, for
    a complete tree 2**(dim * depth)."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), ((F.lit(depth) - F.col("level")) * dim).cast("int"))
    return cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum(one), F.lit(0).cast("long")).alias("volume"))


def unbalanced(leaves: DataFrame, dim: int = 3, corners: bool = True) -> DataFrame:
    """Leaves next to a leaf that is two or more levels coarser."""
    own, near = F.col("prefix"), K.neighbours(F.col("level"), F.col("prefix"), dim, corners)
    # a leaf's neighbours lie in few cells two levels above, which most leaves share
    above = F.filter(F.array_distinct(F.transform(near, lambda n: F.shiftright(n, 2 * dim))), lambda n: n != F.shiftright(own, 2 * dim))
    asked = leaves.filter("level > 1").select(*OCTANT, (F.col("level") - 2).alias("_l"), F.explode(above).alias("_p"))
    cells = asked.select("_l", "_p").distinct().withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_l"))))
    coarse = leaves.select(F.col("level").alias("_u"), F.col("prefix").alias("_q"))
    inside = cells.withColumn("_q", K.up("_p", F.col("_l") - F.col("_u"), dim)).join(coarse, ["_u", "_q"], "left_semi").select("_l", "_p")
    return asked.join(inside.distinct(), ["_l", "_p"], "left_semi").select(*OCTANT).distinct()


def spheres(spark, depth: int, split: Column, dim: int = 3) -> DataFrame:
    """Octree by a rule: from the root down, cells where ``split`` (over level,
    prefix) holds are refined, to ``depth`` at most."""
    at, leaves = regular(spark, 0, dim), []
    for _ in range(depth):
        leaves.append(at.filter(~split))
        at = cut(_children(at.filter(split), dim))
    return reduce(DataFrame.unionByName, [*leaves, at])


def block_boundary(cells: DataFrame, block: int, dim: int = 3) -> DataFrame:
    """(level, prefix, flags): cells that touch the boundary of the block of
    level ``block`` they lie in, flags as in ``keys.boundary_flags``."""
    inner = F.col("level") - block
    own = F.col("prefix") - K.down(K.up("prefix", inner, dim), inner, dim)
    return cells.filter(F.col("level") >= block).select(*OCTANT, K.boundary_flags(inner, own, dim).alias("flags")).filter("flags <> 0")


def embedded(leaves: DataFrame, dim: int = 3) -> DataFrame:
    """(level, prefix, beyond): the tree as the low part of a domain twice as
    wide, and the cells just beyond its high ends, so that every vertex is some
    cell's low corner.  ``beyond`` has bit 1, 2, 4 for a step along x, y, z."""
    at = K.position("prefix", dim)
    end = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level").cast("int")) - 1
    touched = sum((F.when(p == end, 1 << a).otherwise(0) for a, p in enumerate(at)), F.lit(0))
    each = octants(leaves).withColumn("_t", touched).withColumn("beyond", F.explode(F.sequence(F.lit(0), F.lit(2**dim - 1))))
    moved = [p + F.shiftright("beyond", a).bitwiseAND(F.lit(1)) for a, p in enumerate(at)]
    rows = each.filter(F.col("beyond").bitwiseAND(F.col("_t")) == F.col("beyond"))
    return rows.select((F.col("level") + 1).alias("level"), K.interleave(*moved).alias("prefix"), "beyond")


def by_density(cells: DataFrame, weight: str = "weight") -> DataFrame:
    """``cells`` with their ``place`` from 1 when ordered by falling weight; of
    equal weights above 1 the finer first, of others the coarser.  The places
    come from counts by (weight, level) and a bucket of the curve, not from one
    sorted task."""
    fine = F.when(F.col(weight) > 1, -F.col("level")).otherwise(F.col("level"))
    rows = cells.withColumns({"_w": -F.col(weight), "_f": fine, "_b": F.shiftright("prefix", 9)})
    order = ["_w", "_f", "_b"]
    counts = rows.groupBy(*order).agg(F.count("*").alias("_n"))
    # in two steps: totals of the weights' kinds, then inside each kind
    kinds = counts.groupBy("_w", "_f").agg(F.sum("_n").alias("_all"))
    kinds = kinds.select("_w", "_f", (F.sum("_all").over(Window.orderBy("_w", "_f")) - F.col("_all")).alias("_kind"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_w", "_f").orderBy("_b")) - F.col("_n")).drop("_n").join(kinds, ["_w", "_f"])
    inside = F.row_number().over(Window.partitionBy(*order).orderBy("prefix"))
    return rows.join(before, order).withColumn("place", F.col("_kind") + F.col("_before") + inside).drop(*order, "_kind", "_before")


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """(level, prefix, side): cells of only one of two trees, by the side; cells
    that one has more often, as often more."""
    one, two = octants(one), octants(two)
    rows = one.withColumn("_n", F.lit(1)).unionByName(two.withColumn("_n", F.lit(-1)))
    counts = rows.repartition(*runs.tasks(rows, rows.count()), *OCTANT).groupBy(*OCTANT).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, 1).otherwise(2)
    return counts.select(*OCTANT, F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side"))
