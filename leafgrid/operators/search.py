"""Searches and ordered operators over keys, without global single-task sorts.

Running values over a whole table use three levels: rows are dealt by a coarse
bucket of the key, buckets by a coarser one, and running values are computed
inside each in parallel; one row for each of the coarsest carries totals on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K


#: Leaves up to this number are broadcast (16 MB of keys), counted first.
BROADCAST_LEAVES = 500_000


def contained(points: DataFrame, leaves: DataFrame, depth: int, dim: int = 3, key: str = "key") -> DataFrame:
    """Each point with the leaf (level, prefix) that contains it; points outside
    all leaves are left out.

    Equality joins on the levels that occur.  Up to BROADCAST_LEAVES leaves
    (counted) these are broadcast and no point moves.  Above, points first meet
    distinct keys only: repeated points travel once to find their level."""
    cells = leaves.select("level", "prefix")
    counts = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}  # depth + 1 rows at most
    levels = F.array(*(F.lit(x) for x in sorted(counts))) if counts else F.array().cast("array<int>")

    def met(rows: DataFrame, by: str, own: DataFrame) -> DataFrame:
        each = rows.withColumn("level", F.explode(levels)).withColumn("prefix", K.up(by, F.lit(depth) - F.col("level"), dim))
        return each.join(own, ["level", "prefix"])

    if sum(counts.values()) <= BROADCAST_LEAVES:
        return met(points, key, F.broadcast(cells))
    found = met(points.select(F.col(key).alias("_k")).distinct(), "_k", cells)
    return points.join(found, points[f"`{key}`"] == found["_k"]).drop("_k")


#: Buckets that a coarser bucket has, as low bits of their number.
HIGH_BITS = 12


def carried(tops: DataFrame, value: str, total: str = "sum") -> DataFrame:
    """``tops`` (_b, value): one row a bucket, with the running ``total`` ("sum"
    or "max") of the buckets before as ``_before``, null for none.  No task has
    more than 2**HIGH_BITS buckets, or one row for each so many."""
    add = {"sum": F.sum, "max": F.max}[total]
    both = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest}[total]
    rows = tops.withColumn("_h", F.shiftright(F.col("_b").cast("long"), HIGH_BITS))
    inside = add(value).over(Window.partitionBy("_h").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    high = rows.groupBy("_h").agg(add(value).alias("_a"))
    above = high.select("_h", add("_a").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    return rows.withColumn("_inside", inside).join(above, "_h").select("_b", both(F.col("_inside"), F.col("_above")).alias("_before"))


def as_of(queries: DataFrame, listed: DataFrame, key: str, bucket: Column, out: str = "found") -> DataFrame:
    """Each query row with the greatest ``key`` of ``listed`` that is not above
    its own, null if there is none.  ``bucket`` is a coarse monotone function
    of the key, with few rows a value."""
    both = queries.withColumn("_q", F.lit(1)).withColumn("_v", F.lit(None).cast("long"))
    own = listed.select(F.col(key), F.lit(0).alias("_q"), F.col(key).cast("long").alias("_v"))
    both = both.unionByName(own, allowMissingColumns=True).withColumn("_b", bucket)
    tops = both.groupBy("_b").agg(F.max("_v").alias("_top"))
    inside = F.max("_v").over(Window.partitionBy("_b").orderBy(key, "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_in", inside).filter("_q = 1").join(carried(tops, "_top", "max"), "_b")
    return found.withColumn(out, F.coalesce("_in", "_before")).drop("_q", "_v", "_b", "_in", "_before")


def next_of(queries: DataFrame, listed: DataFrame, key: str, bucket: Callable[[Column], Column], out: str = "found") -> DataFrame:
    """Each query row with the least ``key`` of ``listed`` that is not below its
    own, null if there is none: ``as_of`` along the keys' negatives.
    ``bucket``: as there, as a function of the key."""
    turned = as_of(queries.withColumn("_k", -F.col(key)), listed.select((-F.col(key)).alias("_k")), "_k", bucket(F.col("_k")), "_o")
    return turned.withColumn(out, -F.col("_o")).drop("_k", "_o")


def running(df: DataFrame, order: list[str], value: Column, bucket: Column, out: str = "total") -> DataFrame:
    """``out``: the sum of ``value`` over all rows up to this one in ``order``,
    which must be unique; ``bucket`` as in ``as_of``, of the order's first
    columns."""
    rows = df.withColumn("_v", value).withColumn("_b", bucket)
    sums = rows.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = carried(sums, "_s").withColumn("_before", F.coalesce("_before", F.lit(0)))
    inside = F.sum("_v").over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_in", inside).join(before, "_b").withColumn(out, F.col("_before") + F.col("_in")).drop("_v", "_b", "_in", "_before")


def numbered(df: DataFrame, order: list[str], bucket: Column, out: str = "id") -> DataFrame:
    """Numbers all rows from 0 in ``order``."""
    return running(df, order, F.lit(1).cast("long"), bucket, out).withColumn(out, F.col(out) - 1)


def weighted_parts(df: DataFrame, order: list[str], weight: Column, parts: int, bucket: Column, out: str = "part") -> DataFrame:
    """Cuts rows in order into ``parts`` of about equal weight: the part of a
    row follows from the weight up to and with it."""
    total = df.agg(F.sum(weight)).first()[0] or 1
    rows = running(df, order, weight, bucket, "_t")
    return rows.withColumn(out, F.least(F.expr(f"int((_t * {parts} + {total} - 1) div {total}) - 1"), F.lit(parts - 1))).drop("_t")


def quota_parts(df: DataFrame, order: list[str], weight: Column, parts: int, bucket: Column, out: str = "part") -> DataFrame:
    """Cuts rows in order into ``parts`` by quotas of whole weights: of a total
    of a * parts + e the first e parts have a quota of a + 1, the others of a;
    a row belongs where the weight up to and with it falls."""
    each, extra = divmod(int(df.agg(F.sum(weight)).first()[0] or 0), parts)
    rows = running(df, order, weight, bucket, "_t")
    high = extra * (each + 1)
    low = F.expr(f"int((_t - {high} - 1) div {max(each, 1)}) + {extra}")
    part = F.when(F.col("_t") <= high, F.expr(f"int((_t - 1) div {each + 1})")).otherwise(F.least(low, F.lit(parts - 1)))
    return rows.withColumn(out, F.greatest(part, F.lit(0))).drop("_t")


def heaviest(df: DataFrame, weight: str, share: float, id_col: str) -> DataFrame:
    """The rows of a bounded table (one row a block) from the heaviest on, as
    many as it takes to have more than ``share`` of all weight."""
    whole = Window.orderBy(F.desc(weight), id_col)
    rows = df.withColumn("_t", F.sum(weight).over(whole) - F.col(weight)).withColumn("_a", F.sum(weight).over(Window.partitionBy()))
    return rows.filter(F.col("_t") <= F.col("_a") * share).drop("_t", "_a")


def split(df: DataFrame, order: list[str], parts: int, bucket: Column, out: str = "part") -> DataFrame:
    """Cuts rows in order into ``parts`` of an equal number of rows; the last
    also takes the remainder."""
    each = max(df.count() // parts, 1)
    return numbered(df, order, bucket, "_id").withColumn(out, F.least(F.expr(f"int(_id div {each})"), F.lit(parts - 1))).drop("_id")
