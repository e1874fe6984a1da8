"""Sharding by balanced label propagation, in DataFrame operations.

Documents with equal texts are linked.  Each starts in the shard that a hash
gives; in each round every group counts its members by shard, picks the shard
with most, and members elsewhere move there as far as the shard's quota allows.
What moves are cells, the members of a group that are in the same shard, so a
round costs one row for each group and shard, however large a group is; a group
over half a shard is first split into pieces that vote on their own.

At the end all rows are numbered in the order of shard, with a shard's groups
between its single documents, and the numbers are cut into equal parts.  So
counts differ by one at most, single documents give way first, and all but a
few groups stay whole.  Numbers come from counts of small buckets, not from one
global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, only

SHARDS, ROUNDS, QUOTA, BUCKET = 8, 6, 0.95, 20_000
#: Groups that count as crowded, at most.
CROWDED = 10_000


def _chance(*parts: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def propagate(cells: DataFrame, capacity: float, tables: Tables, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (grp, piece, origin, n) with ``shard``, where each cell's rows
    should go.  ``capacity``: rows of groups that a shard may take; one that
    could not take all is no target in the next round, so its groups that are
    still apart gather elsewhere."""
    cells = cells.withColumn("shard", F.col("origin"))
    full: list[int] = []
    for turn in range(rounds):
        votes = cells.groupBy("grp", "piece", "shard").agg(F.sum("n").alias("n"))
        open_ = ~F.col("shard").isin(full) if full else F.lit(True)
        most = votes.groupBy("grp", "piece").agg((-F.max(F.struct(open_.alias("o"), "n", (-F.col("shard")).alias("s")))["s"]).alias("target"))
        cells = cells.join(most, ["grp", "piece"])
        moving = F.when(F.col("target") != F.col("shard"), F.col("n")).otherwise(0)
        # at most one row for each shard
        loads = cells.groupBy("target").agg(F.sum("n").alias("all"), F.sum(moving).alias("moving")).collect()
        share = {r["target"]: min(1.0, max(0.0, (capacity - (r["all"] - r["moving"])) / r["moving"])) for r in loads if r["moving"]}
        if not share:
            break
        full = sorted(j for j, x in share.items() if x < 1)
        fraction = F.coalesce(*(F.when(F.col("target") == j, F.lit(x)) for j, x in sorted(share.items())), F.lit(0.0))
        goes = _chance(F.col("grp"), F.col("piece"), F.lit(turn)) < fraction
        cells = tables.keep(cells.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target"))
    return cells.select("grp", "piece", "origin", "shard")


def _before(counts: DataFrame, order: list[str], high: list[str]) -> DataFrame:
    """``counts`` (order..., n) with the sum of all n ``before`` a row.  Sums
    run inside ``high`` (columns of ``order`` and a coarse one), then over one
    row for each, so that no task has more than about the root of all rows."""
    sums = counts.groupBy(*high).agg(F.sum("n").alias("all"))
    above = sums.select(*high, (F.sum("all").over(Window.orderBy(*high)) - F.col("all")).alias("above"))
    inside = F.sum("n").over(Window.partitionBy(*high).orderBy(*order)) - F.col("n")
    return counts.withColumn("inside", inside).join(above, high).select(*order, (F.col("above") + F.col("inside")).alias("before"))


def _looked_up(rows: DataFrame, table: DataFrame, on: list[str], crowded: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``table``; the keys of the ``crowded`` groups
    (grp), which are few by their definition, are broadcast, so that their many
    rows do not meet."""
    few = F.broadcast(table.join(crowded, "grp", "left_semi").withColumn("_few", F.lit(True)))
    rest = table.join(F.broadcast(crowded), "grp", "left_anti")
    marked = rows.join(few, on, "left")
    other = marked.filter("_few is null").select(*rows.columns).join(rest, on, "left")
    return marked.filter("_few").select(*other.columns).unionByName(other)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of ``docs``: (id_col, size, text_crc32, law, shard,
    slot, grown_shard).

    ``size``: the text's UTF-8 bytes (null: none) plus 1; ``text_crc32``
    unsigned, of no bytes for null; ``law`` is "rows": the shards' row counts
    differ by one at most.  ``slot`` numbers a shard's rows from 0 without
    gaps.  ``grown_shard`` is null under this law.

    Equal texts are one group; null and empty texts are equal.  Null ids and
    repeated rows are rows like others.  Other columns are ignored.  An empty
    table gives an empty result.  Rows are told apart by their place in the
    input, so the same rows in other files may get other shards; the law and
    the groups hold all the same.
    """
    source = only(docs, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    with Tables(docs.sparkSession) as tables:
        rows = tables.keep(source.select(F.monotonically_increasing_id().alias("row"), "id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("grp")))
        total = rows.count()
        groups = tables.keep(rows.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1"))
        # CROWDED of them at most, as each has more than total / CROWDED rows
        crowded = tables.keep(groups.filter(F.col("members") > max(1, total // CROWDED)).select("grp"))
        pieces = F.ceil(F.col("members") / F.lit(max(1.0, total / shards / 2))).cast("long")
        own = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")
        known = _looked_up(rows, groups, ["grp"], crowded).withColumn("members", F.coalesce("members", F.lit(1).cast("long")))
        rows = tables.keep(known.select("row", "id", "size", "crc", "grp", "members", F.pmod(F.xxhash64("row", F.lit(2)), pieces).alias("piece"), own.alias("origin")))

        cells = tables.keep(rows.filter("members > 1").groupBy("grp", "piece", "origin").agg(F.count("*").alias("n")))
        placed = propagate(cells, QUOTA * total / shards, tables, shards, rounds)
        # single rows go where linked ones leave room, in proportion
        taken = {r["shard"]: r["n"] for r in cells.join(placed, ["grp", "piece", "origin"]).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0.0, total / shards - taken.get(j, 0)) for j in range(shards)]
        ends = [sum(room[: j + 1]) / (sum(room) or 1.0) for j in range(shards - 1)]
        ballast = F.coalesce(*(F.when(_chance(F.col("row"), F.lit(5)) < x, F.lit(j)) for j, x in enumerate(ends)), F.lit(shards - 1))
        near = _looked_up(rows, placed, ["grp", "piece", "origin"], crowded).withColumn("near", F.coalesce("shard", ballast))

        buckets = -(-total // bucket) or 1
        # half of a shard's single rows come before its groups and half behind
        single = F.when(F.col("members") > 1, 1).when(_chance(F.col("row"), F.lit(6)) < 0.5, 0).otherwise(2)
        place = F.when(F.col("members") == 1, F.xxhash64("row", F.lit(3))).otherwise(F.xxhash64("grp", "piece"))
        # a piece of more rows than a bucket takes several
        salts = F.ceil(F.col("members") / F.lit(bucket)).cast("long")
        salt = F.when(F.col("members") > bucket, 1 + F.pmod(F.xxhash64("row", F.lit(4)), salts)).otherwise(F.lit(0))
        rows = tables.keep(near.select("row", "id", "size", "crc", "grp", "piece", "near", single.alias("single"), F.pmod(place, F.lit(buckets)).alias("bucket"), salt.cast("long").alias("salt")))
        cell = ["near", "single", "bucket", "salt"]
        counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
        coarse = F.floor(F.col("bucket") / max(1, math.isqrt(buckets)))
        before = _before(counts.withColumn("high", coarse), ["near", "single", "high", "bucket", "salt"], ["near", "single", "high"]).drop("high")
        inside = F.row_number().over(Window.partitionBy(*cell).orderBy("grp", "piece", "row"))
        numbered = rows.join(before, cell).withColumn("number", F.col("before") + inside - 1)
        shard = F.expr(f"int(number * {shards} div {max(1, total)})")
        first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
        out = numbered.withColumn("shard", shard).withColumn("slot", F.col("number") - first)
        return tables.result(out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
