"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids of up to this many bytes together (16 and their text each) may be
#: broadcast; above it the same join runs as a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of text that a sample of labelled documents has at most.
SAMPLE_BYTES = 24 << 20
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.  Only
    where that is unset and the master is this machine (tests) a temporary
    folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _folders.setdefault(f"local {spark.sparkContext.applicationId}", tempfile.mkdtemp(prefix="leafgrid-"))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when it ends."""
    name = spark.sparkContext.applicationId
    if name not in _folders:
        path = _folders[name] = f"{shared_dir(spark)}/leafgrid-{uuid.uuid4().hex}"

        def ended() -> None:
            try:
                _delete(spark, path)
            except Exception:  # the session was stopped before
                _folders.pop(name, None)

        atexit.register(ended)
    return _folders[name]


_scopes: list[Tables] = []


class Tables:
    """Intermediate results as Parquet tables in the shared folder: they cut
    lineage, outlive executors, and later reads can leave columns out.

    What ``keep`` wrote is deleted when the block ends.  What ``result`` wrote
    the caller still reads: it is deleted with the block around this one or,
    without one, when the application ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.outer = spark, [], None

    def __enter__(self) -> Tables:
        self.outer = _scopes[-1] if _scopes else None
        _scopes.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scopes.remove(self)
        self.drop()

    def drop(self, latest: int = 0) -> None:
        """Deletes the tables so far, but for the ``latest``."""
        gone = self.paths[: len(self.paths) - latest]
        for path in gone:
            _delete(self.spark, path)
        self.paths = self.paths[len(gone) :]
        # lets Spark's cleaner find the shuffle files of finished steps
        self.spark._jvm.System.gc()

    def _write(self, df: DataFrame, paths: list[str]) -> DataFrame:
        paths.append(f"{_own_folder(self.spark)}/{uuid.uuid4().hex}")
        df.write.parquet(paths[-1])
        return self.spark.read.schema(df.schema).parquet(paths[-1])

    def keep(self, df: DataFrame) -> DataFrame:
        return self._write(df, self.paths)

    def result(self, df: DataFrame) -> DataFrame:
        return self._write(df, self.outer.paths if self.outer else [])


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under own names, so that no other column can clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def matching(df: DataFrame, column: str, ids: DataFrame, how: str, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``df`` with (``left_semi``) or without (``left_anti``) their
    ``column`` in the one column of ``ids``, which must be distinct.  The ids
    are broadcast if their counted bytes are within ``bound``; otherwise the
    join shuffles.  Null matches null."""
    ids = ids.toDF("_match")
    size = ids.agg(F.coalesce(F.sum(16 + F.coalesce(F.octet_length(F.col("_match").cast("string")), F.lit(0))), F.lit(0))).first()[0]
    if size <= bound:
        ids = F.broadcast(ids)
    return df.join(ids, df[f"`{column}`"].eqNullSafe(ids["_match"]), how)


def held_out(ids: Column) -> Column:
    """Rows whose labels no model may learn from: crc32(id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int, tables: Tables, room: int = SAMPLE_BYTES) -> DataFrame:
    """(id, text, label) of labelled documents that are not held out: one row
    for each of ``bound`` ids at most, ``room`` bytes of text together at most.

    Taken are the ids that come first in the order of a hash; of rows that
    repeat an id the one whose text has the smallest hash; of several labels
    the largest.  Rows without an id or label are left out.  The sample is a
    table of ``tables``."""
    usable = only(labels, id=id_col, label=label_col).filter("id is not null and label is not null")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = usable.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")).orderBy(*order).limit(bound)
    # the bound on ids is also the bound of what is broadcast
    found = only(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("best")
    sample = tables.keep(found.groupBy("id", "label").agg(one).select("id", F.col("best.text").alias("text"), "label"))
    # ``bound`` rows of (id, size) at most
    sizes = sample.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    within = sizes.withColumn("all", F.sum("size").over(Window.orderBy(*order))).filter(F.col("all") <= room).select("id")
    return sample.join(F.broadcast(within), "id", "left_semi")
