"""Binary lists of nodes, elements and element corners, little-endian.

A file has a header of uint32 numbers, the number of records last, then the
records: of ``nodes`` the position as three uint32 and the number as int64; of
``elements`` (whose header starts with the depth) the position, level and number
as five int64; of ``corners`` the element's and its eight nodes' numbers as nine
int64.  There is one file for each partition; a file is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import mesh

KINDS: dict[str, np.dtype] = {
    "nodes": np.dtype([*((n, "<u4") for n in mesh.AT), ("node", "<i8")]),
    "elements": np.dtype([(n, "<i8") for n in (*K.AXES, "level", "element")]),
    "corners": np.dtype([(n, "<i8") for n in ("element", *(f"n{v}" for v in range(8)))]),
}


def element_rows(numbers: DataFrame, depth: int) -> DataFrame:
    """(x, y, z, level, element) of (level, prefix, element), positions in
    cells of full depth."""
    key = K.first_key(F.col("level"), F.col("prefix"), depth)
    return numbers.select(*(p.alias(a) for a, p in zip(K.AXES, K.position(key), strict=True)), F.col("level").cast("long").alias("level"), "element")


def corner_rows(numbered: DataFrame) -> DataFrame:
    """(element, n0, ..., n7) of ``mesh.numbered``."""
    return numbered.groupBy("element").agg(*(F.max(F.when(F.col("vertex") == v, F.col("node"))).alias(f"n{v}") for v in range(8)))


def encode(rows: DataFrame, kind: str, depth: int = 0) -> DataFrame:
    """(part, content): the content of one file for each partition of ``rows``;
    a partition without rows makes a file of no records."""
    record = KINDS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = [f.to_records(index=False).astype(record) for f in frames]
        head = ([depth] if kind == "elements" else []) + [sum(map(len, parts))]
        content = np.array(head, "<u4").tobytes() + b"".join(p.tobytes() for p in parts)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [content]})

    return rows.select(*record.names).mapInPandas(run, "part int, content binary")


def decode(files: DataFrame, kind: str) -> DataFrame:
    """The records, as longs, of files with the given ``content``.  A file
    without content has none; one cut short is an error."""
    record = KINDS[kind]
    skip = 8 if kind == "elements" else 4

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                n = int(np.frombuffer(content, "<u4", 1, skip - 4)[0]) if len(content) else 0
                if n:
                    data = np.frombuffer(content, record, n, skip)
                    yield pd.DataFrame({name: data[name].astype("<i8") for name in record.names})

    return files.select("content").mapInPandas(run, ", ".join(f"{n} bigint" for n in record.names))


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of all files at ``path``: reading several merges them."""
    return decode(spark.read.format("binaryFile").load(path), kind)
