"""Exact de-duplication by a Grace hash join of a table with itself.

Records are dealt by a hash of their normalised text (the shuffle is the first
partitioning).  Each task feeds its records to an open-addressing table that
compares complete contents; when the distinct contents outgrow the memory
bound, records go to spill files by further hash bits, and each file is treated
the same way again.  Tasks combine equal texts before the shuffle, so a text
that a third of all rows share is sent once per task, not once per row.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only

MEMORY = 64 << 20
FAN = 16
_BITS = 4


def normalised(column: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased as bytes; null becomes empty."""
    return pc.ascii_lower(column.cast(pa.large_string()).fill_null("")).cast(pa.large_binary())


class OpenTable:
    """Linear-probing table of distinct contents; each keeps its best row and
    the number of rows met."""

    def __init__(self, better: Callable[[tuple, tuple], bool]) -> None:
        self.better = better
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.sizes: list[int] = []
        self.rows: list[tuple] = []
        self.held = 0

    def place(self, h: int, content: bytes) -> tuple[int, int]:
        """The slot where a content is or belongs, and its entry (-1: none)."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0 and not (self.hashes[entry] == h and self.contents[entry] == content):
            at = at + 1 & mask
        return at, entry

    def add(self, h: int, content: bytes, n: int, row: tuple) -> None:
        at, entry = self.place(h, content)
        if entry >= 0:
            self.sizes[entry] += n
            if self.better(row, self.rows[entry]):
                self.rows[entry] = row
            return
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.sizes.append(n)
        self.rows.append(row)
        self.held += 2 * len(content) + 400
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for entry, h in enumerate(self.hashes):
                at = h & mask
                while self.slots[at] >= 0:
                    at = at + 1 & mask
                self.slots[at] = entry


class _Better:
    """Whether a row goes before another with an equal text: the largest id,
    null last; of equal ids the one whose original text is smallest."""

    def __init__(self, id_at: int, text_at: int) -> None:
        self.id_at, self.text_at = id_at, text_at

    def __call__(self, new: tuple, old: tuple) -> bool:
        one, two = new[self.id_at], old[self.id_at]
        if one != two:
            return two is None or (one is not None and one > two)
        return (new[self.text_at] or "") < (old[self.text_at] or "")


def _records(batch: pa.RecordBatch, text_at: int, hash_of: Callable[[bytes], int]) -> Iterator[tuple[int, bytes, tuple]]:
    columns = [column.to_pylist() for column in batch.columns]
    for content, *row in zip(normalised(batch.column(text_at)).to_pylist(), *columns, strict=True):
        yield hash_of(content), content, tuple(row)


def _batches(rows: Iterator[tuple], schema: pa.Schema, room: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (a size in bytes first) as record batches of about ``room``."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight
        if size >= room:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _digest(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _combine(id_at: int, text_at: int, memory: int, hash_of: Callable[[bytes], int]):
    """Before the shuffle: equal texts of a task as one record (h, n, row)."""
    better = _Better(id_at, text_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, schema = OpenTable(better), None
        for batch in batches:
            schema = schema or pa.schema([("h", pa.int64()), ("n", pa.int64()), *zip(batch.schema.names, batch.schema.types, strict=True)])
            for h, content, row in _records(batch, text_at, hash_of):
                table.add(h, content, 1, row)
                if table.held > memory:
                    yield from _batches(((len(c), (_signed(x), n, *r)) for x, c, n, r in zip(table.hashes, table.contents, table.sizes, table.rows, strict=True)), schema)
                    table = OpenTable(better)
        if schema is not None:
            yield from _batches(((len(c), (_signed(x), n, *r)) for x, c, n, r in zip(table.hashes, table.contents, table.sizes, table.rows, strict=True)), schema)

    return run


def _grace(id_at: int, text_at: int, memory: int):
    """After it: records (h, n, row) of a partition to one row for each text."""
    better = _Better(id_at, text_at)

    def grouped(batches: Iterator[pa.RecordBatch], shift: int, folder: Path) -> Iterator[tuple]:
        table, files, writers, schema = OpenTable(better), [], [], None
        for batch in batches:
            schema = batch.schema
            if not writers:
                columns = [c.to_pylist() for c in batch.columns]
                for content, h, n, *row in zip(normalised(batch.column(text_at + 2)).to_pylist(), *columns, strict=True):
                    table.add(h & (1 << 64) - 1, content, n, tuple(row))
                if table.held > memory and len(table.hashes) > 1 and shift < 64:
                    files = [folder / f"{shift}-{k}" for k in range(FAN)]
                    writers = [pa.ipc.new_stream(str(f), schema) for f in files]
                    for part in _batches(((len(c), (_signed(x), n, *r)) for x, c, n, r in zip(table.hashes, table.contents, table.sizes, table.rows, strict=True)), schema):
                        _deal(part, writers, shift)
                    table = OpenTable(better)
            else:
                _deal(batch, writers, shift)
        for writer in writers:
            writer.close()
        for content, n, row in zip(table.contents, table.sizes, table.rows, strict=True):
            yield len(content), (hashlib.sha256(content).hexdigest(), n, *row)
        for k, file in enumerate(files):
            with pa.ipc.open_stream(str(file)) as reader:
                below = folder / f"{shift}-{k}-in"
                below.mkdir()
                yield from grouped(iter(reader), shift + _BITS, below)
            file.unlink()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("text_sha256", pa.string()), ("group_size", pa.int64()), *list(zip(first.schema.names, first.schema.types, strict=True))[2:]])

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            yield from _batches(grouped(every(), 0, Path(folder)), schema)

    return run


def _deal(batch: pa.RecordBatch, writers: list, shift: int) -> None:
    # the shuffle uses another hash of h, so all its bits still vary here
    part = batch.column(0).to_numpy().view("uint64") >> shift & (FAN - 1)
    for k, writer in enumerate(writers):
        some = batch.filter(pa.array(part == k))
        if len(some):
            writer.write_batch(some)


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, hash_of: Callable[[bytes], int] = _digest) -> DataFrame:
    """One row of ``docs`` for each distinct text, after ``text_sha256`` and
    ``group_size``: the row with the largest id, all its columns as they were.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.
    A null id is below all others; of rows that repeat an id and a text one
    stays.  Columns of any name and type pass through unchanged; if one is
    named like an added column, the added ones still come first.  An empty
    table gives an empty result.  ``memory`` bounds the distinct contents that
    a task holds at once.
    """
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    fields = plain.schema.fields
    sent = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), *fields])
    back = T.StructType([T.StructField("text_sha256", T.StringType()), T.StructField("group_size", T.LongType()), *fields])
    records = plain.mapInArrow(_combine(id_at, text_at, memory, hash_of), sent)
    return records.repartition("h").mapInArrow(_grace(id_at, text_at, memory), back).toDF("text_sha256", "group_size", *names)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [hashlib.sha256(x.as_py()).hexdigest() for x in normalised(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["id", "sha"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row for each row of ``docs``: (id_col, keep_id, group_size, kept,
    text_sha256), by the rules of ``distinct_texts``.

    Of rows that repeat both the id and the text exactly one is kept.  A group
    whose ids are all null has a null keep_id and keeps one row.  Columns other
    than the two named are ignored.  An empty table gives an empty result.
    """
    source = only(docs, id=id_col, text=text_col)
    groups = distinct_texts(source, "id", "text", memory).select(F.col("text_sha256").alias("sha"), F.col("id").alias("keep_id"), "group_size")
    kind = source.schema["id"].dataType.simpleString()
    copies = source.mapInArrow(_fingerprints, f"id {kind}, sha string").groupBy("sha", "id").agg(F.count("*").cast("int").alias("copies"))
    rows = copies.join(groups, "sha").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text, see ``distinct_texts``."""
    kept = distinct_texts(docs, id_col, text_col)
    numbered = kept.toDF(*(f"c{k}" for k in range(len(kept.columns))))
    return numbered.select(*(f"c{k}" for k in range(2, len(kept.columns)))).toDF(*docs.columns)
