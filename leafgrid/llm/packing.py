"""Bounded-space online packing of token sequences.

Every task keeps a fixed number of open windows.  A document's tokens are cut
into full windows and a remainder; the remainder goes into the open window it
fits most tightly; when none fits and no further window may be opened, the
fullest is topped up with the front of the remainder and emitted.  At the end
of the task the windows still open are merged by cutting, and what is left of
the last one is emitted in runs of a power of two, which need no padding.  One
pass over the texts; nothing is shuffled, collected or computed twice.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only

#: The split pattern and the special token of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}
WINDOW, OPEN, END = 1024, 64, 0


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """The byte-level BPE of a rank file's content."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


def encode(text: str, ranks: bytes, longest: int = 1 << 20) -> np.ndarray:
    """Token ids (uint32).  A text over ``longest`` characters is cut before
    blanks that follow a letter and precede one, where the split pattern
    always cuts, so the ids are those of the whole text."""
    own = encoder(ranks)
    if len(text) <= longest:
        return own.encode_to_numpy(text, allowed_special="all")
    parts, lo = [], 0
    while lo < len(text):
        hi = lo + longest
        while hi < len(text) - 1 and not (text[hi] == " " and text[hi - 1].isalpha() and text[hi + 1].isalpha()):
            hi += 1
        hi = hi if hi < len(text) - 1 else len(text)
        parts.append(own.encode_to_numpy(text[lo:hi], allowed_special="all"))
        lo = hi
    return np.concatenate(parts)


class Packer:
    """Places documents; ``done`` holds finished sequences, each a list of
    (document, start, length).  ``room`` is sorted by free space."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN) -> None:
        self.window, self.limit = window, open_windows
        self.room: list[tuple[int, int]] = []
        self.open: dict[int, list[tuple[int, int, int]]] = {}
        self.count = 0
        self.done: list[list[tuple[int, int, int]]] = []

    def add(self, doc: int, length: int) -> None:
        start = 0
        while length - start >= self.window:
            self.done.append([(doc, start, self.window)])
            start += self.window
        while start < length:
            left = length - start
            at = bisect.bisect_left(self.room, (left, -1))
            if at == len(self.room) and len(self.room) < self.limit:
                self.open[self.count] = []
                at = bisect.bisect_left(self.room, (self.window, self.count))
                self.room.insert(at, (self.window, self.count))
                self.count += 1
            # best fit, or else the fullest of all, which is then emitted
            free, key = self.room.pop(at if at < len(self.room) else 0)
            put = min(free, left)
            self.open[key].append((doc, start, put))
            start += put
            if put == free:
                self.done.append(self.open.pop(key))
            else:
                bisect.insort(self.room, (free - put, key))

    def finish(self) -> None:
        """Merges the open windows: the emptiest fill the fullest."""
        pieces = [piece for _, key in self.room for piece in self.open[key]]
        self.room, self.open = [], {}
        rest, free = [], self.window
        for doc, start, length in pieces:
            while length:
                put = min(free, length)
                rest.append((doc, start, put))
                start, length, free = start + put, length - put, free - put
                if not free:
                    self.done.append(rest)
                    rest, free = [], self.window
        size = self.window - free
        for bit in reversed(range(size.bit_length())):
            want, run = size & 1 << bit, []
            while want:
                doc, start, length = rest.pop(0)
                put = min(want, length)
                run.append((doc, start, put))
                want -= put
                if put < length:
                    rest.insert(0, (doc, start + put, length - put))
            if run:
                self.done.append(run)


def _pack(ranks: bytes, window: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        packer = Packer(window, open_windows)
        tokens: dict[int, np.ndarray] = {}  # of documents with pieces in open windows
        ids: dict[int, object] = {}
        rest: dict[int, int] = {}  # tokens of each that are not yet emitted
        number, id_type = 0, None

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for pieces in packer.done:
                offset = 0
                for doc, start, length in pieces:
                    own = tokens[doc]
                    rows.append((ids[doc], start, length, own[start : start + length].tobytes(), len(own), sequence, offset))
                    offset += length
                    rest[doc] -= length
                    if not rest[doc]:
                        del rest[doc], tokens[doc], ids[doc]
                sequence += 1
            packer.done = []
            for lo in range(0, len(rows), 4096):
                columns = list(zip(*rows[lo : lo + 4096], strict=True))
                kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.types[0]
            texts = batch.column(1)
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = np.append(encode(text.as_py() or "", ranks), np.uint32(END)).astype("<u4")
                tokens[number], ids[number], rest[number] = own, key, len(own)
                packer.add(number, len(own))
                number += 1
                if len(packer.done) >= 1024:
                    yield from emit()
            yield from emit()
        packer.finish()
        if id_type is not None:
            yield from emit()

    return run


def pack(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens:
    (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its text's ids by the byte-level BPE of the rank file at
    ``ranks_path`` (read once, by the driver), then id 0; ``ids`` holds a
    piece's ids as little-endian uint32.  Each id is in exactly one piece.
    Every sequence is full, but for at most log2(window) a task, which have a
    power of two of tokens.  ``sequence_id`` is unique, ``offset`` gapless.

    A null text counts as empty (one token, id 0).  Rows that repeat an id are
    packed each on its own; a null id stays null.  Other columns are ignored.
    An empty table gives an empty result.  Memory: one batch of texts and the
    tokens of documents in ``open_windows`` open windows.
    """
    source = only(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    ranks = Path(ranks_path).read_bytes()
    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return source.mapInArrow(_pack(ranks, window, open_windows), schema).withColumnRenamed("id", id_col)
