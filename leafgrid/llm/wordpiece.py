"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest piece that starts a word, then
the longest that starts the rest, and so on.  A trie of all pieces with failure
links does this in one pass over a word's characters: where a node has no child
for the next character, the pieces that greedy matching would have taken by
then are popped and matching goes on at the failure link.  Only their number is
stored with each node, so pieces are never built.

The automaton runs over the distinct words of a block, all of them in step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .common import only

#: Marks the beginning of a word in the vocabulary.
MARK = "▁"
_SPACES = (9, 10, 11, 12, 13, 32)


@dataclass
class Counter:
    """``codes``: sorted code points of the pieces; ``moves``: sorted keys
    node * len(codes) + character, ``to`` their targets; for each node its
    failure link, the pieces popped on the way there, and all pieces popped if
    the word ends here."""

    codes: np.ndarray
    moves: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    closing: np.ndarray

    def _child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node * len(self.codes) + char
        at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
        return np.where(self.moves[at] == key, self.to[at], -1)

    def count(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word ``text[start:end]`` (code points), each read
        with the mark before it.  A character that no piece has counts as many
        tokens as it has UTF-8 bytes."""
        total, node = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        size = end - start
        order = np.argsort(-size, kind="stable")
        first = start[order]
        longest = int(size.max(initial=0))
        running = np.searchsorted(-size[order], -np.arange(longest), side="left")
        for at in range(-1, longest):
            n = running[at] if at >= 0 else len(first)
            code = text[first[:n] + at] if at >= 0 else np.full(n, ord(MARK), text.dtype)
            char = np.searchsorted(self.codes, code)
            char[char == len(self.codes)] = 0
            strange = self.codes[char] != code
            odd = np.flatnonzero(strange)
            if len(odd):
                point = code[odd].astype(np.int64)
                total[odd] += self.closing[node[odd]] + 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
                node[odd] = 0
            live = np.flatnonzero(~strange)
            while len(live):
                now = node[live]
                child = self._child(now, char[live])
                done = child >= 0
                node[live[done]] = child[done]
                live, now = live[~done], now[~done]
                total[live] += self.popped[now]
                node[live] = self.fail[now]
        total += self.closing[node]
        out = np.empty_like(total)
        out[order] = total
        return out


def build(pieces: Iterable[str]) -> Counter:
    """The automaton of a vocabulary.  Each character of a piece that is not a
    piece itself stands for its UTF-8 bytes, so that every word is covered."""
    known = {p for p in pieces if p}
    value = {c: 1 if c in known else len(c.encode()) for c in {c for p in known for c in p}}
    children: list[dict[str, int]] = [{}]
    worth = [0]  # of nodes that are pieces: the tokens they stand for
    for piece in sorted(known | set(value)):
        node = 0
        for c in piece:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                worth.append(0)
            node = children[node][c]
        worth[node] = value[piece] if len(piece) == 1 else 1
    fail, popped, closing = [0] * len(children), [0] * len(children), [0] * len(children)
    level = [0]
    while level:
        below = []
        for node in level:
            for c, child in children[node].items():
                below.append(child)
                if worth[child]:
                    fail[child], popped[child] = 0, worth[child]
                else:
                    # the node above has no piece ending here: pop until c fits
                    at, n = fail[node], popped[node]
                    while c not in children[at]:
                        n += popped[at]
                        at = fail[at]
                    fail[child], popped[child] = children[at][c], n
                closing[child] = popped[child] + closing[fail[child]]
        level = below
    codes = np.array(sorted(map(ord, value)) or [0], np.uint32)
    number = {chr(code): k for k, code in enumerate(codes.tolist())}
    moves = sorted((node * len(codes) + number[c], child) for node, own in enumerate(children) for c, child in own.items()) or [(-1, 0)]
    return Counter(codes, *(np.array(x, np.int64) for x in (*zip(*moves, strict=True), fail, popped, closing)))


def sentencepiece_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


def count_block(counter: Counter, block: ts.Block) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text of a block."""
    start, end, bounds = ts.words(block)
    h = ts.span_hash(block, start, end)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    text = np.frombuffer(block.body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    blank = np.isin(text, np.array(_SPACES, np.uint32))
    first, last = ts.spans(~blank)
    pieces = counter.count(text, first[one], last[one])
    return np.diff(bounds), ts.sums(pieces[which], bounds)


def _counts(counter: Counter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in ts.blocks(batch.column(1)):
                words, pieces = count_block(counter, block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(pieces)], ["id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: Iterable[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_words, n_tokens).

    Words are runs of anything but ASCII white space; each is read with the
    mark U+2581 before it and split greedily into the longest of ``pieces``.
    Characters no piece has count as many tokens as they have UTF-8 bytes.
    Null and empty texts have 0 words and tokens.  Null ids and repeated rows
    are counted like others; other columns are ignored.  An empty table gives
    an empty result.  The vocabulary travels with the tasks; its size is fixed.
    """
    source = only(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_counts(build(pieces)), f"id {kind}, n_words bigint, n_tokens bigint").withColumnRenamed("id", id_col)
