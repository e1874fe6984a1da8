"""Counts over lines and documents that several models use as features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import textscan as ts

LOWERCASE, UPPERCASE, DIGIT, BLANK, FEED, SYMBOL, PIPE, BANG, STOP, PUNCT, LEAD, TAIL, OTHER = range(13)
CLASSES = 16
CLASS = np.full(256, OTHER, np.uint8)
for _class, _bytes in (
    (LOWERCASE, range(97, 123)),
    (UPPERCASE, range(65, 91)),
    (DIGIT, range(48, 58)),
    (BLANK, (9, 11, 12, 13, 32)),
    (FEED, (10,)),
    (PUNCT, b"\"'()+-/:;=@[\\]^_`{}~"),
    (SYMBOL, b"#*$%&<>"),
    (PIPE, b"|"),
    (BANG, b"!?"),
    (STOP, b".,"),
    (TAIL, range(128, 192)),
    (LEAD, range(192, 256)),
):
    CLASS[list(_bytes)] = _class

WINDOW = 8


@dataclass
class Measured:
    """Of a block: per line ``classes`` (characters of each class), ``words``
    (bounds of its words), ``again`` (has a word and equals an earlier line of
    its text), ``caps`` (words without lower-case letters); per word its length
    in characters and whether it lies in a repeated window; ``line_bounds`` and
    ``word_bounds`` of the texts."""

    classes: np.ndarray
    words: np.ndarray
    again: np.ndarray
    caps: np.ndarray
    length: np.ndarray
    repeated: np.ndarray
    hashes: np.ndarray
    line_bounds: np.ndarray
    word_bounds: np.ndarray


def repeated_words(h: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each word whether it lies in a run of ``width`` words that its text
    has twice or more."""
    runs = ts.window_hash(h, width)
    mark = np.zeros(len(h) + 1, np.int32)
    for a, z in zip(bounds[:-1].tolist(), (bounds[1:] - width + 1).tolist(), strict=True):
        if z - a < 2:
            continue
        own = runs[a:z]
        ordered = np.sort(own)
        same = ordered[1:] == ordered[:-1]
        if same.any():
            twice = ordered[1:][same]
            twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
            at = np.searchsorted(twice, own)
            at[at == len(twice)] = 0
            found = np.flatnonzero(twice[at] == own) + a
            mark[found] += 1
            mark[found + width] -= 1
    return np.cumsum(mark[:-1]) > 0


def measure(block: ts.Block) -> Measured:
    start, end, word_bounds = ts.words(block)
    line_start, line_end, line_bounds = ts.lines(block)
    kinds = CLASS[block.body]
    # a line's own feed counts as its last byte
    owner = np.repeat(np.arange(len(line_start), dtype=np.int64) * CLASSES, line_end - line_start + 1)
    classes = np.bincount(owner + kinds, minlength=len(line_start) * CLASSES).reshape(-1, CLASSES)
    words = np.searchsorted(start, np.append(line_start, len(kinds)))

    spoken = words[1:] > words[:-1]
    shape = ts.span_hash(block, line_start, line_end)
    text = ts.owners(line_bounds).astype(np.uint64)
    key = ts.mix(shape ^ ts.mix(text + np.uint64(0x1234567)))
    order = np.flatnonzero(spoken)
    order = order[np.argsort(key[order], kind="stable")]
    again = np.zeros(len(line_start), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]

    h = ts.span_hash(block, start, end)
    lead = np.concatenate([np.zeros(1, np.int64), np.cumsum(kinds != TAIL, dtype=np.int64)])
    small = np.concatenate([np.zeros(1, np.int64), np.cumsum((kinds == LOWERCASE) | (kinds == LEAD), dtype=np.int64)])
    big = np.concatenate([np.zeros(1, np.int64), np.cumsum(kinds == UPPERCASE, dtype=np.int64)])
    shouted = (small[end] == small[start]) & (big[end] - big[start] >= 2)
    return Measured(classes, words, again, ts.sums(shouted, words), lead[end] - lead[start], repeated_words(h, word_bounds), h, line_bounds, word_bounds)


LINE_FEATURES = 14


def line_features(m: Measured) -> np.ndarray:
    """One row for each line; all values are bounded."""
    n = np.diff(m.words).astype(np.float64)
    c = m.classes.astype(np.float64)
    seen = np.maximum(1.0, c.sum(1) - c[:, FEED] - c[:, BLANK] - c[:, TAIL])
    each = np.maximum(1.0, n)
    return np.stack(
        [
            np.log1p(n) / 5,
            np.minimum(ts.sums(m.length, m.words) / each, 30) / 10,
            c[:, UPPERCASE] / seen,
            c[:, DIGIT] / seen,
            c[:, SYMBOL] / seen,
            c[:, PIPE] / seen,
            c[:, BANG] / seen,
            c[:, STOP] / seen,
            c[:, PUNCT] / seen,
            c[:, LEAD] / seen,
            m.caps / each,
            ts.sums(m.repeated, m.words) / each,
            m.again.astype(np.float64),
            (n == 0).astype(np.float64),
        ],
        1,
    )


DOCUMENT_FEATURES = 22


def document_features(m: Measured) -> np.ndarray:
    """One row for each text."""
    n = np.diff(m.word_bounds).astype(np.float64)
    each = np.maximum(1.0, n)
    lines = np.diff(m.line_bounds).astype(np.float64)
    c = np.stack([ts.sums(m.classes[:, k], m.line_bounds) for k in range(CLASSES)], 1).astype(np.float64)
    seen = np.maximum(1.0, c.sum(1) - c[:, FEED] - c[:, BLANK] - c[:, TAIL])
    distinct = np.zeros(len(n))
    for k, (a, z) in enumerate(zip(m.word_bounds[:-1].tolist(), m.word_bounds[1:].tolist(), strict=True)):
        own = np.sort(m.hashes[a:z])
        distinct[k] = 1 + np.count_nonzero(own[1:] != own[:-1]) if z > a else 0
    length = m.length.astype(np.float64)
    mean = ts.sums(length, m.word_bounds) / each
    spoken = np.diff(m.words) > 0
    tabular = m.classes[:, PIPE] > 0
    return np.stack(
        [
            np.log1p(n),
            mean,
            np.sqrt(np.maximum(0, ts.sums(length * length, m.word_bounds) / each - mean**2)),
            c[:, UPPERCASE] / seen,
            c[:, DIGIT] / seen,
            c[:, SYMBOL] / seen,
            c[:, PIPE] / seen,
            c[:, BANG] / seen,
            c[:, STOP] / seen,
            c[:, PUNCT] / seen,
            c[:, LEAD] / seen,
            c[:, OTHER] / seen,
            ts.sums(m.caps, m.line_bounds) / each,
            ts.sums(m.repeated, m.word_bounds) / each,
            ts.sums(m.again, m.line_bounds) / np.maximum(1, ts.sums(spoken, m.line_bounds)),
            distinct / each,
            distinct / np.sqrt(each),
            n / np.maximum(1.0, lines),
            ts.sums(m.length <= 3, m.word_bounds) / each,
            ts.sums(m.length >= 12, m.word_bounds) / each,
            ts.sums(tabular, m.line_bounds) / lines,
            np.log1p(lines),
        ],
        1,
    )
