"""Quality rules: base counts, and a conditional random field over lines.

The field labels each line content or boilerplate from counts of its
characters and words; the most probable labelling of all lines of a text
(Viterbi) gives its share of content words, which decides retention.  No table
labels lines, so it learns from documents: every line of a document labelled
low quality counts as boilerplate, every other as content, and the transitions
settle what lines of both kinds share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from . import textscan as ts
from .common import Tables, labelled_sample, only
from .textstats import LINE_FEATURES, PIPE, SYMBOL, Measured, line_features, measure

#: Labelled documents used at most, and the least share of content words.
SAMPLE, SHARE = 3000, 0.5
MIN_WORDS, MAX_REPEATED = 20, 30


@dataclass
class LineModel:
    weights: np.ndarray
    chain: crf.Chain

    def boilerplate(self, m: Measured) -> np.ndarray:
        x = line_features(m)
        return crf.viterbi(x @ self.weights[1:] + self.weights[0], m.line_bounds, self.chain)


def fit(x: np.ndarray, label: np.ndarray, bounds: np.ndarray, rounds: int = 150) -> LineModel:
    """Documents of both kinds weigh the same in total; without both, every
    line is content."""
    if not len(x) or label.min() == label.max():
        return LineModel(np.concatenate([[-30.0], np.zeros(x.shape[1] if x.ndim == 2 else LINE_FEATURES)]), crf.Chain())
    middle, spread = x.mean(0), x.std(0) + 1e-3
    z = (x - middle) / spread
    owner = ts.owners(bounds)
    bad = label[bounds[:-1]]
    each = np.where(bad, 0.5 / max(1, bad.sum()), 0.5 / max(1, (~bad).sum())) * len(bad)
    own, chain = crf.fit(lambda w: w[0] + z @ w[1:], lambda e: np.concatenate([[e.sum()], e @ z]), 1 + z.shape[1], label, bounds, rounds, weight=each[owner] / np.diff(bounds)[owner])
    scaled = own[1:] / spread
    return LineModel(np.concatenate([[own[0] - middle @ scaled], scaled]), chain)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, block in ts.blocks(batch.column(0)):
            m = measure(block)
            x = line_features(m)
            rows = [x[a:z].tobytes() for a, z in zip(m.line_bounds[:-1], m.line_bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(lo, hi - lo)], ["x", "label"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> LineModel:
    """A model of ``sample`` labelled documents at most, none held out."""
    with Tables(docs.sparkSession) as tables:
        chosen = labelled_sample(docs, labels, id_col, text_col, label_col, sample, tables).select("text", F.col("label").cast("double").alias("label"))
        rows = sorted((r.label, bytes(r.x)) for r in chosen.mapInArrow(_line_rows, "x binary, label double").collect())
    parts = [np.frombuffer(x).reshape(-1, LINE_FEATURES) for _, x in rows]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    low = np.array([label < 1 for label, _ in rows], bool)
    return fit(np.concatenate(parts) if parts else np.zeros((0, LINE_FEATURES)), np.repeat(low, np.diff(bounds)), bounds)


def _judge(model: LineModel, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in ts.blocks(batch.column(1)):
                m = measure(block)
                n = np.diff(m.word_bounds)
                chars = ts.sums(m.length, m.word_bounds)
                symbols = ts.sums(m.classes[:, SYMBOL] + m.classes[:, PIPE], m.line_bounds)
                again, repeated = ts.sums(m.again, m.line_bounds), ts.sums(m.repeated, m.word_bounds)
                junk = model.boilerplate(m)
                content = ts.sums(np.where(junk, 0, np.diff(m.words)), m.line_bounds)
                lines = np.diff(m.line_bounds) - ts.sums(junk, m.line_bounds)
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
                part = content / np.maximum(1, n)
                columns = [n, chars, symbols, again, repeated, lines]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(part), pa.array(failed), pa.array(~failed & (part >= share))], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_lines", "content_share", "base_failed", "kept"])

    return run


def line_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_content_lines, content_share,
    base_failed, kept).

    Words are runs of anything but ASCII white space.  ``word_chars``: their
    characters; ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``:
    lines with a word that equal an earlier line; ``n_repeat_words``: words
    inside runs of 8 words that the text has at least twice.  ``base_failed``:
    under 20 words, or over 30 in 100 words repeated.  A row is kept if that is
    false and content lines have ``share`` of the words or more.

    A null text counts as empty: all counts 0, failed.  Null ids and repeated
    rows are judged like others; other columns are ignored.  Without labels of
    both kinds all lines are content.  An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    source = only(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_content_lines bigint"
    return source.mapInArrow(_judge(model, share), f"id {kind}, {counts}, content_share double, base_failed boolean, kept boolean").withColumnRenamed("id", id_col)
