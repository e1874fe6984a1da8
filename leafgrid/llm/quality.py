"""Quality scores by histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled documents,
whose statistics the executors compute; they are complete binary trees kept as
flat arrays, which executors walk for a whole block of documents and all trees
at once.  Scoring is one pass over the texts without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import Tables, held_out, labelled_sample, only
from .textstats import document_features, measure

#: Labelled documents used at most, and the score from which label 1 is predicted.
SAMPLE, CUT = 8000, 0.3


@dataclass
class Trees:
    """``feature`` and ``limit``: for each tree the inner nodes level by level
    (children of i at 2i + 1 and 2i + 2; a value over the limit goes to the
    latter); ``leaf``: its leaves from left to right."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.limit[tree, at])
        raw = self.base + self.leaf[tree, at - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, ridge: float = 2.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are sought over
    histograms of ``bins`` quantile bins.  With no rows or a single label the
    score is a constant."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if n == 0 or y.min() == y.max():
        return Trees(model.base, model.feature[:1], model.limit[:1], model.leaf[:1])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    raw = np.full(n, model.base)
    offsets = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            cells = 2**level
            slot = ((node * width * bins)[:, None] + offsets + code).reshape(-1)
            left_g, left_h = (np.bincount(slot, np.repeat(v, width), cells * width * bins).reshape(cells, width, bins).cumsum(2) for v in (g, h))
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (right_h < least)] = 0
            best = gain.reshape(cells, -1).argmax(1)
            good = gain.reshape(cells, -1).max(1) > 1e-6
            feature, cut = best // bins, best % bins
            for c in np.flatnonzero(good):
                if cut[c] < len(edges[feature[c]]):
                    model.feature[t, cells - 1 + c] = feature[c]
                    model.limit[t, cells - 1 + c] = edges[feature[c]][cut[c]]
            limit = model.limit[t, cells - 1 : 2 * cells - 1]
            node = 2 * node + (x[np.arange(n), model.feature[t, cells - 1 + node]] > limit[node])
        total_g, total_h = (np.bincount(node, v, leaves) for v in (g, h))
        model.leaf[t] = -rate * total_g / (total_h + ridge)
        raw += model.leaf[t][node]
    return model


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, block in ts.blocks(batch.column(0)):
            rows = document_features(measure(block))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo)], ["x", "label"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from ``sample`` labelled documents at most, none held out."""
    with Tables(docs.sparkSession) as tables:
        chosen = labelled_sample(docs, labels, id_col, text_col, label_col, sample, tables).select("text", F.col("label").cast("double").alias("label"))
        rows = chosen.mapInArrow(_statistics, "x array<double>, label double").collect()
    rows.sort(key=lambda r: (r.label, r.x))  # the order of tasks must not matter
    x = np.array([r.x for r in rows]) if rows else np.zeros((0, 1))
    return fit(x, np.array([float(r.label >= 1) for r in rows]))


def _scores(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in ts.blocks(batch.column(1)):
                made = model.score(document_features(measure(block)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(made)], ["id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row for each row of ``docs``: (id_col, held_out, score, predicted).

    ``score`` is the estimated probability of label 1, from the text alone.
    Null texts count as empty, and empty texts are scored as such (all counts
    0).  A null id is not held out.  Repeated rows get equal scores.  Other
    columns are ignored.  Without usable labels the score is 0.5 throughout;
    an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    source = only(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(_scores(model), f"id {kind}, score double")
    return made.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _passing(model: Trees, text_at: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(document_features(measure(block))) >= cut for _, _, block in ts.blocks(batch.column(text_at))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return run


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``cut`` or more."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(_passing(model, names.index(text_col), cut), plain.schema).toDF(*names)
