"""Toxic spans by a linear-chain conditional random field over tokens.

Tokens are runs of letters, lower-cased; a line is a sequence.  Types are whole
tokens and stems, their first letters.  Labels exist for documents only, so
tokens are labelled from them: a type is an offence if labelled toxic documents
have it significantly more often than not, and its occurrences in toxic
documents are the positive tokens.  The field has a weight for each of the
types that tell the two kinds apart, one for all others, and the transitions.  Forward-backward marginals give the spans; a
document's score is a logistic function of its marginals.
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
from .common import Tables, held_out, labelled_sample, only

#: Labelled documents used at most, token types with a weight of their own at
#: most, clean documents for each toxic one that the field's weights are fitted
#: on, the marginal from which a token belongs to a span, and the score from
#: which a document is predicted toxic.
SAMPLE, TYPES, CONTRAST, TAGGED, CUT = 6000, 2048, 2.0, 0.5, 0.5
#: Bytes of a token's stem.
STEM = 4
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class ToxicModel:
    """``types``: sorted hashes with a weight; ``weights[i]`` belongs to the
    i-th, the last one to all others."""

    types: np.ndarray
    weights: np.ndarray
    chain: crf.Chain
    calibration: np.ndarray

    def tag(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        score = sum(self.weights[_numbers(self.types, hashes[:, k])] for k in (0, 1))
        return crf.marginals(score, bounds, self.chain)

    def score(self, marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = _summary(marginal, bounds)
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + x @ self.calibration[1:], -30, 30)))


def _numbers(types: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in ``types``; their number where it is missing."""
    if not len(types):
        return np.zeros(len(hashes), np.int64)
    low = np.zeros(1 << 16, bool)  # most tokens are none of the types
    low[(types & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(hashes), len(types), np.int64)
    maybe = np.flatnonzero(low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(types, hashes[maybe])
    at[at == len(types)] = 0
    hit = types[at] == hashes[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _summary(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Features of a document: expected number of toxic tokens, and the
    largest marginal."""
    top = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        top[full] = np.maximum.reduceat(marginal, bounds[full])
    clear = np.where(marginal > 0.01, marginal, 0.0)
    return np.stack([np.log1p(ts.sums(clear, bounds)), top], 1)


def tokens(block: ts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the letter runs, hashes of each and of its stem, the
    bounds of lines in them and the bounds of texts."""
    start, end = ts.spans(_LETTER[block.body])
    low = block.lowered()
    stem = ts.span_hash(low, start, np.minimum(end, start + STEM))
    h = np.stack([ts.span_hash(low, start, end), ts.mix(stem ^ np.uint64(0x57E3))], 1)
    line_start, _, _ = ts.lines(block)
    return start, end, h, np.searchsorted(start, np.append(line_start, len(block.body))), np.searchsorted(start, block.first)


def fit(hashes: list[np.ndarray], lines: list[np.ndarray], toxic: np.ndarray, types: int = TYPES, rounds: int = 40, contrast: float = CONTRAST) -> ToxicModel:
    """A model of documents' token hashes, the line bounds in them, and labels.

    Types are chosen and scores calibrated on all documents; the field's
    weights are fitted on all toxic ones and, as those of clean documents
    change little with their number, on ``contrast`` times as many clean ones
    (200 at least), spread evenly over the documents, which ``train`` puts in
    the order of a hash of their ids."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    nothing = ToxicModel(np.zeros(0, np.uint64), np.full(1, -30.0), crf.Chain(), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if not len(toxic) or toxic.min() == toxic.max():
        return nothing
    # each neighbourhood (token before, type) counts once for either label, so
    # that copies of a toxic text don't make offences of its rare words
    found, in_toxic, in_all = _contexts(hashes, toxic)
    share = in_toxic.sum() / in_all.sum()
    rate = in_toxic / in_all
    surplus = (in_toxic - in_all * share) / np.sqrt(in_all * share * (1 - share))
    offence = (in_toxic >= 4) & (rate >= 0.5) & (surplus >= 5)
    # the strongest types of either direction, offences first
    order = np.lexsort((found, -np.abs(surplus), ~offence))
    chosen = order[:types]
    chosen = np.sort(chosen[(in_all[chosen] >= 4) & (np.abs(surplus[chosen]) >= 3)])
    vocabulary = found[chosen]
    if not offence.any():
        return nothing
    clean = np.flatnonzero(~toxic)
    clean = clean[np.unique(np.linspace(0, len(clean) - 1, max(200, int(contrast * toxic.sum()))).astype(int))]
    drawn = np.sort(np.concatenate([np.flatnonzero(toxic), clean])).tolist()
    flat, sizes, _, bounds = _joined([hashes[k] for k in drawn], [lines[k] for k in drawn])
    number = [_numbers(vocabulary, flat[:, k]).astype(np.int32) for k in (0, 1)]
    del flat
    strong = np.append(offence[chosen], False)
    bad = (strong[number[0]] | strong[number[1]]) & np.repeat(toxic[drawn], sizes)
    width = len(vocabulary) + 1
    weights, chain = crf.fit(lambda w: w[number[0]] + w[number[1]], lambda e: np.bincount(number[0], e, width) + np.bincount(number[1], e, width), width, bad, bounds, rounds, rate=0.5, ridge=1e-7)
    del number, bad
    model = ToxicModel(vocabulary, weights, chain, np.zeros(3))
    parts = []
    for lo in range(0, len(hashes), 256):
        flat, _, first, bounds = _joined(hashes[lo : lo + 256], lines[lo : lo + 256])
        parts.append(_summary(model.tag(flat, bounds), first))
    model.calibration = _logistic(np.concatenate(parts), toxic)
    return model


def _contexts(hashes: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Types, and in how many neighbourhoods each is in toxic and in all texts."""
    kinds = []
    for mark in (True, False):
        parts = [h for h, t in zip(hashes, toxic, strict=True) if t == mark and len(h)]
        before = [np.concatenate([np.zeros(1, np.uint64), h[:-1, 0]]) for h in parts]
        kind = np.concatenate([h.reshape(-1) for h in parts]) if parts else np.zeros(0, np.uint64)
        key = ts.mix(np.repeat(np.concatenate(before), 2) if parts else kind) ^ kind
        kinds.append(kind[np.unique(key, return_index=True)[1]])
    found, at = np.unique(np.concatenate(kinds), return_inverse=True)
    in_toxic = np.bincount(at[: len(kinds[0])], minlength=len(found)).astype(float)
    return found, in_toxic, np.bincount(at, minlength=len(found)).astype(float)


def _joined(hashes: list[np.ndarray], lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashes, the documents' sizes and bounds, and the bounds of lines."""
    sizes = np.array([len(h) for h in hashes])
    first = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(hashes), sizes, first, np.unique(np.concatenate([first, *(line + lo for line, lo in zip(lines, first, strict=False))]))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method, slightly shrunk."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 0.5, 0.5])
        w = w + np.linalg.solve(hessian, z.T @ (y - p) - np.array([1e-3, 0.5, 0.5]) * w)
    return w


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, block in ts.blocks(batch.column(0)):
            _, _, h, lines, texts = tokens(block)
            rows = [h[a:z].tobytes() for a, z in zip(texts[:-1], texts[1:], strict=True)]
            inner = [np.unique(lines[(lines >= a) & (lines <= z)] - a).astype(np.int64).tobytes() for a, z in zip(texts[:-1], texts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(inner, pa.binary()), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], ["h", "lines", "label", "draw"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """A model of ``sample`` labelled documents at most, and their bytes as
    ``labelled_sample`` bounds them, none held out."""
    with Tables(docs.sparkSession) as tables:
        chosen = labelled_sample(docs, labels, id_col, text_col, label_col, sample, tables).select("text", F.col("label").cast("double").alias("label"), F.xxhash64("id").alias("draw"))
        made = chosen.mapInArrow(_token_rows, "h binary, lines binary, label double, draw bigint")
        rows = sorted((r.draw, bytes(r.h), bytes(r.lines), r.label) for r in made.collect())
    return fit([np.frombuffer(h, np.uint64).reshape(-1, 2) for _, h, _, _ in rows], [np.frombuffer(x, np.int64) for _, _, x, _ in rows], np.array([label >= 1 for *_, label in rows], bool))


def _tagged(model: ToxicModel, tagged: float):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in ts.blocks(batch.column(1)):
                start, end, h, lines, texts = tokens(block)
                p = model.tag(h, lines)
                score = model.score(p, texts)
                # neighbouring tagged tokens of a line make one span
                hit = np.flatnonzero(p >= tagged)
                line = np.searchsorted(lines, hit, side="right")
                fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (line[1:] != line[:-1])]) if len(hit) else np.zeros(0, bool)
                opens = np.flatnonzero(fresh)
                a, z = start[hit[opens]], end[hit[np.append(opens[1:], len(hit)) - 1]] if len(hit) else start[:0]
                text = np.searchsorted(block.first, a, side="right") - 1
                lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((block.body & 0xC0) != 0x80, dtype=np.int64)]) if len(a) else np.zeros(1, np.int64)
                base = lead[block.first[text]] if len(a) else a
                pairs = pa.StructArray.from_arrays([pa.array(lead[a] - base, pa.int64()), pa.array(lead[z] - base, pa.int64())], fields=list(span)) if len(a) else pa.array([], span)
                offsets = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.ListArray.from_arrays(offsets, pairs)], ["id", "score", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, cut: float = CUT, tagged: float = TAGGED) -> DataFrame:
    """One row for each row of ``docs``: (id_col, held_out, score, predicted,
    spans).  ``spans`` lists the offending stretches as (start, end) in
    characters of the text, end exclusive.

    Null texts count as empty; texts without letters have no spans and the
    score of a document without offences.  A null id is not held out; repeated
    rows get equal results; other columns are ignored.  Without labels of both
    kinds, or without any type that tells them apart, the score is the share of
    toxic labels.  An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    source = only(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(_tagged(model, tagged), f"id {kind}, score double, spans array<struct<start: bigint, end: bigint>>")
    return made.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")
