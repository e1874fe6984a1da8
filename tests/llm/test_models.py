"""Learned operators: brute force on small inputs, held-out accuracy on data."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafgrid.llm import crf, line_rules, quality, textscan, textstats, toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, id string, label string, score string"
TEXTS = [None, "", " \n\t ", "word", "a b\na b\n\na b", "x " * 30_000, "SHOUT!! | # $", "日本語 テキスト é", "one two three four five six seven eight nine " * 3]


def frame(spark, texts=TEXTS, ids=None):
    ids = [None, *range(1, len(texts))] if ids is None else ids
    return spark.createDataFrame([(i, t, "i", "l", "s") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(2)


def tables(spark):
    return (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))


def labels(spark, rows=()):
    return spark.createDataFrame([(i, q, t, "x") for i, q, t in rows], "doc_id bigint, quality int, toxic int, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    own, lines = words(text), [line for line in (text or "").split("\n") if words(line)]
    runs = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    twice = {r for r in runs if runs.count(r) > 1} if len(runs) < 500 else set(runs) - {r for r in set(runs) if runs.index(r) == len(runs) - 1 - runs[::-1].index(r)}
    covered = {i + k for i, r in enumerate(runs) if r in twice for k in range(8)}
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_are_those_of_brute_force(spark):
    docs, marks = tables(spark)
    some = [r.text for r in docs.orderBy("doc_id").limit(150).collect()] + TEXTS[:5] + TEXTS[6:]
    got = line_rules.line_verdicts(frame(spark, some, list(range(len(some)))), marks)
    for r in got.collect():
        want = base(some[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_line_rules_keep_good_documents_and_drop_poor_ones(spark):
    docs, marks = tables(spark)
    got = {r.doc_id: r for r in line_rules.line_verdicts(docs, marks).collect()}
    assert len(got) == docs.count()
    held = [r for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    fine = [got[r.doc_id].kept for r in held if r.quality == 1 and not got[r.doc_id].base_failed]
    poor = [got[r.doc_id].kept for r in held if r.quality == 0]
    assert np.mean(fine) > 0.95 and np.mean(poor) < 0.2


def every(score, chain):
    """(labels, weight) of all labellings of a sequence."""
    for y in itertools.product((0, 1), repeat=len(score)):
        w = sum(s for s, k in zip(score, y, strict=True) if k) + chain.start * y[0]
        w += sum({(0, 1): chain.t01, (1, 0): chain.t10, (1, 1): chain.t11}.get(p, 0) for p in itertools.pairwise(y))
        yield y, w


def test_chains_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(0, 8, 6)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        score, chain = rng.normal(0, 2, bounds[-1]), crf.Chain(*rng.normal(0, 1.5, 4))
        p, best = crf.marginals(score, bounds, chain), crf.viterbi(score, bounds, chain)
        for a, z in itertools.pairwise(bounds):
            if a == z:
                continue
            ways = list(every(score[a:z], chain))
            total = sum(np.exp(w) for _, w in ways)
            want = [sum(np.exp(w) for y, w in ways if y[k]) / total for k in range(z - a)]
            assert np.allclose(p[a:z], want)
            assert tuple(best[a:z].astype(int)) == max(ways, key=lambda x: x[1])[0]


def test_chain_learns_transitions():
    rng = np.random.default_rng(1)
    y = np.concatenate([np.repeat(rng.integers(0, 2, 5), 8) for _ in range(60)]).astype(bool)
    x = y + rng.normal(0, 1.0, len(y))
    bounds = np.arange(0, len(y) + 1, 40)
    w, chain = crf.fit(lambda t: t[0] + t[1] * x, lambda e: np.array([e.sum(), (e * x).sum()]), 2, y, bounds, 150)
    alone = (x > 0.5) == y
    assert (crf.viterbi(w[0] + w[1] * x, bounds, chain) == y).mean() > alone.mean() + 0.05


def test_flat_trees_are_walked_like_nested_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)

    def walk(row):
        raw = model.base
        for t in range(len(model.leaf)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.limit[t, node] else 1)
            raw += model.leaf[t, node - model.feature.shape[1]]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(model.score(x), [walk(r) for r in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_quality_separates_held_out_documents(spark):
    docs, marks = tables(spark)
    got = {r.doc_id: r for r in quality.quality_scores(docs, marks).collect()}
    assert len(got) == docs.count()
    held = [r for r in marks.collect() if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in marks.collect())
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_change_nothing(spark):
    docs, marks = tables(spark)
    spoilt = marks.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    small = docs.filter("doc_id < 60")
    for score in (lambda m: quality.quality_scores(docs, m), lambda m: toxicity.toxicity(docs, m)):
        a, b = (sorted((r.doc_id, round(r.score, 9)) for r in score(m).join(small.select("doc_id"), "doc_id", "left_semi").collect()) for m in (marks, spoilt))
        assert a == b


def test_dropping_low_quality_keeps_columns(spark):
    docs, marks = tables(spark)
    more = docs.selectExpr("*", "1 as score", "'a' as label", "2 as id")
    got = quality.drop_low_quality(more, marks)
    assert got.columns == more.columns
    scored = quality.quality_scores(docs, marks).filter("predicted = 1")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in scored.collect())


def test_toxicity_finds_held_out_documents_and_their_words(spark):
    docs, marks = tables(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    held = [r for r in marks.collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in held]) > 0.93
    clean = [got[r.doc_id].predicted for r in held if not r.toxic]
    assert np.mean(clean) < 0.03
    found = {text[i][s.start : s.end].lower() for i, r in got.items() for s in r.spans}
    assert found and all(re.fullmatch(r"[^\W\d_]+(\W+[^\W\d_]+)*", f) for f in found)


def test_fields_fitted_in_pieces_are_those_fitted_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=300), rng.random(300) < 0.3
    bounds = np.array([0, 0, 40, 41, 120, 250, 300])
    both = []
    for piece in (1000, 30):
        monkeypatch.setattr(crf, "PIECE", piece)
        w, chain = crf.fit(lambda t: t[0] + t[1] * x, lambda e: np.array([e.sum(), (e * x).sum()]), 2, y, bounds, 40)
        both.append([*w, chain.t01, chain.t10, chain.t11, chain.start])
    assert np.allclose(*both, atol=1e-9)


def test_toxicity_learns_from_every_clean_document_of_the_sample():
    rng = np.random.default_rng(3)
    offence, late = np.uint64(11), np.uint64(22)
    fresh = iter(rng.integers(1 << 32, 1 << 63, 2000, dtype=np.uint64))
    # the last 400 of 800 clean documents have a type that the others lack
    kinds = [None] * 400 + [late] * 400 + [offence] * 100
    docs = [np.array([next(fresh), *([k] if k else [])], np.uint64) for k in kinds]
    hashes = [np.stack([d, d ^ np.uint64(1 << 62)], 1) for d in docs]
    model = toxicity.fit(hashes, [np.array([0, len(d)]) for d in docs], np.arange(900) >= 800)
    assert model.weights[np.searchsorted(model.types, offence)] > 0
    assert late in model.types and model.weights[np.searchsorted(model.types, late)] < 0


@pytest.mark.parametrize("marks", [(), [(1, 1, 0), (2, 1, 0)], [(None, 0, 1), (3, None, None), (3, 1, 0)]])
def test_models_without_usable_labels(spark, marks):
    docs, own = frame(spark), labels(spark, marks)
    for made in (quality.quality_scores(docs, own), toxicity.toxicity(docs, own), line_rules.line_verdicts(docs, own)):
        rows = made.collect()
        assert len(rows) == len(TEXTS)
        assert len({r.score for r in rows}) == 1 if "score" in made.columns else not any(r.kept and r.base_failed for r in rows)


def test_models_on_odd_rows_and_empty_tables(spark):
    docs, marks = tables(spark)
    twice = docs.select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text")).unionByName(frame(spark).select("doc_id", "text"))
    for make in (quality.quality_scores, toxicity.toxicity, line_rules.line_verdicts):
        assert make(twice, marks).count() == docs.count() + 2 * len(TEXTS)
        assert make(frame(spark, [], []), marks).count() == 0


def test_blocks_hold_each_text_once():
    column = pa.chunked_array([pa.array(TEXTS[:4]), pa.array(TEXTS[4:])])
    seen = []
    for lo, hi, block in textscan.blocks(column, 1000):
        assert lo == len(seen) and hi - lo == len(block)
        seen += [bytes(block.data[a : z - 1]).decode() for a, z in itertools.pairwise(block.first)]
    assert seen == [t or "" for t in TEXTS]
    m = [textstats.measure(b) for _, _, b in textscan.blocks(column)]
    assert sum(len(textstats.document_features(x)) for x in m) == len(TEXTS)
