"""Mixing, sharding, URL rules, token counts, packing and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafgrid.llm import mixing, packing, sharding, urls, wordpiece
from leafgrid.llm.common import Tables, labelled_sample

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "  ", "a", "a", "A", "x" * 40_000, "é ß ñ 日本", "don't <|endoftext|> stop\r\n\x0b"]


def frame(spark, rows, parts=3):
    kinds = "doc_id bigint, text string, row string, shard string, word string, rate string, grp string, copies string"
    return spark.createDataFrame([(i, t, *"uvwxyz") for i, t in rows], kinds).repartition(parts)


def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


# ------------------------------------------------------------------- mixing


def domains(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs, docs.selectExpr("doc_id", "lang as label")


def test_rates_meet_the_targets(spark):
    docs, marks = domains(spark)
    rows = mixing.mix(docs, marks).collect()
    names = sorted(mixing.TARGETS)
    p = np.array([[r[f"p_{d}"] for d in names] for r in rows])
    n, rate = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    assert len(rows) == docs.count() and rate.min() >= 0
    assert np.allclose((n * rate) @ p, [mixing.TARGETS[d] * n.sum() for d in names], rtol=1e-3)
    assert np.allclose(p.sum(1), 1, atol=1e-6)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([names[k] == lang[r.doc_id] for k, r in zip(p.argmax(1), rows, strict=True)]) > 0.9
    text = dict(corpus(spark))
    assert n.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or "")) for r in rows]
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)


def test_steps_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3] * 3, 60)
    n = rng.integers(0, 50, 60)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n bigint, p0 double, p1 double, p2 double")
    targets = [0.05, 0.05, 0.9]
    rate, now, want = mixing.fit_rates(table, targets, 0.5, steps=15)
    r, s, goal = np.ones(60), n @ p, n.sum() * np.array(targets)
    gram = (p * n[:, None]).T @ p + 1e-9 * (n.sum() + 1) * np.eye(3)
    for _ in range(15):
        r = np.maximum(0.5, r - p @ np.linalg.solve(gram, s - goal))
        s = (n * r) @ p
    assert np.allclose(want, goal) and np.allclose(now, s, rtol=1e-6)
    got = [x.r for x in table.select(rate.alias("r")).collect()]
    assert np.allclose(sorted(got), sorted(r), rtol=1e-6)
    # the nearest point under the bound: no feasible direction improves it
    slope = p @ np.linalg.solve(gram, s - goal)
    assert (slope[(n > 0) & (r <= 0.5)] > -1e-2).all()


def test_mixing_odd_rows(spark):
    docs, marks = domains(spark)
    rows = corpus(spark) + [(None, t) for t in ODD] + [(5000, "der die und"), (5000, "der die und")]
    some = frame(spark, rows)
    got = mixing.mix(some, marks).collect()
    assert len(got) == len(rows)
    assert all(abs(r.p_de - 0.25) < 1e-6 for r in got if r.n_tokens == 0)
    none = mixing.mix(some, marks.limit(0)).collect()
    assert all(r.p_en == 0.25 for r in none)
    assert mixing.mix(frame(spark, []), marks).count() == 0


def test_posteriors_are_those_of_brute_force(spark):
    marks = [("a", "der die und der"), ("b", "the and the of"), ("b", "of der")]
    texts = ["der und", "the the of", "", "x y z", "der the " * 40]
    with Tables(spark) as tables:
        weights = tables.keep(mixing.word_weights(spark.createDataFrame(marks, "label string, text string"), ["a", "b"]))
        rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
        got = {r.row: r for r in mixing.posteriors(rows, weights, 2).collect()}
        words = sorted({w for _, t in marks for w in t.split()} | {"x", "y", "z"})
        place = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    counts = {d: Counter(place[w] for k, t in marks if k == d for w in t.split()) for d in "ab"}
    for row, text in enumerate(texts):
        own = text.split()
        known = [place[w] for w in own if place[w] in counts["a"] or place[w] in counts["b"]]
        logs = {d: [np.log((counts[d][b] + 0.5) / (sum(counts[d].values()) + 0.5 * mixing.BUCKETS)) for b in known] for d in "ab"}
        part = min(1, mixing.EVIDENCE / max(1, len(own)))
        s = {d: sum(x - (p + q) / 2 for x, p, q in zip(logs[d], logs["a"], logs["b"], strict=True)) * part for d in "ab"}
        assert got[row].n == len(own)
        assert abs(got[row].p0 - np.exp(s["a"]) / (np.exp(s["a"]) + np.exp(s["b"]))) < 2e-3
        assert abs(got[row].p0 + got[row].p1 - 1) < 1e-9


def test_targets_that_cannot_be_met_are_flagged(spark):
    docs = spark.createDataFrame([(k, "der die und das") for k in range(50)], "doc_id bigint, text string")
    marks = docs.selectExpr("doc_id", "'de' as label")
    with pytest.warns(UserWarning, match="not met"):
        got = mixing.mix(docs, marks, {"de": 0.2, "en": 0.8}).collect()
    assert len(got) == 50 and not any(r.met for r in got)


def test_rows_that_share_an_id_are_mixed_each_on_its_own(spark):
    german, english = "der die und das ist " * 8, "the and of that is " * 8
    rows = [(1, german), (1, english), (None, german), (None, english), *((k, german if k % 4 else english) for k in range(2, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(k, "de" if k % 4 else "en") for k in range(2, 60)], "doc_id bigint, label string")
    got = Counter((r.doc_id, r.text) for r in mixing.mixed(docs, marks, {"de": 0.1, "en": 0.9}).collect())
    assert got[1, german] == 1 and got[None, german] == 1
    assert got[1, english] > 5 and got[None, english] > 5


def test_a_sample_has_one_row_an_id_and_bounded_bytes(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "y" * 1000) for k in range(2, 60)], "doc_id bigint, text string")
    marks = docs.selectExpr("doc_id", "1 as quality").distinct()
    with Tables(spark) as tables:
        got = labelled_sample(docs, marks, "doc_id", "text", "quality", 1000, tables).collect()
        assert len(got) == len({r.id for r in got}) and all(zlib.crc32(str(r.id).encode()) % 5 for r in got)
        few = labelled_sample(docs, marks, "doc_id", "text", "quality", 1000, tables, room=10_500).collect()
        assert 10 <= len(few) <= 11
        assert labelled_sample(docs, marks, "doc_id", "text", "quality", 7, tables).count() == 7


def plain_propagation(cells, capacity, shards, rounds, chance):
    """The same moves, cell by cell."""
    where = {c: c[2] for c in cells}
    full = []
    for turn in range(rounds):
        target = {}
        for grp, piece in {c[:2] for c in cells}:
            votes = Counter()
            for c in cells:
                if c[:2] == (grp, piece):
                    votes[where[c]] += cells[c]
            target[grp, piece] = max(votes, key=lambda s: (s not in full, votes[s], -s))
        load, moving = Counter(), Counter()
        for c, n in cells.items():
            load[target[c[:2]]] += n
            moving[target[c[:2]]] += n * (where[c] != target[c[:2]])
        share = {j: min(1.0, max(0.0, (capacity - (load[j] - m)) / m)) for j, m in moving.items() if m}
        if not share:
            break
        full = [j for j, x in share.items() if x < 1]
        for c in cells:
            if chance[c[0], c[1], turn] < share.get(target[c[:2]], 0.0):
                where[c] = target[c[:2]]
    return where


def test_propagation_is_that_of_brute_force(spark):
    rng = random.Random(12)
    cells = {(f"g{g}", 0, s): rng.randrange(1, 9) for g in range(40) for s in rng.sample(range(4), rng.randrange(1, 5))}
    table = spark.createDataFrame([(*c, n) for c, n in cells.items()], "grp string, piece bigint, origin int, n bigint")
    turns = spark.createDataFrame([(g, 0, t) for g in {c[0] for c in cells} for t in range(6)], "grp string, piece bigint, turn int")
    chance = {(r.grp, r.piece, r.turn): r.c for r in turns.withColumn("c", sharding._chance(F.col("grp"), F.col("piece"), F.col("turn"))).collect()}
    capacity = sum(cells.values()) / 4 * 0.9
    with Tables(spark) as tables:
        got = {(r.grp, r.piece, r.origin): r["shard"] for r in sharding.propagate(table, capacity, tables, 4, 6).collect()}
    assert got == plain_propagation(cells, capacity, 4, 6, chance)


def test_sums_before_need_no_task_over_all(spark):
    counts = [(a, b, c, (a * 7 + b * 3 + c) % 5) for a in range(3) for b in range(4) for c in range(6)]
    table = spark.createDataFrame(counts, "a int, b int, c int, n bigint").repartition(3)
    got = {(r.a, r.b, r.c): r.before for r in sharding._before(table, ["a", "b", "c"], ["a", "b"]).collect()}
    assert got == {x[:3]: sum(y[3] for y in counts if y[:3] < x[:3]) for x in counts}


def test_mixed_rows_are_repeated_and_never_dropped(spark):
    docs, marks = domains(spark)
    more = docs.selectExpr("*", "1 as _times", "2 as _copy", "3 as rate")
    got = mixing.mixed(more, marks)
    times = {r.doc_id: r.copies for r in mixing.mix(docs, marks, min_rate=1.0, keep_all=True).collect()}
    assert got.columns == more.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(times) and min(times.values()) >= 1


# ----------------------------------------------------------------- sharding


@pytest.mark.parametrize("bucket", [sharding.BUCKET, 7])
def test_shards_are_even_and_groups_stay_whole(spark, bucket):
    rng = random.Random(4)
    rows = [(k, f"text {k}") for k in range(400)] + [(1000 + k, f"copy {rng.randrange(40)}") for k in range(200)]
    rows += [(2000 + k, "hot") for k in range(320)] + [(None, t) for t in ODD]
    got = sharding.assign(frame(spark, rows), bucket=bucket).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, size in sizes.items():
        assert sorted(r.slot for r in got if r["shard"] == k) == list(range(size))
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        t = text[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
            where[t].add(r["shard"])
        assert r.law == "rows" and r.grown_shard is None
    split = [t for t, s in where.items() if len(s) > 1 and t != "hot"]
    assert len(split) <= 7 and len(where["hot"]) <= 7


def test_few_rows_and_none_can_be_sharded(spark):
    assert sharding.assign(frame(spark, [])).count() == 0
    got = sharding.assign(frame(spark, [(1, None), (1, "")])).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in got] == [(1, 0, 0)] * 2 and len({r["shard"] for r in got}) == 2


# --------------------------------------------------------------- URL rules


def judged(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(g.strip("*") in host for g in urls.HOST_GLOBS) else "allow"


def test_url_verdicts_are_those_of_brute_force(spark):
    rng = random.Random(7)
    hosts = ["com", "a.com", "xcom", "example.com", "EXAMPLE.com", "w.example.com", "net", "q.example.net", "example.org", "www.casino-win.example.org", "evil.org/x.com", "", "a.cheap-pills.de"]
    paths = ["", "/", "/en/7", "/en/", "/en", "/de/8", "/de/9?x=/en/7", "/es/#/en/7", "/EN/7", "/日本", "?u=http://a.com/en/7", "/x.com/en/"]
    rows = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a:/b", "x://", "http://a.com/en/\n7", "http://h/" + "é" * 9000]
    pages = spark.createDataFrame([(k % 50, u, "h", "b") for k, u in enumerate(rows * 2)], "page_id bigint, url string, host string, id string").repartition(3)
    got = urls.url_verdicts(pages).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((k % 50, *judged(u))) for k, u in enumerate(rows * 2))
    assert urls.url_verdicts(pages.limit(0)).count() == 0
    kept = urls.allowed_pages(pages)
    assert kept.columns == pages.columns
    assert kept.count() == sum(judged(u)[3] == "allow" for u in rows * 2)


def test_packed_globs_match_like_single_ones():
    rng, globs = random.Random(1), ["*a*b", "a?c*", "*", "abc", "*bc*", "", "a*b*c", "?" * 3]
    automaton = urls.compile_rules([urls.glob(g) for g in globs * 20])
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(500)]
    hit = automaton.match([t.encode() for t in texts])
    assert hit.shape[1] == 160 and automaton.step.shape[1] > 1
    for k, g in enumerate(globs * 20):
        pattern = re.compile(g.replace("?", ".").replace("*", ".*"))
        assert hit[:, k].tolist() == [bool(pattern.fullmatch(t)) for t in texts]


# ------------------------------------------------------------ token counts


def greedy(word, pieces):
    text, n, at = wordpiece.MARK + word, 0, 0
    while at < len(text):
        ends = [z for z in range(min(len(text), at + 20), at, -1) if text[at:z] in pieces]
        n += 1 if ends else len(text[at].encode())
        at = ends[0] if ends else at + 1
    return n


def test_counts_are_those_of_greedy_matching(spark):
    pieces = set(wordpiece.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    rows = corpus(spark)[:60] + [(None, t) for t in ODD]
    got = wordpiece.token_counts(frame(spark, rows), pieces).collect()
    want = []
    for i, t in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append((i, len(own), sum(greedy(w, pieces) for w in own)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert wordpiece.token_counts(frame(spark, []), pieces).count() == 0


def test_failure_links_on_awkward_vocabularies():
    rng = random.Random(9)
    for _ in range(40):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        counter = wordpiece.build(pieces)
        tests = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 14))) for _ in range(50)]
        flat = np.array([ord(c) for w in tests for c in w], np.uint32)
        ends = np.cumsum([len(w) for w in tests])
        got = counter.count(flat, ends - [len(w) for w in tests], ends)
        assert got.tolist() == [greedy(w, pieces) for w in tests]


# ----------------------------------------------------------------- packing


def check_pieces(rows, texts):
    """rows: pieces; texts: (id, text), all ids different."""
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    for i, t in texts:
        pieces = sorted(by_doc.pop(i), key=lambda r: r.start)
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces]).tolist()][:-1]
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    assert not by_doc
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        sizes = [r.length for r in pieces]
        assert [r.offset for r in pieces] == [0, *np.cumsum(sizes).tolist()][:-1]
        assert sum(sizes) <= 1024 and sum(sizes) & (sum(sizes) - 1) == 0  # no padding at all


def test_packing_is_a_round_trip_without_padding(spark):
    texts = corpus(spark) + [(10_000 + k, t) for k, t in enumerate(ODD)]
    got = packing.pack(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    check_pieces(got, texts)
    assert packing.pack(frame(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    rows = [(1, "a b c")] * 3 + [(None, "d")] * 2
    got = packing.pack(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 3 * 4 and sum(r.length for r in got if r.doc_id is None) == 2 * 2


def test_windows_are_bounded_and_best_fit():
    packer = packing.Packer(10, 2)
    packer.add(0, 6)
    packer.add(1, 7)
    packer.add(2, 3)  # fits the second exactly
    assert packer.done == [[(1, 0, 7), (2, 0, 3)]]
    packer.add(3, 5)
    packer.add(4, 8)  # none fits: tops up the fullest and goes on
    assert packer.done[-1] == [(0, 0, 6), (4, 0, 4)] and len(packer.room) <= 2
    packer.finish()
    assert sum(p[2] for s in packer.done for p in s) == 29
    assert all(n == 10 or n & (n - 1) == 0 for n in (sum(p[2] for p in s) for s in packer.done))


def test_long_texts_are_cut_where_the_pattern_cuts():
    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    text = "some words here, 12 and  more\n than that" * 50
    assert packing.encode(text, ranks, 64).tolist() == packing.encode(text, ranks).tolist()


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, kept = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder).cache()
        assert rows.columns == docs.columns, name
        kept.append(rows.count())
    assert kept[0] > kept[1] > kept[2] >= kept[3] <= kept[4]
    got = corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in got}
    times = Counter(r.doc_id for r in rows.collect())
    assert total == Counter({i: n * tokens[i] for i, n in times.items()})


def test_pipeline_of_no_documents(spark):
    import corpus_pipeline

    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA)
    assert rows.count() == 0
