"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import pytest

from leafgrid.llm import common, exact_dedup, near_dedup

SCHEMA = "doc_id bigint, text string, h bigint, n string, id double, cid string, sha string, text_sha256 string, group_size string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, pairs, parts=3):
    rows = [(i, t, 7, "x", 0.5, None, "s", "t", "g") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def family(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def texts():
    out = [None, "", "  \n ", "one", "ONE", "one two", "É é", "é É", "a" * 50_000, "word " * 5000]
    for seed in range(6):
        out += family(seed, 40 + 20 * seed, 12, 6 + seed)
    out += family(99, 120, 60, 12)
    return out + out[:4] + out[-3:]


def brute(pairs, width, percent):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        if len(words) < width:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(pairs):
        part = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), part, part is None or i == part))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


#: Bounds so small that every path beyond them is taken.
TIGHT = {"cap": 2, "group": 4, "room": 6000, "again": 1, "bound": 6}


@pytest.mark.parametrize(("width", "bounds"), [(2, {}), (5, TIGHT)])
def test_near_duplicates_are_those_of_brute_force(spark, width, bounds):
    pairs = [(1000 - 3 * k, t) for k, t in enumerate(texts())] + [(None, "one two"), (None, "lonely text here"), (1000, "one two")]
    got = near_dedup.near_duplicates(frame(spark, pairs), width=width, **bounds).collect()
    assert order(got) == order(brute(pairs, width, 80))


def test_a_family_beyond_one_task_loses_no_link(spark):
    """Members that link only to some others, over several blocks."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    out = []
    for k in range(150):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([1, 3, 6, 9])):
            own[at] = f"e{k}_{at}"
        out.append((k, " ".join(own)))
    out += [(500 + k, " ".join([*base[k : k + 45], *(f"x{j}" for j in range(15))])) for k in range(12)]
    got = near_dedup.near_duplicates(frame(spark, out), width=1, cap=4, group=40, room=20_000).collect()
    assert order(got) == order(brute(out, 1, 80))


def test_components_with_hubs_are_those_of_a_plain_search(spark):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 60)] + [(200 + k, 201 + k) for k in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(59, 230)]
    root = {x: x for e in edges for x in e}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    with common.Tables(spark) as tables:
        for bound in (near_dedup.EDGES, 10):
            got = dict(map(tuple, near_dedup.components(table, tables, bound).collect()))
            assert got == {x: r for x, r in root.items() if x != r}


def test_intermediate_tables_are_deleted(spark):
    from pathlib import Path

    with common.Tables(spark) as around:
        near_dedup.drop_near_duplicates(frame(spark, list(enumerate(family(5, 80, 10, 1))))).count()
        folder = Path(common._own_folder(spark).removeprefix("file:"))
        left = {str(p) for p in folder.iterdir()}
        assert {p.removeprefix("file:") for p in around.paths} <= left
    assert not {str(p) for p in folder.iterdir()} & {p.removeprefix("file:") for p in around.paths}


def test_near_duplicates_of_an_empty_table(spark):
    got = near_dedup.near_duplicates(frame(spark, []))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got.count() == 0


def test_dropping_near_duplicates_keeps_columns_and_one_of_each(spark):
    pairs = list(enumerate(family(5, 80, 10, 1))) + [(50, None), (51, "")]
    docs = frame(spark, pairs)
    got = near_dedup.drop_near_duplicates(docs)
    kept = {r[0] for r in brute(pairs, 5, 80) if r[3]}
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == kept


def test_every_pair_within_the_distance_shares_a_key():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, near_dedup.SLOTS), dtype=np.uint16)
        b = a.copy()
        b[0, rng.choice(near_dedup.SLOTS, near_dedup.ERRORS, replace=False)] ^= 1
        assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any()


def exact_brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(lower(t), []).append(i)
    out, done = [], set()
    for i, t in pairs:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        kept = i == keep and (lower(t), i) not in done
        if kept:
            done.add((lower(t), i))
        out.append((i, keep, len(own), kept, hashlib.sha256(lower(t).encode()).hexdigest()))
    return out


PAIRS = [(k, t) for k, t in enumerate(texts())] + [(None, "x"), (None, "X"), (None, "one"), (3, "one"), (7, "Ab"), (7, "aB"), (7, "ab")]


@pytest.mark.parametrize("memory", [exact_dedup.MEMORY, 1500])
def test_exact_duplicates_are_those_of_brute_force(spark, memory):
    got = exact_dedup.exact_duplicates(frame(spark, PAIRS), memory=memory).collect()
    assert order(got) == order(exact_brute(PAIRS))


def test_equal_hashes_do_not_make_texts_equal(spark):
    rows = [(k, f"text {k % 40}") for k in range(200)]
    got = exact_dedup.distinct_texts(frame(spark, rows), memory=2000, hash_of=lambda content: 5).collect()
    assert sorted((r[2], r[1]) for r in got) == [(160 + k, 5) for k in range(40)]


def test_spilled_records_give_the_same_rows(spark):
    rows = [(k, f"text {k % 700} " + "pad " * 50) for k in range(2100)]
    docs = frame(spark, rows)
    few, many = (exact_dedup.distinct_texts(docs, memory=m) for m in (3000, exact_dedup.MEMORY))
    assert order(few.collect()) == order(many.collect())
    assert few.count() == 700


def test_survivors_keep_all_columns(spark):
    docs = frame(spark, PAIRS)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert got.count() == len({lower(t) for _, t in PAIRS})
    one = next(r for r in got.collect() if lower(r.text) == "ab")
    assert (one.doc_id, one.text, one.n) == (7, "Ab", "x")
    assert exact_dedup.drop_exact_duplicates(frame(spark, [])).count() == 0
