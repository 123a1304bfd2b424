"""Operator 1 against brute force on full shingle sets."""

import random
import re

import numpy as np
import pytest

from ledgerline.llm import near_dup as nd

SCHEMA = "doc_id long, text string, class_id string, component string"


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    """{doc_id: (n_shingles, component)}"""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, t in sets[x + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, groups=12, copies=14, words=60):
    """Groups of copies whose similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((at := at + 1, " ".join(own)))
    rng.shuffle(rows)
    return rows


def found(spark, rows, p):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, p).collect()}


@pytest.mark.parametrize("size,block", [(2, 512), (5, 8)])
def test_components_match_brute_force(spark, size, block):
    rows = near_copies(size)
    assert found(spark, rows, nd.NearDup(shingle=size, block_rows=block)) == brute(rows, size)


def test_edge_rows(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\r\n "), (4, "One"), (5, "one"), (6, "ONE two"), (7, "one  two\n"), (8, "É a"), (9, "é a"),
        (10, long), (11, long + " end"), (12, "other words altogether here"),
    ]
    for size in (2, 5):
        assert found(spark, rows, nd.NearDup(shingle=size)) == brute(rows, size)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "a b c"), (4, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, None, True)] * 2 + [(3, 2, False)] * 2 + [(2, 2, True), (4, 4, True)], key=str)
    kept = sorted((tuple(r) for r in nd.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(None, "a b c")] * 2 + [(2, "a b c"), (4, None)], key=str)
    empty = df.limit(0)
    assert nd.near_duplicates(empty).collect() == [] and nd.drop_near_duplicates(empty).collect() == []


def test_of_repeated_rows_one_stays(spark):
    df = spark.createDataFrame([(1, "x y z", "k"), (1, "x y z", "k"), (1, "quite another text", "k")], "doc_id long, text string, _id string")
    out = nd.drop_near_duplicates(df)
    assert out.columns == ["doc_id", "text", "_id"]
    assert sorted(map(tuple, out.collect())) == [(1, "quite another text", "k"), (1, "x y z", "k")]


def test_collision_corrected_estimate():
    """Equal b-bit minima are c + (1 - c) * similarity of all, within 5 standard errors."""
    rng = np.random.default_rng(0)
    p = nd.NearDup()
    for share in (0.3, 0.8, 0.95):
        both = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        cut = int(4000 * 2 * share / (1 + share))
        sets = [np.unique(np.concatenate([both[:cut], rng.integers(0, 2**63, 4000 - cut, dtype=np.uint64)])) for _ in range(2)]
        _, _, _, planes = nd._sketch(sets, p)
        equal = int(nd.equal_minima(planes[0][None, :], planes[1][None, :], p.bits, p.minima)[0])
        c = 0.5**p.bits
        want = c + (1 - c) * share
        assert abs(equal - p.minima * want) < 5 * np.sqrt(p.minima * want * (1 - want))


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 60)).astype(np.uint64)) for _ in range(9)]
    got = nd.shared_counts(sets[:4], sets[4:], width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
