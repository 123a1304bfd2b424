"""Operator 11 against a scan of every period, and its digests recomputed in plain Python."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import periodic, registry
from tests.conftest import SF001


def brute(words, least_length=6, least_exponent=4):
    """Every period tried: maximal stretches of words equal to those q ahead."""
    n, out = len(words), set()
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least_length, least_exponent * q):
                own = words[i : j + q]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = periodic.crc(doc_id), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def contract(doc_id, text):
    words = planted(doc_id, text)
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_small_sequences():
    rng = random.Random(3)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randrange(40))]
        if w and rng.random() < 0.5:
            p = rng.randrange(1, 6)
            w += (w[:p] * 6)[: rng.randrange(1, p * 6 + 1)] + [rng.randrange(k) for _ in range(rng.randrange(5))]
        a = np.array(w, np.int64)
        for least in ((6, 4), (3, 2), (4, 3), (9, 5)):
            want = brute(w, *least)
            s, e = periodic.candidates(a, np.array([0]), np.array([len(w)]), *least)
            assert [tuple(r) for r in periodic.document_runs(a, s, e, *least).tolist()] == want
            # the same without leaving anything out of the tree
            assert [tuple(r) for r in periodic.runs(a + 1, *least).tolist()] == want


def test_tree_gives_extensions_and_orders():
    rng = random.Random(5)
    for _ in range(100):
        w = np.array([rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))], np.int64)
        t = periodic.SuffixTree(w)
        n = len(w)
        suffixes = [w[i:].tolist() for i in range(n + 1)]
        assert [int(i) for i in np.argsort(t.rank)] == sorted(range(n + 1), key=lambda i: suffixes[i])
        assert [int(i) for i in np.argsort(t.rank_inverse)] == sorted(range(n + 1), key=lambda i: [-x for x in suffixes[i]])
        x, y = rng.randrange(n + 1), rng.randrange(n + 1)
        if x != y:
            common = next((d for d, (a, b) in enumerate(zip(suffixes[x], suffixes[y])) if a != b), min(len(suffixes[x]), len(suffixes[y])))
            assert t.extension(np.array([x]), np.array([y])).tolist() == [common]


def test_whole_query_against_plain_python(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registry.op11_periodic_runs(spark, SF001).collect()}
    small = [r for r in rows if len((r.text or "").split()) <= 1200]
    assert len(got) == len(rows) and len(small) > 0.9 * len(rows)
    for r in small:
        assert got[r.doc_id] == contract(r.doc_id, r.text), r.doc_id
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_edge_rows(spark):
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "b\x0ba\x0cb a b\ra b\na", "x y " * 3 + "x", "A a " * 4, "a a " * 6, "é " * 7, "w " * 5000 + "v w " * 400,
             "the same line again\n" * 9 + "end", " ".join(map(str, range(3000)))]
    rows = [(k, t, 1, "z") for k, t in enumerate(texts)] + [(5, "a " * 6, 2, "z"), (None, "a " * 6, 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    out = periodic.periodic_runs(df, slice_bytes=50).collect()
    assert len(out) == len(rows)
    for r in out:
        words = (texts[r.id] if r.id is not None else "a " * 6) or ""
        words = words.encode().split()
        want = brute(words)
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(df.limit(0)))).collect() == []
    planted_rows = periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(df))).collect()
    for r in planted_rows:
        if r.doc_id is not None:
            assert tuple(r[c] for c in COLUMNS) == contract(r.doc_id, texts[r.doc_id])
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, least_length=2)


def test_planted_tails_follow_the_rule(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 90)))) for k in range(-300, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in periodic.with_planted_runs(df).collect()}
    assert all(out[k].encode().split() == planted(k, t) for k, t in rows)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(df))).collect()}
    assert all(got[k] == contract(k, t) for k, t in rows)
