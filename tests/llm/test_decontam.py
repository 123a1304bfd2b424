"""Operator 4 against a search of every window in every document."""

import hashlib
import random
import re

import pytest

from ledgerline.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13, share=20):
    out = {}
    for i, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for k, item in items:
            b = words(item)
            size = min(window, len(b))
            for s in range(len(b) - size + 1 if b else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == b[s : s + size]:
                        hit.update(range(at, at + size))
                        ids |= {str(k)} - {"None"}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(ids), digest, bool(hit) and share * len(hit) >= len(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 13, 14, 40])))) for k in range(1, 30)]
    items += [(50, None), (51, ""), (52, "?!"), (7, "shares an id with another item 7"), (53, items[0][1])]
    items += [(None, "an item that has lost its id"), (None, items[4][1]), (None, None)]
    docs = []
    for k in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            passage = words(rng.choice(items)[1])
            cut = rng.randrange(0, len(passage) + 1)
            text[rng.randrange(len(text) + 1) :] += passage[cut // 2 :]
        docs.append((k, " ".join(text).replace("w1 ", "W1, ")))
    docs += [(104, "an item that has lost its id"), (105, "so an item that has lost its id"), (100, None), (101, ""), (102, "..."), (103, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 32 << 20), (2, 200)])
def test_report_matches_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, spans string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.report(d, b, decontam.Decontam(block_bytes=block, slice_bytes=500)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out}
    assert got == brute(docs, items)
    kept = decontam.decontaminate(d, b, decontam.Decontam(block_bytes=block))
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if not v[4])


def test_longest_matches_and_their_places(spark):
    item = [f"k{n}" for n in range(30)]
    text = ["a", *item[2:22], "b", *item[10:30]]
    d = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    r = decontam.annotate(d, b, with_matches=True).collect()[0]
    found = {(m.item_at, m.doc_at, m.length) for m in r.matches}
    # each test suffix has its longest match: at the place(s) where it goes furthest
    assert (2, 1, 20) in found and (10, 22, 20) in found and (17, 29, 13) in found
    assert all(item[a : a + n] == text[at : at + n] and (a + n == 30 or at + n == len(text) or item[a + n] != text[at + n]) for a, at, n in found)
    assert r.spans == [1, 21, 22, 42]


def test_empty_tables_and_long_texts(spark):
    d = spark.createDataFrame([(1, "x " * 200_000), (2, "m " * 20)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "m " * 40)], "item_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontam.report(d, b).collect()}
    assert out == {1: (200_000, 0, False), 2: (20, 20, True)}
    assert decontam.report(d.limit(0), b).collect() == []
    assert {r.n_hit for r in decontam.report(d, b.limit(0)).collect()} == {0}
