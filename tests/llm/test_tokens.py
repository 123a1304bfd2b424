"""Operator 9 against the library that the vocabulary file is for."""

import random
import time

import pytest

from ledgerline.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
EDGE = [
    "", " ", "\n\n  \t", "aaaaaaaaaaaaaaaa", "it's I'LL we've 'd", "naïve café — 日本語 😀👍🏽", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "\x00\x01\x7f", "é" * 999,
    "x" * 5000, "word " * 20_000, "1234567890 3.14 ²③", "tab\tnew\r\nline", "​﻿ ", "foo   bar    ", "_under__score__ --- ===",
]


def want(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_match_the_library(spark):
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choices("ab cd'e\n é日1.", k=rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(-1, None, "c")], "doc_id long, text string, n_tokens string")
    out = {r.doc_id: r for r in tokens.token_counts(df, PATH).collect()}
    assert [out[k].n_tokens for k in range(len(texts))] == want(texts)
    assert [out[k].n_bytes for k in range(len(texts))] == [len(t.encode()) for t in texts]
    assert (out[-1].n_bytes, out[-1].n_tokens, out[-1].over_limit) == (0, 0, False)
    assert all(r.over_limit == (r.n_tokens > 512) for r in out.values())
    assert tokens.token_counts(df.limit(0), PATH).collect() == []


def test_documents_match_the_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r.text or "" for r in rows.collect()]
    got = [r.n_tokens for r in tokens.token_counts(rows, PATH, slice_bytes=5000, most_known=100).collect()]
    assert sorted(got) == sorted(want(texts))


def test_overlapping_pairs_merge_from_the_left():
    m = tokens.merger(PATH)
    for n in range(1, 40):
        assert m.count(["a" * n])[0] == want(["a" * n])[0]


def test_long_unbroken_runs_match_the_library_and_take_seconds():
    rng = random.Random(3)
    m = tokens.merger(PATH)
    runs = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aé日") for n in (171, 511, 512, 513, 514, 5000)]
    runs += [" " * 3000, "a" * 4097, "=" * 2000, "the" * 3000]
    assert m.count(runs).tolist() == want(runs)
    assert m.count(["".join(runs[:3])]).tolist() == [m.count_long("".join(runs[:3]).encode())]
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    started = time.process_time()
    assert m.count([long])[0] == want([long])[0]
    assert time.process_time() - started < 10
