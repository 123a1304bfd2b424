"""Operator 12 against the library of the rank file, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, registry
from tests.conftest import SF001

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

PATH, PATTERN = str(public_tokenizers.path(registry.RANK_FILE)), public_tokenizers.PATTERN
EDGE = [
    "", " ", "\n\n  \t", "a" * 700, "it's I'LL we've 'd 'rex", "naïve café — 日本語 😀👍🏽", "a<|endoftext|>b", "\x00\x01\x7f", "é" * 999, "word " * 900, "1234567890 3.14 ²③",
    "tab\tnew\r\nline", "​﻿ ", "foo   bar    ", " " * 500 + "x" + "\n" * 400, "ab\u088f\U00018e00cd x\U00012550\U000125511" * 30, "'" * 300 + "re" * 200, "x's'll" * 150, "-" * 400 + "ab " * 90 + "=" * 1000,
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_and_long_pieces(library):
    r = byte_bpe.ranks(PATH, PATTERN)

    def mine(t):
        return np.frombuffer(r.encode([t], 100_000)[0], "<i4").tolist()

    for first in range(0, 0x110000, 997):
        t = "".join(f"a{c}b 1{c}{c} {c}th{c}ing" for c in map(chr, range(first, min(first + 997, 0x110000))) if not 0xD800 <= ord(c) < 0xE000)
        assert mine(t) == library.encode_ordinary(t), hex(first)
    one_byte = {bytes([i]): i for i in range(256)}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        known = tiktoken.Encoding("own", pat_str=kind, mergeable_ranks=one_byte, special_tokens={})
        ours = byte_bpe.regex.compile(kind).match
        assert all(bool(ours(r.classed(chr(c)))) == bool(known.encode_ordinary(chr(c))) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    letter = tiktoken.Encoding("own", pat_str=r"\p{L}", mergeable_ranks=one_byte, special_tokens={})
    assert all(letter.encode_ordinary(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha())
    rng = random.Random(1)
    for n in (1, 2, 30, 63, 64, 65, 66, 100, 500, 3000):
        for letters in ("abcdeinrstö日", "ab", "a -='", "0123456789"):
            t = "".join(rng.choices(letters, k=n))
            assert mine(t) == library.encode_ordinary(t)
            assert r.decode(np.array(mine(t), np.int64)) == t.encode()


@pytest.mark.parametrize("chunk, overlap", [(8, 4), (40, 9), (200, 60), (1 << 15, 1 << 9)])
def test_stitched_chunks_match_the_library(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    texts = EDGE + ["".join(rng.choices("ab cd'es\n é日1.", k=rng.randrange(400))) for _ in range(60)]
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(-1, None, "c"), (0, "again and again " * 9, "c"), (None, "no id " * 20, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN, chunk=chunk, overlap=overlap), PATH, PATTERN).collect()
    want = sorted((repr(k), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t, _ in rows)
    assert sorted((repr(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in out) == want


def test_spans_take_over_at_common_boundaries(spark):
    text = "some words, " * 30 + "x" * 200 + " and more words" * 20
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    long = df.mapInArrow(byte_bpe._chunks(40, 12), "doc string, doc_id long, no long, at long, last boolean, text string")
    fields = "doc string, doc_id long, no long, at long, last boolean, text string, head array<long>, tail array<long>"
    parts = byte_bpe.spans(long.mapInArrow(byte_bpe._boundaries(PATH, PATTERN, 40, 12), fields)).orderBy("no").collect()
    starts = {0, *(m.end() for m in byte_bpe.ranks(PATH, PATTERN).iterate(text))}
    assert all(r.begin in starts for r in parts if r.begin is not None)
    # the unbroken run has no boundary to take over at; everywhere else chunks stand alone
    alone = [r for r in parts if r.begin is not None]
    assert 3 <= len(parts) - len(alone) <= 7 and len(alone) > 10


def test_whole_query_matches_the_library(spark, library):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registry.op12_byte_bpe(spark, SF001).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_empty_tables_and_wrong_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH, PATTERN)).collect() == []
    odd = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(None).cast("array<int>").alias("ids"))
    assert bytes(byte_bpe.decode(odd, PATH, PATTERN).first().decoded) == b""
    with pytest.raises(ValueError):
        byte_bpe.ranks(PATH, PATTERN).decode(np.array([10**6]))
    with pytest.raises(ValueError):
        byte_bpe.encode(df, PATH, PATTERN, chunk=8, overlap=5)
