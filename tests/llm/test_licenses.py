"""Operator 6: variants of known texts have one canonical digest."""

import pytest

from ledgerline.llm import licenses
from ledgerline.llm.known_licenses import LICENSES, NOTICES


def scan(spark, texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, license_id string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_variants_of_whole_texts(spark):
    names = sorted(LICENSES)
    texts = []
    for name in names:
        t = LICENSES[name]
        texts += [
            t, t.upper(), "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + t, t.replace(",", " , ").replace("\n", "\r\n   "),
            "© 1999-2003 A, B and C\n" + t.replace("license", "licence"), t + " and one more word",
        ]
    got = scan(spark, texts)
    for k, name in enumerate(names):
        assert [got[6 * k + v].license_id for v in range(6)] == [name] * 5 + [None]


def test_notices_are_whole_lines(spark):
    name = sorted(NOTICES)[0]
    line = NOTICES[name]
    got = scan(spark, [f"prose\n  {line.upper()} \nprose\n{line}", f"before {line} after", None, "", "word " * 200_000])
    assert (got[0].notices, got[0].n_notices) == (name, 2)
    assert {(got[k].license_id, got[k].notices, got[k].n_notices) for k in (1, 2, 3, 4)} == {(None, "", 0)}


def test_repeats_empty_tables_and_clashing_known_texts(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")
    assert licenses.scan(df).count() == 2 and licenses.scan(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(df, {"a": "Same text", "b": "same, TEXT"}, NOTICES).collect()


def test_full_texts(spark):
    """Whole long texts are known, with other line breaks and copyright lines too."""
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib"]
    got = scan(spark, ["Copyright 2024 Someone\n\n" + LICENSES[n].replace("\n", "\r\n\t") for n in names])
    assert [got[k].license_id for k in range(len(names))] == names
