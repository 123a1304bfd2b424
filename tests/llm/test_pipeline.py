"""Every stage of the corpus pipeline against a brute-force version of it, on
what its predecessor kept."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerline.llm import secrets
from ledgerline.llm.common import cut, read_table
from tests.conftest import SF001
from tests.llm.test_decontam import brute as contamination
from tests.llm.test_near_dup import brute as components
from tests.llm.test_secrets import base


def test_stages(spark):
    docs = read_table(spark, SF001, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF001), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns

    # language: what goes has no letters or reads like none of the languages; prose of a declared language stays
    gone = [before[i].text or "" for i in before.keys() - kept["language_id"].keys()]
    assert all(sum(c.isalpha() for c in t) < 0.75 * max(1, len(t)) or len(t) < 40 for t in gone), gone
    one = kept["language_id"]
    parts = components([(i, r.text) for i, r in one.items()], 5)
    assert set(kept["near_duplicates"]) == {i for i, (_, c) in parts.items() if c == i}
    two = kept["near_duplicates"]
    items = [(r.item_id, r.text) for r in read_table(spark, SF001, "benchmark").collect()]
    bad = {i for i, v in contamination([(i, r.text) for i, r in two.items()], items).items() if v[4]}
    assert bad and set(kept["decontamination"]) == set(two) - bad
    three, four = kept["decontamination"], kept["secret_masking"]
    assert set(four) == set(three)
    chain = secrets.trained()
    for i, r in four.items():
        text = three[i].text
        assert not base(r.text or "") or "[SECRET]" in r.text
        assert r.n_chars == (len(r.text) if r.text != text else three[i].n_chars)
        if text and not secrets.secret_spans(text, chain):
            assert r.text == text
    five = kept["mixing"]
    assert five and set(five) < set(four)
    for r in five.values():
        assert r.text == four[r.doc_id].text and r.n_tokens == len(re.findall(r"\S+", r.text or "")) and 0 < r.probability <= 1


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, SF001)
    assert {"doc_id", "text", "topic", "n_tokens", "weight", "probability"} <= set(out.columns)
    first = sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in out.collect())
    assert first and first == sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in cp.run(spark, SF001).collect())


NAMES = "topic string, n_tokens int, weight double, Probability double, copies string, mark int, kept int, language string, host string, row int, spans int, n_hit int"


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_with_clashing_names_and_odd_rows(spark, name, stage):
    """Columns named like a stage's own, NULLs, empty, repeated and long rows, and no rows."""
    few = read_table(spark, SF001, "documents").limit(40)
    extra = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in NAMES.split(", ")]
    odd = [(-1, None, None, None, None), (-2, "", "en", "src1", 0), (-2, "", "en", "src1", 0), (None, "one text without an id, in plain English words", "en", None, None), (-3, "word " * 30_000, "en", "src2", 5)]
    rows = few.union(spark.createDataFrame(odd, few.schema)).union(few.limit(3))
    docs = cut(rows.select("*", *extra), "clashing")
    out = cut(stage(spark, docs, SF001), name)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert (len(out.columns) > len(docs.columns)) == (name == "mixing")
    before = Counter(r.doc_id for r in docs.collect())
    after = Counter(r.doc_id for r in out.collect())
    assert after and all(after[k] <= before[k] for k in after)
    if name == "secret_masking":
        assert after == before
    assert stage(spark, docs.limit(0), SF001).collect() == []
