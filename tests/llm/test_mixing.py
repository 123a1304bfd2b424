"""Operator 3: marginals of the raked weights, sampling, edge rows."""

import numpy as np

from ledgerline.llm import mixing


def test_rake_meets_all_marginals():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 1000, (5, 4, 3)).astype(float)
    targets = [np.array([0.5, 0.2, 0.1, 0.1, 0.1]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.6, 0.3, 0.1])]
    weighted = tokens * mixing.rake(tokens, targets, 500, 1e-12)
    for axis, want in enumerate(targets):
        now = weighted.sum(axis=tuple(a for a in range(3) if a != axis)) / tokens.sum()
        assert np.allclose(now, want, atol=1e-9)


def test_categories_without_tokens_or_target():
    tokens = np.array([[[4.0]], [[0.0]], [[6.0]]])
    weights = mixing.rake(tokens, [np.array([0.5, 0.5, np.nan]), np.array([np.nan]), np.array([np.nan])], 100, 1e-12)
    # the free category keeps its 0.6; the empty one is left out and its share goes to the other
    assert np.allclose((tokens * weights).sum(axis=(1, 2)) / 10, [0.4, 0, 0.6])
    assert (mixing.rake(np.zeros((2, 2, 2)), [np.ones(2)] * 3, 5, 1e-9) == 1).all()


SCHEMA = "doc_id long, text string, source string, lang string, weight string, topic string"


def docs(spark, n=4000):
    rows = [(k, "w " * (1 + k % 7), "src1" if k % 3 else "src0", ["en", "de", "xx"][k % 5 % 3], "clash", "clash") for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sample_has_the_target_marginals(spark):
    targets = mixing.Targets(source={"src0": 0.5, "src1": 0.5}, lang={"en": 0.7, "de": 0.3}, topic={"prose": 1.0})
    rows = mixing.mix(docs(spark), targets).collect()
    assert len(rows) == 4000 and all(0 < r.probability <= 1 for r in rows)
    expected = {}
    for r in rows:
        expected[r.row.source] = expected.get(r.row.source, 0) + r.n_tokens * r.probability
    assert abs(expected["src0"] / sum(expected.values()) - 0.5) < 1e-6
    chosen = [r for r in rows if r.selected]
    got = sum(r.n_tokens for r in chosen if r.row.source == "src0") / sum(r.n_tokens for r in chosen)
    assert abs(got - 0.5) < 0.05
    assert {r.row.doc_id for r in chosen} == {r.row.doc_id for r in mixing.mix(docs(spark), targets).filter("selected").collect()}


def test_edge_rows(spark):
    rows = [(None, None, None, None, None, None), (1, "", "src0", "en", None, None), (1, "", "src0", "en", None, None), (2, "a " * 50_000, "src0", "zz", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert sorted((r.row.doc_id or 0, r.n_tokens) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 50_000)]
    assert len({r.selected for r in out if r.row.doc_id == 1}) == 1
    assert mixing.mix(df.limit(0)).collect() == []


def test_a_stray_cell_does_not_shrink_the_sample(spark):
    """One short table among 4,000 documents is repeated; the others are kept as the budget says."""
    rows = [(k, "w " * (1 + k % 7), "src0", "en", None, "prose") for k in range(4000)] + [(4000, "w w w", "src0", "en", None, "table")]
    targets = mixing.Targets(source={"src0": 1.0}, lang={"en": 1.0}, topic={"prose": 0.95, "table": 0.05}, budget=0.4)
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA), targets, topic_col="topic")
    out = mixed.collect()
    total = sum(r.n_tokens for r in out)
    assert 0.35 < sum(r.selected for r in out) / len(out) < 0.45
    stray = next(r for r in out if r.row.doc_id == 4000)
    assert stray.selected and abs(stray.copies * stray.n_tokens - 0.05 * 0.4 * total) <= 3
    assert abs(sum(r.copies * r.n_tokens for r in out) / total - 0.4) < 0.03
    k = mixing.kept(mixed).first()
    assert (k.documents, k.tokens, k.kept_documents) == (len(out), total, sum(r.selected for r in out))
    assert k.drawn_tokens == sum(r.copies * r.n_tokens for r in out)


def test_a_budget_above_what_is_there_repeats_documents(spark):
    mixed = mixing.mix(docs(spark), mixing.Targets(budget_tokens=48_000, lang={}, source={}, topic={}))
    k = mixing.kept(mixed).first()
    assert k.kept_documents == 4000 and abs(k.drawn_tokens / 48_000 - 1) < 0.03
    empty = mixing.mix(spark.createDataFrame([(1, "", "s", "en", None, None), (2, "a b", "s", "en", None, None)], SCHEMA), mixing.Targets(budget=9.0)).collect()
    assert sorted((r.row.doc_id, r.copies) for r in empty) == [(1, 1), (2, 9)]
