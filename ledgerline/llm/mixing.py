"""Operator 3: mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); a value without a target
is the category ``(other)``, which keeps its share.  The cells, as many as the
targets' categories allow, are raked on the driver until all three marginals
agree with the targets.  The weights are scaled to a token budget: a document is
expected weight * scale times in the mix, so the expected tokens have the target
marginals and sum to the budget, however rare the rarest cell is.  The whole
part of that number are sure copies, the rest is the chance of one more.  Each
document is drawn by itself, by a hash of its id: the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "(other)"


@dataclass(frozen=True)
class Targets:
    """Shares of tokens per category; each marginal is scaled to what is there.

    The mix has ``budget`` times the tokens of the documents (in expectation),
    or ``budget_tokens`` if given; a budget above 1 repeats documents."""

    source: dict[str, float] = field(default_factory=lambda: {f"src{k}": 1.0 for k in range(20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.9, "table": 0.05, "marked": 0.05})
    rounds: int = 500
    tolerance: float = 1e-9
    budget: float = 0.4
    budget_tokens: int | None = None
    seed: int = 13


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """Kind of content where no topic column is given: table (a cell border
    for at least every fourth word), marked (a run of marks likewise), prose."""
    bars, marks = (F.regexp_count(text, F.lit(x)) for x in (r" \|", r"[#$%&*]{3}"))
    return F.when(4 * bars >= tokens + 1, "table").when(4 * marks >= tokens + 1, "marked").otherwise("prose")


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Weights whose product with ``tokens`` has the target marginals (shares).

    Marginals are fitted in turn; categories without tokens are left out.  If
    no weights exist that fit all (a zero pattern), the last round's stand.
    """
    weights = np.ones_like(tokens)
    total = tokens.sum()
    if total <= 0:
        return weights
    axes = range(tokens.ndim)
    wanted = []
    for axis, target in zip(axes, targets):
        there = tokens.sum(axis=tuple(a for a in axes if a != axis))
        share = np.where(there > 0, target, 0.0)
        free = np.isnan(share)
        own = there / total
        share[free] = own[free]
        fixed = share[~free].sum()
        if fixed > 0:
            share[~free] *= (1 - own[free].sum()) / fixed
        wanted.append(share * total)
    for _ in range(rounds):
        worst = 0.0
        for axis, want in zip(axes, wanted):
            now = (tokens * weights).sum(axis=tuple(a for a in axes if a != axis))
            step = np.divide(want, now, out=np.ones_like(want), where=now > 0)
            worst = max(worst, float(np.abs(now - want).max()) / total)
            weights = weights * step.reshape([-1 if a == axis else 1 for a in axes])
        if worst <= tolerance:
            break
    return weights


def _category(column: Column, target: dict[str, float]) -> Column:
    return F.when(column.isin(*target), column).otherwise(OTHER) if target else F.lit(OTHER)


def mix(
    docs: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", topic_col: str | None = None,
) -> DataFrame:
    """One row per document: ``row`` (struct of its columns), n_tokens, topic,
    weight, probability, selected, copies.

    copies: times the document is in the mix (epochs), weight * scale in
    expectation; probability: the chance of at least one; selected: copies > 0.

    * NULL and unlisted categories are (other).  NULL and empty texts have no
      tokens, share their cell's weight and are never repeated.
    * Rows sharing an id are drawn alike; a NULL id is drawn by its text.
    * Categories without tokens are left out and the rest scaled; an empty
      table gives an empty result.  No column clashes with the results.
    """
    spark = docs.sparkSession
    row, text = F.struct(*[F.col(c) for c in docs.columns]), F.col(text_col).cast("string")
    tokens = token_count(text)
    d = docs.select(
        row.alias("row"), tokens.alias("n_tokens"), F.coalesce(F.col(id_col).cast("string"), text, F.lit("")).alias("draw"),
        (F.coalesce(F.col(topic_col).cast("string"), F.lit(OTHER)) if topic_col else topic_of(F.coalesce(text, F.lit("")), tokens)).alias("topic"),
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
    )
    marginals = [targets.source, targets.lang, targets.topic]
    names = [[*t, OTHER] for t in marginals]
    d = d.withColumns({f"c{k}": F.coalesce(_category(F.col(c), t), F.lit(OTHER)) for k, (c, t) in enumerate(zip(("source", "lang", "topic"), marginals))})
    cells = np.zeros([len(x) for x in names])
    for r in d.groupBy("c0", "c1", "c2").agg(F.sum("n_tokens").alias("n")).collect():  # at most the product of the targets' categories
        cells[tuple(x.index(r[k]) for k, x in enumerate(names))] = r["n"]
    weights = rake(cells, [np.array([*t.values(), np.nan]) for t in marginals], targets.rounds, targets.tolerance)
    weighted = float((cells * weights).sum())
    budget = targets.budget * cells.sum() if targets.budget_tokens is None else targets.budget_tokens
    scale = budget / weighted if weighted > 0 else 1.0
    rows = [(*(x[k] for x, k in zip(names, at)), float(w), float(w * scale)) for at, w in np.ndenumerate(weights)]
    table = spark.createDataFrame(rows, "c0 string, c1 string, c2 string, weight double, expected double")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(targets.seed), "draw"), 11) / F.lit(float(1 << 53))
    return (
        d.join(F.broadcast(table), ["c0", "c1", "c2"])  # bounded by the targets' categories
        .withColumn("copies", (F.floor("expected") + (uniform < F.col("expected") - F.floor("expected")).cast("long")).cast("long"))
        .withColumn("copies", F.when(F.col("n_tokens") > 0, F.col("copies")).otherwise(F.least("copies", F.lit(1).cast("long"))))
        .select("row", "n_tokens", "topic", "weight", F.least("expected", F.lit(1.0)).alias("probability"), (F.col("copies") > 0).alias("selected"), "copies")
    )


def kept(mixed: DataFrame) -> DataFrame:
    """One row about a result of ``mix``: documents, kept_documents, tokens,
    kept_tokens (each document once), drawn_tokens (with copies)."""
    once = F.when(F.col("selected"), F.col("n_tokens")).otherwise(0)
    return mixed.agg(
        F.count("*").alias("documents"), F.count_if("selected").alias("kept_documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(once), F.lit(0)).alias("kept_tokens"), F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")), F.lit(0)).alias("drawn_tokens"),
    )
