"""Five stages from raw documents to a training mix (part of subpackage llm).

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all
of their columns; ``run`` writes each result as Parquet under the shared
folder and reads it back for the next stage, so a lost executor never costs
more than the current stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, fresh, read_table
from ledgerline.llm.decontam import decontaminate
from ledgerline.llm.langid import LangId, drop_undetermined
from ledgerline.llm.mixing import mix
from ledgerline.llm.near_dup import drop_near_duplicates
from ledgerline.llm.secrets import mask_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of undetermined language go (operator 5); texts that no model fits
    stay if they alone declare their language."""
    return drop_undetermined(docs, LangId(trust_rare=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five
    words, similarity 0.8 or more (operator 1)."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go (operator 4)."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by [SECRET], n_chars counted anew (operator 8)."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics
    (operator 3); adds topic, n_tokens, weight, probability and copies, the
    times a document is to be read. A name that a document has as a column gets
    underscores until it is new."""
    added = ("topic", "n_tokens", "weight", "probability", "copies")
    return mix(docs).filter("selected").select("row.*", *[F.col(c).alias(n) for c, n in zip(added, fresh(docs, *added))])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("mixing", mixing),
]

#: Connected components, a trained tagger and raking aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
