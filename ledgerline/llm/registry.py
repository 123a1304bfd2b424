"""Queries of the thirteen operators over whole tables, and DuckDB SQL for those
that SQL expresses.  The others are tested against brute force in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, chat, decontam, html_text, langid, licenses, lloyd, mixing, near_dup, periodic, secrets, tokens, vector_dup
from ledgerline.llm.common import read_table
from ledgerline.llm.known_licenses import LICENSES, NOTICES

#: Fixed value: the vocabulary file of the contract.
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the rank file of the contract.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the conversation that the contract adds.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), near_dup.NearDup(shingle=2))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    return d.select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", "weight", "probability", "selected", "copies")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).drop("mark")


def op5_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), str(public_tokenizers.path(VOCABULARY)))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.windows(turns))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return periodic.digests(periodic.periodic_runs(docs))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = str(public_tokenizers.path(RANK_FILE)), public_tokenizers.PATTERN
    ids = byte_bpe.encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern)
    return byte_bpe.digests(byte_bpe.decode(ids, path, pattern))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.report(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_minhash_near_dup, op2_embedding_near_dup, op3_source_mixing, op4_decontamination, op5_language_id,
            op6_license_scan, op7_html_text, op8_secret_scan, op9_token_counts, op10_chat_format, op11_periodic_runs, op12_byte_bpe, op13_centroid_clusters,
        )
    }


def more_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Operators over a second table."""
    return {op5_language_id_pages.__name__: op5_language_id_pages}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[j:j + 1] AS g FROM words, unnest(range(1, greatest(len(w), 2))) AS t(j) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS id, a AS to_id FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.to_id = both_ways.a
), component AS (
  SELECT id, min(to_id) AS lowest FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(lowest, d.doc_id) AS component_id, coalesce(lowest, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN component ON id = d.doc_id
"""

OP2_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reach AS (
  SELECT a AS id, a AS to_id FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.to_id = links.a
), component AS (
  SELECT id, min(to_id) AS lowest FROM reach GROUP BY id
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(lowest, e.vec_id) AS component_id, coalesce(lowest, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree ON degree.a = e.vec_id LEFT JOIN component ON component.id = e.vec_id
"""

OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS s, w[j:j + least(13, len(w)) - 1] AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(j) WHERE len(w) > 0
), doc_windows AS (
  SELECT doc_id, s, j, w[j:j + s - 1] AS g FROM d, (SELECT DISTINCT s FROM item_windows), unnest(range(1, len(w) - s + 2)) AS t(j) WHERE len(w) >= s
), hits AS (
  SELECT doc_id, j, s, item_id FROM doc_windows JOIN item_windows USING (s, g)
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(j, j + s)) AS t(k) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op6_sql() -> str:
    """The same canonical form, spelled in DuckDB."""
    marks = licenses.PUNCTUATION
    for c in "\t\r\x0b\x0c":
        marks = marks.replace(c, "")
    t = f"translate(replace(text, '©', '(c)'), {_quoted(licenses.UPPER + marks)} || chr(9) || chr(13) || chr(11) || chr(12), {_quoted(licenses.LOWER + ' ' * len(licenses.PUNCTUATION))})"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    for a, b in licenses.SPELLINGS:
        t = f"replace({t}, {_quoted(a)}, {_quoted(b)})"

    def lines(source: str) -> str:
        trimmed = f"list_transform(string_split(({t}), chr(10)), lambda x: trim(x, ' '))"
        return f"SELECT *, list_filter({trimmed}, lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(licenses.COPYRIGHT)})) AS lines FROM {source}"

    def values(texts: dict[str, str]) -> str:
        return "(VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in texts.items()) + ") AS v(license_id, text)"

    return f"""
WITH known AS (SELECT license_id, array_to_string(lines, ' ') AS whole FROM ({lines(values(LICENSES))})),
notices AS (SELECT license_id, array_to_string(lines, ' ') AS line FROM ({lines(values(NOTICES))})),
d AS ({lines("(SELECT doc_id, coalesce(text, '') AS text FROM documents)")}),
seen AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices
  FROM (SELECT doc_id, unnest(lines) AS line FROM d) JOIN notices USING (line) GROUP BY doc_id
)
SELECT doc_id, license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM d LEFT JOIN known ON array_to_string(d.lines, ' ') = known.whole LEFT JOIN seen USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dup": OP1_SQL, "op2_embedding_near_dup": OP2_SQL, "op4_decontamination": OP4_SQL, "op6_license_scan": op6_sql()}
