"""Operator 5: language identification by Bayesian evidence fusion.

log posterior(language) = ``temper`` * log P(text | language)
    + log P(declared markup language | language) + log P(address suffix | language)
    + log prior(language | host)

* Languages: the primary subtags declared by at least ``least_rows`` rows, counted
  in the table, so every one of them has a model.
* Text: letter trigrams against counts of all other texts by declared language.  The
  class ``und`` has a uniform trigram model, so text of no known language is
  undetermined.  temper discounts the dependence of overlapping trigrams.
* Declared language and address suffix: confusion counts with the text's own
  posterior, over all rows, smoothed.
* Host: expected language counts of the host, smoothed towards its domain's,
  those towards the whole corpus's (Dirichlet, ``strength`` pseudo-rows each).
  A row's own vote is left out of its host's counts.

Counts come from grouped aggregates with map-side combining.  Tables that
reach the driver are bounded by languages and trigram codes; suffix, host and
domain tables stay distributed and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import html_text
from ledgerline.llm.common import cut, fresh, slices, utf8

UND = "und"
CODES = 1 << 18
#: Fixed values of ISO 639: codes that name no language.
NO_LANGUAGE = (UND, "mis", "mul", "zxx")


@dataclass(frozen=True)
class LangId:
    """``languages``: None for all that ``least_rows`` rows declare.  A text doesn't
    speak for itself, so a language declared once has nothing to be compared with.
    ``trust_rare``: a text of such a language that no model fits keeps the language
    it is declared in; without it, it is undetermined."""

    languages: tuple[str, ...] | None = None
    least_rows: int = 2
    trust_rare: bool = False
    #: Languages whose counts a task holds before it hands them on (2 MB each).
    held: int = 32
    temper: float = 0.2
    smoothing: float = 0.05
    strength: float = 10.0
    und_prior: float = 1e-3
    least_confidence: float = 0.5
    slice_bytes: int = 256 << 10

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.languages, UND)


def _letters() -> np.ndarray:
    """6-bit letter classes of bytes: 0 no letter, a-z (A-Z alike), 37 for the
    bytes of letters beyond ASCII."""
    out = np.zeros(256, np.int32)
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = 27 + np.arange(128) % 37
    return out


LETTERS = _letters()


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code centred on each letter, first code of each text); borders of a
    text count as no letter."""
    own = LETTERS[data]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads = offs[:-1][np.diff(offs) > 0]
    before[heads] = 0
    after[offs[1:][np.diff(offs) > 0] - 1] = 0
    at = np.flatnonzero(own)
    return ((before << 12) | (own << 6) | after)[at], np.searchsorted(at, offs)


def long_text_counts(data: np.ndarray, step: int) -> np.ndarray:
    """Times of every code in one text, read ``step`` bytes at a time."""
    out = np.zeros(CODES, np.int64)
    for s in range(0, len(data), step):
        e = min(s + step, len(data))
        low, high = max(s - 1, 0), min(e + 1, len(data))
        # a letter of the neighbouring pieces on either side
        codes, _ = trigrams(data[low:high], np.array([0, high - low]))
        place = np.flatnonzero(LETTERS[data[low:high]])
        out += np.bincount(codes[(place >= s - low) & (place < e - low)], minlength=CODES)
    return out


def text_counts(data: np.ndarray, offs: np.ndarray, slice_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, text from a, code, times) of the texts a to b; a text longer than
    a slice comes alone and is counted piece by piece."""
    for a, b in slices(offs, slice_bytes):
        part = data[offs[a] : offs[b]]
        if len(part) > slice_bytes:
            times = long_text_counts(part, slice_bytes)
            code = np.flatnonzero(times)
            yield a, b, np.zeros(len(code), np.int64), code, times[code]
        else:
            codes, at = trigrams(part, offs[a : b + 1] - offs[a])
            keys, times = np.unique(np.repeat(np.arange(b - a), np.diff(at)) * CODES + codes, return_counts=True)
            yield a, b, keys // CODES, keys % CODES, times


def primary(declared: Column) -> Column:
    """Primary subtag of a language tag, lower case; NULL where there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared.cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def declared_in_markup(html: Column) -> Column:
    """The lang attribute of the html element."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))


def declared_languages(docs: DataFrame, declared_col: str | None, least_rows: int) -> tuple[str, ...]:
    """Primary subtags that at least ``least_rows`` rows declare, the most frequent first."""
    if not declared_col:
        return ()
    found = docs.select(primary(F.col(declared_col)).alias("k")).filter(F.col("k").isNotNull() & ~F.col("k").isin(*NO_LANGUAGE))
    found = found.groupBy("k").count().filter(F.col("count") >= least_rows)
    return tuple(r["k"] for r in found.orderBy(F.desc("count"), "k").collect())  # at most the subtags of two or three letters


def evidence(docs: DataFrame, p: LangId, id_col: str, text_col: str, declared_col: str | None, host_col: str | None, url_col: str | None) -> DataFrame:
    """doc_id, mark, declared, host, domain, suffix, rare, text.  mark tells apart the
    texts of one id; rare is a declared language that has no model."""
    none = F.lit(None).cast("string")
    url = F.col(url_col).cast("string") if url_col else none
    host = F.lower(F.col(host_col).cast("string") if host_col else F.regexp_extract(url, "^[A-Za-z]+://([^/:?#]+)", 1))
    host = F.nullif(host, F.lit(""))
    declared = primary(F.col(declared_col)) if declared_col else none
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("mark"),
        F.when(declared.isin(*p.languages), declared).alias("declared"),
        host.alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.nullif(F.regexp_extract(host, r"\.([^.0-9][^.]*)$", 1), F.lit("")).alias("suffix"),
        F.when(~declared.isin(*p.languages, *NO_LANGUAGE), declared).alias("rare"),
        text.alias("text"),
    )


def _count(p: LangId):
    """(language, code, n) of the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(p.languages)}
        counts: dict[int, np.ndarray] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for k, n in counts.items():
                code = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code.astype(np.int32)), pa.array(n[code])], ["k", "code", "n"])
            counts.clear()

        for batch in batches:
            data, offs = utf8(batch.column(1))
            which = np.array([number[x] for x in batch.column(0).to_pylist()])
            for a, b, doc, code, times in text_counts(data, offs, p.slice_bytes):
                mine = which[a:b][doc]
                for k in np.unique(mine).tolist():
                    if k not in counts and len(counts) >= p.held:
                        yield from held()
                    on = mine == k
                    np.add.at(counts.setdefault(k, np.zeros(CODES, np.int64)), code[on], times[on])
        yield from held()

    return run


class TextModel:
    """Trigram counts per language, and log P(trigram | class) from them; a
    column per trigram seen in any language, the first for all others."""

    def __init__(self, languages: int, k: np.ndarray, code: np.ndarray, n: np.ndarray, smoothing: float) -> None:
        seen = np.unique(code)
        self.column = np.zeros(CODES, np.int32)
        self.column[seen] = np.arange(1, len(seen) + 1)
        self.counts, self.smoothing = np.zeros((languages, len(seen) + 1)), smoothing
        self.counts[k, self.column[code]] = n
        self.logs = np.log((self.counts + smoothing) / (self.counts.sum(axis=1, keepdims=True) + smoothing * CODES))

    def likelihoods(self, n: int, doc: np.ndarray, code: np.ndarray, times: np.ndarray, declared: np.ndarray) -> np.ndarray:
        """Sum of logs per text (``n`` rows) and class (columns; the last is
        uniform) from the times of each code in each text.

        A text's own trigrams are taken out of the counts of the language it is
        declared in, as a text would speak for itself otherwise.
        """
        size = np.bincount(doc, times, n)
        out = np.empty((n, len(self.counts) + 1))
        out[:, -1] = size * -np.log(CODES)
        code = self.column[code]
        for k, row in enumerate(self.counts):
            mine = declared == k
            logs = self.logs[k][code]
            voted = mine[doc]
            logs[voted] = np.log(np.maximum(row[code[voted]] - times[voted], 0) + self.smoothing)
            out[:, k] = np.bincount(doc, times * logs, n)
            out[mine, k] -= size[mine] * np.log(np.maximum(row.sum() - size[mine], 0) + self.smoothing * CODES)
        return out


def text_model(rows: DataFrame, p: LangId) -> TextModel:
    """Trigram counts of all rows with a declared language."""
    found = rows.filter("declared IS NOT NULL AND text IS NOT NULL").select("declared", "text").mapInArrow(_count(p), "k int, code int, n long")
    # at most languages x codes rows
    table = found.groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()
    return TextModel(len(p.languages), *(table.column(c).to_numpy() for c in ("k", "code", "n")), p.smoothing)


def _score(broadcast, p: LangId):
    """Tempered log likelihoods and the text posterior under flat priors."""
    flat = np.log(np.array([(1 - p.und_prior) / max(1, len(p.languages))] * len(p.languages) + [p.und_prior]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        number = {x: k for k, x in enumerate(p.languages)}
        for batch in batches:
            data, offs = utf8(batch.column(batch.num_columns - 1))
            declared = np.array([number.get(x, -1) for x in batch.column(2).to_pylist()])
            for a, b, doc, code, times in text_counts(data, offs, p.slice_bytes):
                letters = np.bincount(doc, times, b - a).astype(np.int64)
                like = p.temper * model.likelihoods(b - a, doc, code, times, declared[a:b])
                post = like + flat
                post = np.exp(post - post.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                # text without letters is no evidence for any language
                post[letters == 0] = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a) for c in batch.columns[:-1]),
                        pa.array(letters),
                        pa.array(list(like), pa.list_(pa.float64())),
                        pa.array(list(post), pa.list_(pa.float64())),
                    ],
                    ["doc_id", "mark", "declared", "host", "domain", "suffix", "rare", "n_letters", "like", "post"],
                )

    return run


def _sums(p: LangId, column: str = "post") -> Column:
    return F.array(*[F.sum(F.col(column)[k]) for k in range(len(p.classes))])


def _confusion(scored: DataFrame, column: str, p: LangId) -> DataFrame | None:
    """``column`` and ``of_column``, log P(value | class) as an array, of all
    values (a written table); None if there are none."""
    counts = cut(scored.filter(F.col(column).isNotNull()).groupBy(column).agg(_sums(p).alias("n")), f"{column}s")
    all_ = counts.agg(F.count("*").alias("values"), _sums(p, "n").alias("n")).first()
    if not all_["values"]:
        return None
    sizes = F.array(*[F.lit(x + p.smoothing * all_["values"]) for x in all_["n"]])
    return counts.select(column, F.zip_with("n", sizes, lambda x, y: F.log((x + p.smoothing) / y)).alias(f"of_{column}"))


def identify(
    docs: DataFrame, p: LangId = LangId(), id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
    host_col: str | None = "source", url_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, mark, declared, language, confidence, accepted.

    language is ``und`` and accepted false where the text has no letters, the
    best class is ``und``, or its posterior is below ``least_confidence``.  With
    ``trust_rare`` such a text with letters is accepted as the language it is declared
    in, confidence 0, if no model stands for that language for want of rows.

    * Without ``languages`` they are those declared in the table (``declared_languages``).
    * NULL or empty text is undetermined.  A NULL or unknown declared language,
      host or suffix adds no evidence of its own.
    * Repeated rows give repeated results and each counts as evidence; rows of
      one doc_id are told apart by mark, a hash of the text.
    * Ties go to the first language listed, else to the one declared more often.  Extra columns are ignored; an
      empty table gives an empty result.
    """
    spark = docs.sparkSession
    trust_rare = p.trust_rare and p.languages is None  # languages that the caller leaves out are not wanted
    if p.languages is None:
        p = replace(p, languages=declared_languages(docs, declared_col, p.least_rows))
    rows = evidence(docs, p, id_col, text_col, declared_col, host_col, url_col)
    model = spark.sparkContext.broadcast(text_model(rows, p))  # classes x codes floats
    scored = rows.mapInArrow(
        _score(model, p), "doc_id long, mark long, declared string, host string, domain string, suffix string, rare string, n_letters long, like array<double>, post array<double>"
    )
    scored = cut(scored, "scored")
    n = len(p.classes)
    total = np.array([x or 0.0 for x in scored.agg(_sums(p).alias("n")).first()["n"]]) + p.smoothing
    total = total / total.sum()
    flat = F.array(*[F.lit(0.0)] * n)
    hosts = cut(scored.filter("host IS NOT NULL").groupBy("host").agg(_sums(p).alias("of_host")), "hosts")
    domains = cut(scored.filter("domain IS NOT NULL").groupBy("domain").agg(_sums(p).alias("of_domain")), "domains")
    all_ = scored.join(hosts, "host", "left").join(domains, "domain", "left")
    said = {c: _confusion(scored, c, p) for c in ("declared", "suffix")}
    for c, table in said.items():
        if table is not None:
            all_ = all_.join(table, c, "left")
    declared, suffix = (flat if table is None else F.coalesce(f"of_{c}", flat) for c, table in said.items())

    def smoothed(counts: str, towards: Column) -> Column:
        """Dirichlet mean without the row's own vote; counts are NULL for no host."""
        zero = F.array(*[F.lit(0.0)] * n)
        others = F.zip_with(F.coalesce(F.col(counts), zero), F.when(F.col(counts).isNull(), zero).otherwise(F.col("post")), lambda x, y: F.greatest(x - y, F.lit(0.0)))
        size = F.aggregate(others, F.lit(0.0), lambda a, x: a + x) + p.strength
        return F.transform(F.zip_with(others, towards, lambda x, y: x + p.strength * y), lambda x: x / size)

    all_ = all_.withColumn("of_domain", smoothed("of_domain", F.array(*map(F.lit, total.tolist()))))
    all_ = all_.withColumn("prior", smoothed("of_host", F.col("of_domain")))
    evidence_sum = F.zip_with(F.zip_with(F.col("like"), F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with(declared, suffix, lambda a, b: a + b), lambda a, b: a + b)
    all_ = all_.withColumn("fused", evidence_sum).withColumn("top", F.array_max("fused"))
    best = F.element_at(F.array(*map(F.lit, p.classes)), F.array_position("fused", F.col("top")).cast("int"))
    confidence = 1 / F.aggregate(F.transform("fused", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    letters = F.col("n_letters") > 0
    language = F.when(letters & (confidence >= p.least_confidence), best).otherwise(UND)
    confidence = F.when(letters, confidence).otherwise(0.0)
    if trust_rare:
        on_trust = letters & F.col("rare").isNotNull() & (language == UND)
        language, confidence = F.when(on_trust, F.col("rare")).otherwise(language), F.when(on_trust, 0.0).otherwise(confidence)
    found = all_.select("doc_id", "mark", "declared", language.alias("language"), confidence.alias("confidence"))
    return found.withColumn("accepted", F.col("language") != UND)


def identify_pages(pages: DataFrame, p: LangId = LangId(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` over web pages: the main text (operator 7), the language that
    the markup declares, and host, domain and suffix of the address.

    One row per page: page_id, declared, language, confidence, accepted.
    """
    said = F.struct(F.col(url_col).cast("string").alias("url"), declared_in_markup(F.col(html_col).cast("string")).alias("lang"))
    rows = pages.select(F.col(id_col).alias("page_id"), said.alias("said"), F.col(html_col).alias("html"))
    texts = cut(html_text.extract(rows, url_col="said").select("page_id", "url.url", "url.lang", "text"), "page_texts")
    return identify(texts, p, "page_id", "text", "lang", None, "url").withColumnRenamed("doc_id", "page_id").drop("mark")


def drop_undetermined(docs: DataFrame, p: LangId = LangId(), id_col: str = "doc_id", text_col: str = "text", **columns: str | None) -> DataFrame:
    """The documents, all columns, whose language is determined.

    Only the ids of rejected rows are joined back; Spark broadcasts them where
    the written table is small enough.
    """
    rejected, mark = fresh(docs, "_rejected", "_mark")
    out = identify(docs, p, id_col, text_col, **columns).filter("NOT accepted").select(F.col("doc_id").alias(rejected), F.col("mark").alias(mark))
    out = cut(out.distinct(), "rejected")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(rejected)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(mark))
    return docs.join(out, same, "left_anti")
