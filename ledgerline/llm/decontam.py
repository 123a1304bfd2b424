"""Operator 4: benchmark decontamination with suffix arrays of the training text.

Shards are slices of documents inside Spark tasks.  A shard's words become
ids of benchmark words (0: not in the benchmark, so no match crosses it), and
the suffixes that start a run long enough for a whole window are sorted by
prefix doubling up to the longest item.  Every test suffix is then binary
searched, one word deeper at a time, giving all places of its window and its
longest verbatim match.  Shards need no exchange: results stay with the rows.

The benchmark is broadcast in hashed blocks of about ``block_bytes`` of text;
documents pass each block in turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import slices, utf8
from ledgerline.llm.words import letters, word_hashes

#: Fixed value: bytes that aren't part of a word.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

RESULT = "n_words long, n_hit long, spans array<long>, items array<long>, matches array<struct<item_id:long,item_at:long,doc_at:long,length:long>>"


@dataclass(frozen=True)
class Decontam:
    """``window`` words in a row are a hit; a document is contaminated when its
    hit words reach 1 / ``share`` of its words."""

    window: int = 13
    share: int = 20
    slice_bytes: int = 1 << 20
    block_bytes: int = 32 << 20


class TestSuffixes:
    """Word ids of benchmark items, one after another, each closed by a 0."""

    __test__ = False

    def __init__(self, rows: list[tuple[int | None, str]], window: int) -> None:
        self.ids = [i for i, _ in rows]
        sep, value = letters(SEPARATORS)
        data, offs = utf8(pa.array([t for _, t in rows], pa.large_string()))
        hashes, at = word_hashes(data, offs, sep, value)
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        size = np.diff(at)
        self.longest = int(size.max(initial=0))
        self.text = np.zeros(len(ids) + len(rows) + self.longest + 1, np.int64)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(rows)), size)
        self.text[place] = ids
        head = np.repeat(at[:-1], size)
        self.start = place
        self.at = np.arange(len(ids)) - head
        self.item = np.repeat(np.arange(len(rows)), size)
        own = np.repeat(size, size)
        self.need = np.minimum(own, window)
        # each window is searched through the suffix that starts it
        keep = self.at + self.need <= own
        self.start, self.at, self.item, self.need = self.start[keep], self.at[keep], self.item[keep], self.need[keep]
        self.shortest = int(self.need.min(initial=1))


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in order of the suffixes of ``text`` (0 ends a suffix),
    compared on their first ``depth`` words at least."""
    rank, k = text.astype(np.int64), 1
    while k < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-k] = rank[k:]
        live = np.flatnonzero(rank)
        key = rank[live] * (int(rank.max(initial=0)) + 1) + np.where(_reaches(text, live, k), ahead[live], 0)
        names, dense = np.unique(key, return_inverse=True)
        rank = np.zeros(len(rank), np.int64)
        rank[live] = dense + 1
        k *= 2
        if len(names) == len(live):
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def _reaches(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Whether the suffixes at ``at`` have more than ``k`` words before their 0."""
    zeros = np.flatnonzero(text == 0)
    end = np.append(zeros, len(text))[np.searchsorted(zeros, at)]
    return end - at > k


def search(text: np.ndarray, order: np.ndarray, test: TestSuffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, test suffixes, low, high) for every depth from 1: the suffixes of
    the array that share that many words with each test suffix."""
    q = np.arange(len(test.start))
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order))

    def bound(want: np.ndarray, low: np.ndarray, high: np.ndarray, d: int, right: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        for _ in range(max(1, int(np.max(b - a, initial=1))).bit_length()):
            mid = (a + b) // 2
            word = text[np.minimum(order[np.minimum(mid, len(order) - 1)] + d, len(text) - 1)]  # empty ranges may point beyond
            up = ((word <= want) if right else (word < want)) & (a < b)
            a = np.where(up, mid + 1, a)
            b = np.where(up | (a >= b), b, mid)
        return a

    d = 0
    while len(q):
        want = test.text[test.start[q] + d]
        live = want > 0
        q, low, high, want = q[live], low[live], high[live], want[live]
        left = bound(want, low, high, d, False)
        high = bound(want, left, high, d, True)
        live = left < high
        q, low, high = q[live], left[live], high[live]
        d += 1
        if len(q):
            yield d, q, low, high


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range that each belongs to."""
    size = high - low
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size), owner


class Shard:
    """Words of a slice of documents and where benchmark windows occur in them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, test: TestSuffixes, with_matches: bool) -> None:
        sep, value = letters(SEPARATORS)
        self.ids = test.ids
        hashes, self.at = word_hashes(data, offs, sep, value)
        self.n_words = np.diff(self.at)
        none = np.zeros(0, np.int64)
        self.hit_at, self.hit_size, self.hit_item, self.matches = none, none, none, (none,) * 4
        if not len(test.start) or not len(hashes):
            return
        near = np.minimum(np.searchsorted(test.vocabulary, hashes), len(test.vocabulary) - 1)
        ids = np.where(test.vocabulary[near] == hashes, near + 1, 0)
        # runs of benchmark words inside one document
        known = ids > 0
        first = known.copy()
        first[1:] &= ~known[:-1]
        heads = self.at[:-1][self.n_words > 0]
        first[heads] = known[heads]
        run_at = np.flatnonzero(first)
        last = np.ones(len(ids), bool)
        last[:-1] = first[1:] | ~known[1:]
        run_end = np.flatnonzero(last & known) + 1
        size = run_end - run_at
        long_ = size >= test.shortest
        run_at, size = run_at[long_], size[long_]
        if not len(run_at):
            return
        place, owner = _ranges(run_at, run_at + size)
        text = np.zeros(len(place) + len(run_at) + 1, np.int64)
        where = np.arange(len(place)) + owner
        text[where] = ids[place]
        word = np.zeros(len(text), np.int64)
        word[where] = place
        ends = np.repeat(np.cumsum(size + 1) - 1, size)
        order = suffix_array(text, where[ends - where >= test.shortest], test.longest)
        found, best = [], []
        before = None
        for d, q, low, high in search(text, order, test):
            whole = test.need[q] == d
            if whole.any():
                place, owner = _ranges(low[whole], high[whole])
                found.append((word[order[place]], np.full(len(place), d), test.item[q[whole]][owner]))
            if with_matches:
                if before is not None:
                    best.append(self._ended(before, q, word, order, test))
                before = (d, q, low, high)
        if with_matches and before is not None:
            best.append(self._ended(before, none, word, order, test))
        if found:
            self.hit_at, self.hit_size, self.hit_item = (np.concatenate(x) for x in zip(*found))
        if best:
            self.matches = tuple(np.concatenate(x) for x in zip(*best))

    @staticmethod
    def _ended(before: tuple, q: np.ndarray, word: np.ndarray, order: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, ...]:
        """Longest matches: test suffixes at least a window deep that go no deeper."""
        d, was, low, high = before
        done = ~np.isin(was, q) & (test.need[was] <= d)
        place, owner = _ranges(low[done], high[done])
        return test.item[was[done]][owner], test.at[was[done]][owner], word[order[place]], np.full(len(place), d)

    def rows(self) -> tuple[list[list[int]], list[list[int]], list[list[dict]]]:
        """Per document: merged hit spans (flat), items, longest matches."""
        n = len(self.n_words)
        spans: list[list[int]] = [[] for _ in range(n)]
        items: list[list[int]] = [[] for _ in range(n)]
        matches: list[list[dict]] = [[] for _ in range(n)]
        doc = np.searchsorted(self.at, self.hit_at, "right") - 1
        order = np.argsort(doc, kind="stable")
        names, first = np.unique(doc[order], return_index=True)
        for i, mine in zip(names.tolist(), np.split(order, first[1:])):
            a = self.hit_at[mine] - self.at[i]
            spans[i] = merge(a, a + self.hit_size[mine])
            items[i] = sorted({self.ids[k] for k in np.unique(self.hit_item[mine]).tolist()} - {None})
        item, item_at, at, size = self.matches
        for i, m in zip((np.searchsorted(self.at, at, "right") - 1).tolist(), zip(item.tolist(), item_at.tolist(), at.tolist(), size.tolist())):
            matches[i].append({"item_id": self.ids[m[0]], "item_at": m[1], "doc_at": m[2] - int(self.at[i]), "length": m[3]})
        return spans, items, matches


def merge(low: np.ndarray, high: np.ndarray) -> list[int]:
    """Union of [low, high) spans, flat: start, end, start, end, ..."""
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return np.column_stack([low[new], high[np.r_[new[1:] - 1, len(high) - 1]]]).ravel().tolist()


def _pass(broadcast, width: int, text_at: int, names: list[str], p: Decontam, with_matches: bool):
    """One block of the benchmark over documents: ``width`` carried columns, then
    spans, items and matches of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = broadcast.value
        for batch in batches:
            data, offs = utf8(batch.column(text_at))
            for a, b in slices(offs, p.slice_bytes):
                part = batch.slice(a, b - a)
                shard = Shard(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], test, with_matches)
                spans, items, matches = shard.rows()
                earlier = [part.column(width + k).to_pylist() for k in range(3)]
                n_hit = []
                for i in range(b - a):
                    if earlier[0][i]:
                        both = np.array(earlier[0][i] + spans[i], np.int64)
                        spans[i] = merge(both[::2], both[1::2])
                    if earlier[1][i]:
                        items[i] = sorted({*items[i], *earlier[1][i]})
                    matches[i] += earlier[2][i]
                    n_hit.append(sum(spans[i][1::2]) - sum(spans[i][::2]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:width],
                        pa.array(shard.n_words.astype(np.int64)),
                        pa.array(n_hit, pa.int64()),
                        pa.array(spans, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.int64())),
                        pa.array(matches, pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "item_at", "doc_at", "length")]))),
                    ],
                    names,
                )

    return run


def _blocks(benchmark: DataFrame, p: Decontam, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in hashed blocks; items without text are left out."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).dropna(subset="text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / p.block_bytes))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def annotate(
    docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), text_col: str = "text", carry: list[str] | None = None,
    with_matches: bool = False, item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``row`` (struct of the ``carry`` columns, all by
    default), n_words, n_hit, spans, items, matches.

    * spans: word ranges [start, end) inside occurrences of benchmark windows,
      flat; items: ids of items with occurring windows; matches: where each
      test suffix has its longest verbatim match in the shard.
    * An item of fewer words than a window is one window; one without words,
      or with NULL text, has none.  Items sharing an id are one item; one
      with NULL id has windows that hit words, but is not in ``items``.
    * NULL and empty texts have no words.  Rows are independent: repeated rows
      give repeated results.  No column of ``docs`` clashes with the results.
      An empty table, of documents or of items, gives rows without hits.
    """
    spark = docs.sparkSession
    keep = docs.columns if carry is None else carry
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    df = docs.select(
        row.alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<long>").alias("spans"),
        F.lit(None).cast("array<long>").alias("items"), F.expr("cast(array() as array<struct<item_id:long,item_at:long,doc_at:long,length:long>>)").alias("matches"),
    )
    base = df.schema["row"]
    found = T._parse_datatype_string(RESULT)
    for block in _blocks(benchmark, p, item_col, item_text_col):
        schema = T.StructType([base, df.schema["text"], *found.fields])
        test = spark.sparkContext.broadcast(TestSuffixes(block, p.window))
        df = df.select("row", "text", "spans", "items", "matches").mapInArrow(_pass(test, 2, 1, schema.fieldNames(), p, with_matches), schema)
    return df.drop("text")


def contaminated(p: Decontam = Decontam()):
    return (F.col("n_hit") > 0) & (F.lit(p.share) * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    return annotate(docs, benchmark, p, text_col).filter(~contaminated(p)).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document.

    items_sha256: lowercase hex SHA-256 of the item ids, sorted as strings and
    joined by commas (of the empty string where there are none).
    """
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return annotate(docs, benchmark, p, text_col, [id_col]).select(
        F.col(f"row.{id_col}").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), contaminated(p).alias("contaminated"),
    )
