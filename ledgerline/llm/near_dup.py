"""Operator 1: near-duplicate documents by b-bit MinHash.

Sketch   whole texts -> distinct word shingles -> ``minima`` minima; their low
         ``bits`` bits packed as bit planes; ``bands`` band keys over the minima.
Classes  texts with one shingle set collapse into a class (smallest doc_id).
Hubs     the smallest id of a band bucket is its hub; every class is paired
         with the hub it shares most bands with: one candidate per class.
Filter   a candidate goes on if the collision-corrected similarity, estimated
         from bit counts of the packed signatures, is within 6 standard
         errors of the threshold.
Confirm  similarity on the full shingle sets, then connected components.
Rest     buckets whose classes are still in several components are compared
         in blocks: pairs across components pass the same filter and are
         checked on the full sets inside the task, which returns a star per
         linked group; so no link between different components is lost to the
         hubs, and no list of pairs leaves a task.

At similarity 0.8 a pair misses all 40 bands of 6 with probability 5e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import block_pairs, connected_components, cut, fresh, lowest_reachable, slices, utf8
from ledgerline.llm.words import letters, mix, shingle_hashes, word_hashes

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class NearDup:
    """Parameters; ``percent`` is the similarity threshold in per cent."""

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    bits: int = 4
    slice_bytes: int = 1 << 20
    block_rows: int = 512

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Equal b-bit minima that a pair at the threshold has, less 6 standard errors."""
        c = 0.5**self.bits
        p = c + (1 - c) * self.percent / 100
        return math.floor(self.minima * p - 6 * math.sqrt(self.minima * p * (1 - p)))


def _sets(column: pa.Array, p: NearDup) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offs = utf8(column)
    sep, value = letters(SPACE)
    for a, b in slices(offs, p.slice_bytes):
        words, at = word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], sep, value)
        yield a, b, shingle_hashes(words, at, p.shingle)


def _binaries(rows: np.ndarray) -> pa.Array:
    """Rows of a uint8 matrix as a binary column."""
    n, width = rows.shape
    offs = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(rows))])


def _sketch(sets: list[np.ndarray], p: NearDup) -> tuple[np.ndarray, ...]:
    """(set hash high, set hash low, band keys, packed planes) of non-empty sets."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0] + [len(s) for s in sets[:-1]])
    high = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), heads)
    low = np.add.reduceat(mix(flat + np.uint64(0x14057B7EF767814F)), heads)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 32, p.minima, dtype=np.uint32) | np.uint32(1)
    terms = rng.integers(0, 1 << 32, p.minima, dtype=np.uint32)
    minima = np.empty((p.minima, len(sets)), np.uint32)
    for k in range(p.minima):
        minima[k] = np.minimum.reduceat(x * factors[k] + terms[k], heads)
    keys = np.empty((len(sets), p.bands), np.uint64)
    for band in range(p.bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for row in minima[band * p.rows : (band + 1) * p.rows]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, band] = key
    scrambled = mix(minima.astype(np.uint64))
    planes = [np.packbits(((scrambled >> np.uint64(k)) & np.uint64(1)).astype(np.uint8).T, axis=1) for k in range(p.bits)]
    return high, low, keys, np.hstack(planes)


def _sketches(p: NearDup):
    names = ["doc_id", "mark", "n_shingles", "h1", "h2", "keys", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(2), p):
                full = [s for s in sets if len(s)]
                at = np.cumsum([0] + [1 if len(s) else 0 for s in sets])
                n = len(sets)
                h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
                keys = [None] * n
                sig: list = [None] * n
                if full:
                    high, low, band, planes = _sketch(full, p)
                    some = np.flatnonzero(np.diff(at))
                    h1[some], h2[some] = high.view(np.int64), low.view(np.int64)
                    for k, i in enumerate(some.tolist()):
                        keys[i], sig[i] = band[k].view(np.int64), planes[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h1),
                        pa.array(h2),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sig, pa.binary()),
                    ],
                    names,
                )

    return run


def sketches(docs: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, set hash (h1, h2), band keys
    and packed signature per row of (doc_id, text)."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(
        _sketches(p), "doc_id long, mark long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary"
    )


def _planes(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint8) for x in column.to_pylist()])


def equal_minima(a: np.ndarray, b: np.ndarray, bits: int, minima: int) -> np.ndarray:
    """Count of equal b-bit minima of packed signatures (bit planes side by side)."""
    width = a.shape[-1] // bits
    differ = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], bits, width)
    return minima - np.bitwise_count(np.bitwise_or.reduce(differ, axis=-2)).sum(axis=-1, dtype=np.int64)


def _estimate(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = equal_minima(_planes(batch.column(2)), _planes(batch.column(3)), p.bits, p.minima) >= p.least_matches
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    return run


def _similar(p: NearDup):
    """Pairs that reach the threshold on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= p.percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n (size of its set) and delta: what its set and the base don't share."""
    for batch in batches:
        sets, bases = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (1, 2))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([np.setxor1d(s, t, assume_unique=True).tobytes() for s, t in zip(sets, bases)], pa.binary()),
            ],
            ["rep", "n", "delta"],
        )


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with those of ``right``.

    Only values of both sides matter; they are the columns of 0/1 matrices that
    are multiplied ``width`` columns at a time.
    """
    flat = [np.concatenate(s) for s in (left, right)]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    common = np.intersect1d(*flat)
    entries = []
    for values, rows in zip(flat, owner):
        column = np.searchsorted(common, values)
        there = column < len(common)
        there[there] = common[column[there]] == values[there]
        column, rows = column[there], rows[there]
        order = np.argsort(column, kind="stable")
        entries.append((column[order], rows[order]))
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(common), width):
        parts = []
        for (column, rows), n in zip(entries, (len(left), len(right))):
            a, b = np.searchsorted(column, [at, at + width])
            part = np.zeros((n, min(width, len(common) - at)), np.float32)
            part[rows[a:b], column[a:b] - at] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _cross(p: NearDup):
    """Links across components within pairs of blocks, as a star per group of
    linked representatives.

    Deltas are against one base, so the symmetric difference of two sets is
    that of their deltas, and the check is on the full sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                yield from linked(left.as_py(), right.as_py())

    def linked(left: list[dict], right: list[dict]) -> Iterator[pa.RecordBatch]:
        own = not right
        right = right or left
        component = np.array([x["component"] for x in right])
        sig = np.array([np.frombuffer(x["sig"], np.uint8) for x in right])
        near = np.zeros((len(left), len(right)), bool)
        for i, x in enumerate(left):
            other = np.flatnonzero(component != x["component"])
            other = other[other > i] if own else other
            close = equal_minima(np.frombuffer(x["sig"], np.uint8)[None, :], sig[other], p.bits, p.minima) >= p.least_matches
            near[i, other[close]] = True
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return
        one, two = [left[i] for i in rows], [right[j] for j in columns]
        deltas = [[np.frombuffer(x["delta"], np.uint64) for x in s] for s in (one, two)]
        apart = [np.array([len(d) for d in s]) for s in deltas]
        size = [np.array([x["n"] for x in s]) for s in (one, two)]
        total = size[0][:, None] + size[1][None, :]
        both = (total - (apart[0][:, None] + apart[1][None, :] - 2 * shared_counts(*deltas))) // 2
        x, y = np.nonzero(near[np.ix_(rows, columns)] & (100 * both >= p.percent * (total - both)))
        if not len(x):
            return
        a, b = np.array([r["rep"] for r in one])[x], np.array([r["rep"] for r in two])[y]
        ids = np.unique(np.concatenate([a, b]))
        root = lowest_reachable(np.searchsorted(ids, a), np.searchsorted(ids, b), len(ids))
        away = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[away]]), pa.array(ids[away])], ["a", "b"])

    return run


def _set_rows(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), p):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"]
                )

    return run


def shingle_sets(docs: DataFrame, ids: DataFrame, p: NearDup) -> DataFrame:
    """Full shingle sets of the documents in ``ids`` (doc_id), written once.

    The ids grow with the data, so they are never broadcast: each side is
    dealt by id and the smaller one hashed.
    """
    texts = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text")
    return cut(texts.mapInArrow(_set_rows(p), "doc_id long, shingles binary"), "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(_similar(p), "a long, b long")


def deltas(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, n, delta of the classes in open buckets (rest: key, rep).

    Classes that meet in a bucket, also by way of others, have one base: the
    set of the smallest of them.  What differs from it is far smaller than a
    set where texts are alike, and is sent instead.
    """
    lows = rest.groupBy("key").agg(F.min("rep").alias("low"))
    base_of = connected_components(rest.join(lows, "key").select("rep", "low"), "rep", "low").withColumnRenamed("id", "doc_id")
    base_of = cut(base_of, "bases")
    base = sets.join(base_of.select(F.col("component").alias("doc_id")).distinct(), "doc_id", "left_semi")
    base = base.groupBy(F.col("doc_id").alias("component")).agg(F.min("shingles").alias("base"))
    own = sets.join(base_of, "doc_id").join(base, "component")
    return cut(own.select("doc_id", "shingles", "base").mapInArrow(_deltas, "rep long, n long, delta binary"), "deltas")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, n_shingles, class_id, component_id, kept.

    * NULL or empty text, or text without words: no shingles, linked with
      nothing, its own component, kept.
    * A NULL doc_id is linked with nothing; component_id is NULL, kept.
    * Repeated rows give repeated results; rows sharing a doc_id are told apart
      by mark, a hash of the text.
    * Extra input columns are ignored.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = cut(sketches(docs, p), "sketches")
    some = table.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = cut(classes, "classes")
    sigs = classes.select("rep", "sig")
    members = classes.select("rep", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    shared = cut(members.join(cut(buckets, "buckets"), "key"), "members")

    # one candidate per class: the hub it shares most bands with
    common = shared.filter("rep != hub").groupBy("rep", "hub").count()
    hubs = common.groupBy("rep").agg(F.max(F.struct("count", -F.col("hub"))).alias("best")).select((-F.col("best.col2")).alias("a"), F.col("rep").alias("b"))
    hubs = (
        cut(hubs, "hubs")
        .join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_estimate(p), "a long, b long")
    )
    sets = shingle_sets(docs.filter("doc_id IS NOT NULL"), shared.select(F.col("rep").alias("doc_id")).distinct(), p)
    links = cut(confirm(cut(hubs, "hub-pairs"), sets, p), "links")
    found = connected_components(links, "a", "b")

    labelled = shared.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    labelled = cut(labelled, "labelled")
    open_ = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    open_ = cut(open_, "open")
    rest = cut(labelled.join(open_, "key", "left_semi"), "rest")
    rows = rest.join(sigs, "rep").join(deltas(rest, sets), "rep")
    cross = block_pairs(rows, ["key"], "rep", ["rep", "component", "sig", "n", "delta"], p.block_rows, F.length("delta"))
    more = cut(cross.select("left", "right").mapInArrow(_cross(p), "a long, b long"), "links")
    found = connected_components(links.union(more), "a", "b")

    of_class = (
        classes.select("h1", "h2", "n_shingles", "rep")
        .join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select("h1", "h2", "n_shingles", "rep", F.coalesce("component", "rep").alias("component"))
    )
    out = (
        table.select("doc_id", "mark", "n_shingles", "h1", "h2").withColumn("linked", F.expr("n_shingles > 0 AND doc_id IS NOT NULL"))
        .join(of_class.withColumn("linked", F.lit(True)), ["linked", "h1", "h2", "n_shingles"], "left")
    )
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "mark", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group: that of the smallest
    id, and one row of those that repeat its id and text.

    The rows are exchanged once, to meet the ids to remove and those that
    repeat.  Rows of NULL id, and texts without words, all stay.
    """
    found = cut(near_duplicates(docs, p, id_col, text_col), "near-duplicates")
    own, mark = fresh(docs, "_id", "_mark")
    linked = found.filter("doc_id IS NOT NULL AND n_shingles > 0").select(F.col("doc_id").alias(own), F.col("mark").alias(mark), "kept")
    gone = cut(linked.filter("NOT kept").select(own, mark).distinct(), "removed")
    again = cut(linked.filter("kept").groupBy(own, mark).count().filter("count > 1").select(own, mark), "repeated")
    row_id, row_mark = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    same = (row_id == F.col(own)) & (row_mark == F.col(mark))
    # these ids grow with the data, so texts are dealt by id once, at any size
    rest = docs.join(gone.union(again).hint("shuffle_hash"), same, "left_anti")
    one = docs.join(again, same, "left_semi").select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), row_id.alias(own), row_mark.alias(mark))
    one = one.groupBy(own, mark).agg(F.first("row").alias("row")).select("row.*")
    return rest.union(one)
