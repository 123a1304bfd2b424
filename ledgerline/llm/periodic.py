"""Operator 11: periodic runs of words by longest common extensions.

A run is a maximal stretch of words with smallest period q.  Ukkonen's
algorithm builds the suffix tree of a document and of its reversal; a longest
common extension is the string depth of the lowest common ancestor of two
leaves, the minimum over the Euler tour between them, which a sparse table gives
in constant time.  The longest Lyndon word at each place, in both orders of the
words, is the only root a run can have there (the runs theorem); every root
is extended in both directions.

Words that can't lie in any run are left out of the tree without loss: of a
run of exponent k every three neighbouring words stand at least k - 1 times in
it, so a document falls into the stretches where that holds.  They go into one
tree, a separator of its own between them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ledgerline.llm.common import slices, utf8

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class SuffixTree:
    """Suffix tree of ``symbols`` (integers above 0) and the end mark 0.

    ``rank`` and ``rank_inverse`` give the place of every suffix, the empty
    one included, in the order of the symbols and in the opposite one; a
    prefix is smaller in both.
    """

    def __init__(self, symbols: np.ndarray, inverse: bool = True) -> None:
        text = [*symbols.tolist(), 0]
        n, k = len(text), int(symbols.max(initial=0)) + 1
        child, left, right = self._ukkonen(text, k)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        kids = np.fromiter(child.values(), np.int64, len(child))
        parent = np.zeros(len(left), np.int64)
        parent[kids] = keys // k
        # the smallest child is taken from the stack first
        order = np.argsort(-keys)
        kids, owner, symbol = kids[order], keys[order] // k, keys[order] % k
        leaf = right == n
        size = (right - left).tolist()
        nodes = -np.arange(len(left))
        first, last = np.searchsorted(-owner, nodes, "left").tolist(), np.searchsorted(-owner, nodes, "right").tolist()
        tour, depth = self._tour(kids.tolist(), first, last, parent.tolist(), size)
        at = np.flatnonzero(leaf[tour])
        start = n - depth[tour[at]]
        self.rank = np.empty(n, np.int64)
        self.rank[start] = np.arange(n)
        # the visit after a leaf is a branch of the lowest common ancestor with the next leaf
        lows = depth[parent[tour[at[:-1] + 1]]].astype(np.int32)
        self._table = [lows]
        step = 1
        while 2 * step <= len(lows):
            row = self._table[-1]
            self._table.append(np.minimum(row[:-step], row[step:]))
            step *= 2
        if inverse:
            # every node's children turned round, the end mark first as before
            sort = np.lexsort((np.where(symbol == 0, k, symbol), -owner))
            tour, depth = self._tour(kids[sort].tolist(), first, last, parent.tolist(), size)
            self.rank_inverse = np.empty(n, np.int64)
            self.rank_inverse[n - depth[tour[leaf[tour]]]] = np.arange(n)

    @staticmethod
    def _ukkonen(text: list[int], k: int) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        """Edges (node * k + first symbol -> child) and the span of each node's edge."""
        n = len(text)
        child: dict[int, int] = {}
        left, right, link = [0], [0], [0]
        node = edge = length = rest = 0
        for i, c in enumerate(text):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = i
                key = node * k + text[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(left)
                    left.append(i)
                    right.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = left[to]
                    size = right[to] - begin
                    if length >= size:
                        edge += size
                        length -= size
                        node = to
                        continue
                    below = text[begin + length]
                    if below == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    mid = len(left)
                    child[key] = mid
                    left[to] = begin + length
                    child[mid * k + below] = to
                    child[mid * k + c] = mid + 1
                    left += (begin, i)
                    right += (begin + length, n)
                    link += (0, 0)
                    if last:
                        link[last] = mid
                    last = mid
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        return child, np.array(left, np.int64), np.array(right, np.int64)

    @staticmethod
    def _tour(kids: list[int], first: list[int], last: list[int], parent: list[int], size: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Nodes in the order of the tour's first visits, and their string depths."""
        depth, tour, stack = [0] * len(parent), [], [0]
        pop, push, visit = stack.pop, stack.extend, tour.append
        while stack:
            v = pop()
            visit(v)
            if v:
                depth[v] = depth[parent[v]] + size[v]
            a, b = first[v], last[v]
            if a < b:
                push(kids[a:b])
        return np.array(tour, np.int64), np.array(depth, np.int64)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes x and y (places, x != y) have in common."""
        a, b = self.rank[x], self.rank[y]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for l in np.unique(level).tolist():
            at = np.flatnonzero(level == l)
            row = self._table[l]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << l)])
        return out


def longest_lyndon(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word from each place: the next smaller suffix."""
    r, stack = rank.tolist(), []
    out = [len(r) - 1] * (len(r) - 1)
    for i, x in enumerate(r):
        while stack and r[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs(symbols: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """(start, length, period) of every run of at least ``least_length`` symbols
    and ``least_exponent`` periods, by start, then period."""
    n = len(symbols)
    if n == 0:
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1], inverse=False)
    found = []
    i = np.arange(n)
    for rank in (ahead.rank, ahead.rank_inverse):
        j = longest_lyndon(rank)
        right = ahead.extension(i, j)
        left = np.zeros(n, np.int64)
        left[1:] = back.extension(n - i[1:], n - j[1:])
        start, period = i - left, j - i
        length = j + right - start
        ok = length >= np.maximum(least_length, least_exponent * period)
        found.append(np.stack([start, length, period], 1)[ok])
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the stretches, one stretch after the other, and whose they are."""
    size = end - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def candidates(ids: np.ndarray, start: np.ndarray, end: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that hold every run of the given ones: three neighbouring words
    of a run of exponent k stand k - 1 times in its stretch.  Words are counted
    in a hashed table, whose collisions only keep more."""
    need = min(least_exponent - 1, least_length - 2)
    while True:
        at, owner = _spans(start, end)
        if len(at) < 3:
            return start[:0], end[:0]
        w = ids[at].astype(np.uint64)
        key = w[:-2] * _SALTS[0] + w[1:-1] * _SALTS[1] + w[2:] * _SALTS[2] + owner[:-2].astype(np.uint64) * _SALTS[3]
        key ^= key >> np.uint64(29)
        key *= _SALTS[1]
        bits = max(8, int(len(at)).bit_length() + 2)
        key = (key >> np.uint64(64 - bits)).astype(np.int64)
        whole = owner[:-2] == owner[2:]
        hot = whole & (np.bincount(key[whole], minlength=1 << bits)[key] >= need)
        edge = np.diff(np.r_[False, hot, False].astype(np.int8))
        # neighbours in the list may belong to different stretches only where no triple is whole
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= least_length - 2
        new_start, new_end = at[first[long]], at[last[long] - 1] + 3
        if int((new_end - new_start).sum()) >= len(at):
            return start, end
        start, end = new_start, new_end


def document_runs(ids: np.ndarray, start: np.ndarray, end: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Runs within the stretches of one document, in its own places."""
    at, owner = _spans(start, end)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    _, symbol = np.unique(ids[at], return_inverse=True)
    gaps = np.flatnonzero(np.diff(owner)) + 1
    line = np.insert(symbol + 1, gaps, symbol.max() + 2 + np.arange(len(gaps)))
    place = np.insert(at, gaps, -1)
    out = runs(line, least_length, least_exponent)
    out[:, 0] = place[out[:, 0]]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _scan(least_length: int, least_exponent: int, slice_bytes: int):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def one_slice(texts: list[bytes]) -> tuple[list[int], list[np.ndarray], list[str]]:
        known: dict[bytes, int] = {}
        words = [t.split() for t in texts]
        ids = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.int64)
        ends = np.cumsum([len(ws) for ws in words])
        starts = ends - [len(ws) for ws in words]
        s, e = candidates(ids, starts, ends, least_length, least_exponent)
        mine = np.searchsorted(ends, s, "right")
        found, collapsed = [], []
        for k, ws in enumerate(words):
            a, b = np.searchsorted(mine, [k, k + 1])
            r = document_runs(ids, s[a:b], e[a:b], least_length, least_exponent)
            if len(r):
                r[:, 0] -= starts[k]
                gone = np.zeros(len(ws) + 1, np.int64)
                np.add.at(gone, r[:, 0] + r[:, 2], 1)
                np.add.at(gone, r[:, 0] + r[:, 1], -1)
                ws = [ws[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
            found.append(r)
            collapsed.append(b" ".join(ws).decode())
        return [len(ws) for ws in words], found, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for a, b in slices(offs, slice_bytes):
                raw = data[offs[a] : offs[b]].tobytes()
                cuts = (offs[a : b + 1] - offs[a]).tolist()
                n, found, collapsed = one_slice([raw[x:y] for x, y in zip(cuts, cuts[1:])])
                flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), lists, pa.array(collapsed, pa.string())], schema=schema)

    return run


def periodic_runs(
    docs: DataFrame, least_length: int = 6, least_exponent: int = 4, id_col: str = "doc_id", text_col: str | Column = "text", slice_bytes: int = 1 << 20
) -> DataFrame:
    """id, n_words, runs (start, length and period in words, by start, then
    period) and collapsed text per row.

    Words are what stands between white space of ASCII, told apart by their bytes.  A
    run has at least ``least_length`` (3 or more) words and ``least_exponent``
    (2 or more) times its smallest period, and isn't extended by a neighbour.
    The collapsed text is the words that no run repeats, joined by one space.
    NULL and empty texts have no words and no runs; rows are independent, so
    repeats give repeated rows, an empty table none, and a NULL id stays NULL;
    other columns are ignored whatever their names.  A task holds a
    slice of texts (one text at least) and the tree of one of them.
    """
    if least_length < 3 or least_exponent < 2:
        raise ValueError("runs need three words and two periods at least")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(text_col) if isinstance(text_col, str) else text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(least_length, least_exponent, slice_bytes), "id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


@arrow_udf(StringType())
def _repeat_tail(h: pa.Array, text: pa.Array) -> pa.Array:
    out = []
    for x, t in zip(h.to_pylist(), text.to_pylist()):
        words = None if t is None else t.encode().split()
        if words:
            g, n = x // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tail = words[a : a + p]
            words = words[:a] + (tail * ((n - a) // p + 1))[: n - a]
        out.append(None if words is None else b" ".join(words).decode())
    return pa.array(out, pa.string())


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, told by the checksum of
    their ids, repeat the words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    mine = F.coalesce(h % 10 == 0, F.lit(False))
    planted = _repeat_tail(F.coalesce(h, F.lit(0)), F.when(mine, F.col("text").cast("string")))
    return docs.select("doc_id", F.when(mine, planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from runs and collapsed texts."""
    r = F.col("runs")

    def ahead(x: Column, y: Column) -> Column:
        """x before y: greater exact exponent, then smaller start, then smaller period."""
        a = x["length"].cast("decimal(19,0)") * y["period"]
        b = y["length"].cast("decimal(19,0)") * x["period"]
        return (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))

    best = F.when(F.size(r) > 0, F.aggregate(r, F.element_at(r, 1), lambda b, x: F.when(ahead(x, b), x).otherwise(b)))
    lines = F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    listed = F.when(F.size(r) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    out = found.select("id", F.size(r).cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        F.col("id").alias("doc_id"), "n_runs", "b.start", "b.length", "b.period",
        F.floor(F.expr("(1000 * b.length) div b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def crc(doc_id: int) -> int:
    """The checksum of an id, as ``with_planted_runs`` takes it."""
    return zlib.crc32(str(doc_id).encode())
