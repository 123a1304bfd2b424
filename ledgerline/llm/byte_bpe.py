"""Operator 12: byte-level BPE encoding over overlapping chunks, and decoding.

A text longer than a chunk is cut into chunks that overlap, dealt to tasks one by
one and pre-tokenised there.  A chunk that starts inside a pre-token soon
finds the boundaries of its predecessor; the first one that both have in
their overlap is where the one hands over to the other, as everything behind a
boundary depends on the text behind it alone.  Neighbours without a common
boundary (a pre-token longer than the overlap) are joined into one span.  The
pre-tokens of every span are encoded by merging, lowest rank first.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, slices, utf8

#: Letters and numbers that Unicode has got after version 16, which
#: the tokenizer library knows; to it they are characters of no class.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Fixed value: a character that no version assigns.
NO_CLASS = "\u0378"
#: Characters behind a match that can decide it (an apostrophe takes up to two letters).
LOOKAHEAD = 3
GAP = re.compile(r"(?<=\S)(?= )")
#: Pre-tokens up to this many bytes are merged by rescanning, longer ones by a heap.
SHORT = 64


class Ranks:
    """Merge ranks of a rank file (a token in base 64 and its rank on each line)."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.newer = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
        self.whole_words = r" ?\p{L}+|" in pattern
        self.known: dict[str, bytes] = {}
        self.width = max(self.rank.values()) + 1
        self.size = np.zeros(self.width, np.int64)
        for token, rank in self.rank.items():
            self.size[rank] = len(token)
        self.end = np.cumsum(self.size)
        self.letters = np.zeros(int(self.size.sum()), np.uint8)
        for token, rank in self.rank.items():
            self.letters[self.end[rank] - len(token) : self.end[rank]] = np.frombuffer(token, np.uint8)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        # every token as every pair of tokens that gives it
        joined = [
            (x * self.width + y, rank)
            for token, rank in self.rank.items()
            for i in range(1, len(token))
            if (x := self.rank.get(token[:i])) is not None and (y := self.rank.get(token[i:])) is not None
        ]
        found = np.array(sorted(joined), np.int64).reshape(-1, 2)
        self.pairs, self.joined = found[:, 0].copy(), found[:, 1].copy()

    def classed(self, text: str) -> str:
        """The text as the pattern is to see it, every character in its place."""
        return text if text.isascii() else self.newer.sub(NO_CLASS, text)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        seen = self.classed(text)
        return self.find(text) if seen == text else [text[m.start() : m.end()] for m in self.iterate(seen)]

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of two tokens joined, ``width`` where they give none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], self.width)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every pre-token: the whole of it where it is a token, else its
        bytes merged pair by pair, the lowest rank first and of equal ones the
        leftmost.  Pieces of like length are merged together, one pair of each at a time."""
        out: list[bytes] = [b""] * len(pieces)
        longer = []
        for k, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT:
                out[k] = np.array(self._merge_long(piece), "<i4").tobytes()
            else:
                longer.append(k)
        longer.sort(key=lambda k: len(pieces[k]))
        size = np.array([len(pieces[k]) for k in longer], np.int64)
        for low, high in ((1, 8), (8, 12), (12, 20), (20, SHORT)):
            a, b = np.searchsorted(size, [low, high], "right").tolist()
            for x in range(a, b, 4096):
                mine = longer[x : min(b, x + 4096)]
                ids, left = self._merge_short([pieces[k] for k in mine], size[x : x + len(mine)])
                raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(left)).tolist()
                for k, i, j in zip(mine, [0, *ends], ends):
                    out[k] = raw[i:j]
        return out

    def _merge_short(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(pieces), int(size[-1])
        at = np.arange(width)
        inside = at < size[:, None]
        symbol = np.full((n, width), self.width, np.int32)
        symbol[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        # the rank of every symbol joined with the next; nothing follows the last
        rank = np.full((n, width), self.width, np.int32)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self._join(symbol[:, :-1][pair], symbol[:, 1:][pair])
        live, left = np.arange(n), size.copy()
        while len(live):
            s, r = symbol[live], rank[live]
            i = r.argmin(1)
            low = r[np.arange(len(live)), i]
            go = low < self.width
            live, s, r, i, low = live[go], s[go], r[go], i[go], low[go]
            if not len(live):
                break
            row = np.arange(len(live))
            # what stands behind the pair moves up by one
            behind = at[:-1] > i[:, None]
            s[:, :-1] = np.where(behind, s[:, 1:], s[:, :-1])
            r[:, :-1] = np.where(behind, r[:, 1:], r[:, :-1])
            s[row, i] = low
            left[live] -= 1
            ends = left[live]
            s[row, ends] = self.width
            r[row, ends - 1] = self.width
            for first in (i, i - 1):
                ok = np.flatnonzero((first >= 0) & (first + 1 < ends))
                f = first[ok]
                r[ok, f] = self._join(s[ok, f], s[ok, f + 1])
            symbol[live], rank[live] = s, r
        return symbol[at < left[:, None]], left

    def _merge_long(self, piece: bytes) -> list[int]:
        rank, n = self.rank, len(piece)
        # symbol i covers piece[i : after[i]]; gone symbols have after 0
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not j or j >= n or after[j] != end:
                continue
            after[i], after[j] = end, 0
            if end < n:
                before[end] = i
                if (r := rank.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            h = before[i]
            if h >= 0 and (r := rank.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str], most_known: int) -> list[bytes]:
        """Ids of every text, 32 bits each with the lowest byte first.

        In front of a space behind something else than white space there is
        always a boundary, so the text falls into words there, and the ids of
        words seen before are known.
        """
        known = self.known
        if len(known) > most_known:
            known.clear()
        words = [GAP.split(t) for t in texts]
        new = list(set().union(*words).difference(known))
        split = self.split if self.newer.search("".join(new)) else self.find
        # a space and letters are one pre-token of the usual patterns
        pieces = [[w] if self.whole_words and w[1:].isalpha() and (w[0] == " " or w[0].isalpha()) else split(w) for w in new]
        distinct = list(set().union(*pieces))
        ids = dict(zip(distinct, self.merge([p.encode() for p in distinct])))
        for w, ps in zip(new, pieces):
            known[w] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of the ids, one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        size = self.size[ids]
        shift = self.end[ids] - np.cumsum(size)
        return self.letters[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()


@cache
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _encode_short(path: str, pattern: str, most_known: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for batch in batches:
            _, offs = utf8(batch.column(1))
            for a, b in slices(offs, slice_bytes):
                parts = r.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], most_known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(parts)], ["doc_id", "ids"])

    return run


def _chunks(chunk: int, overlap: int):
    """Chunks of ``chunk`` characters and the overlap behind them."""
    names = ["doc", "doc_id", "no", "at", "last", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count += 1
                for no, at in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                    part = text[at : at + chunk + overlap]
                    row = [f"{task}-{count}", doc_id, no, at, at + len(part) == len(text), part]
                    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    return run


def _boundaries(path: str, pattern: str, chunk: int, overlap: int):
    """Pre-token starts of each chunk within its first and last ``overlap`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for batch in batches:
            head, tail = [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                ends = [m.end() for m in r.iterate(r.classed(text))]
                # what stands before a place behind white space can depend on what follows it
                sure = [e for e in ends if e <= len(text) - LOOKAHEAD and not text[e - 1].isspace()]
                head.append([at + e for e in sure if e <= overlap])
                tail.append([at + e for e in sure if e >= chunk])
            columns = [batch.column(c) for c in batch.schema.names] + [pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "head", "tail"])

    return run


def _encode_span(path: str, pattern: str, most_known: int):
    """One span of a text from its chunks: encode what stands between its ends."""

    def run(rows: pa.Table) -> pa.Table:
        r = ranks(path, pattern)
        rows = rows.sort_by("no")
        first, to = rows["begin"][0].as_py(), rows["end"][-1].as_py()
        parts, have = [], rows["at"][0].as_py()
        start = have
        for at, text in zip(rows["at"].to_pylist(), rows["text"].to_pylist()):
            parts.append(text[have - at :])
            have = at + len(text)
        text = "".join(parts)[first - start : None if to is None else to - start]
        ids = r.encode([text], most_known)
        return pa.table({"doc": rows["doc"][:1], "doc_id": rows["doc_id"][:1], "span": rows["span"][:1], "ids": _lists(ids)})

    return run


def spans(chunks: DataFrame) -> DataFrame:
    """doc, no, span, begin and end of what each chunk encodes: it takes
    over where its predecessor hands over, at the first boundary that both have;
    a chunk without such a place continues its predecessor's span."""
    by_no = Window.partitionBy("doc").orderBy("no")
    c = chunks.select("doc", "no", "head", "tail").withColumn("before", F.lag("tail").over(by_no))
    c = c.withColumn("begin", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "before"))))
    c = c.withColumn("end", F.lead("begin").over(by_no))
    so_far = by_no.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("doc", "no", F.count("begin").over(so_far).alias("span"), "begin", "end")


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 15, overlap: int = 1 << 9,
    most_known: int = 300_000, slice_bytes: int = 1 << 20,
) -> DataFrame:
    """doc_id and ids (array of int) per row, by the rank file at ``path``, which
    every worker can read; every match of ``pattern`` is encoded separately,
    without special tokens.

    NULL and empty texts have no ids; a NULL id stays NULL; rows are
    independent, so repeats give repeated rows and an empty table none; other
    columns are ignored whatever their names.  A text of one chunk has nothing
    to stitch and is encoded where it is read; longer ones are cut into
    chunks, written under the shared folder, and come back as one row.  A task
    holds a slice of texts, a chunk or a pre-token, whichever is longest; the
    ids of a text are one row as its text was.
    """
    if overlap <= LOOKAHEAD or chunk < 2 * overlap:
        raise ValueError("a chunk must be twice the overlap")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = F.coalesce(F.length("text") <= chunk + overlap, F.lit(True))
    short = rows.filter(one).mapInArrow(_encode_short(path, pattern, most_known, slice_bytes), "doc_id long, ids array<int>")
    long = rows.filter(~one).mapInArrow(_chunks(chunk, overlap), "doc string, doc_id long, no long, at long, last boolean, text string")
    # dealt anew, so that the chunks of one text are pre-tokenised in many tasks
    long = cut(long, "chunks").repartition("doc", "no")
    fields = "doc string, doc_id long, no long, at long, last boolean, text string, head array<long>, tail array<long>"
    long = cut(long.mapInArrow(_boundaries(path, pattern, chunk, overlap), fields), "boundaries")
    own = long.drop("head", "tail").join(spans(long), ["doc", "no"])
    parts = own.groupBy("doc", "span").applyInArrow(_encode_span(path, pattern, most_known), "doc string, doc_id long, span long, ids array<int>")
    whole = parts.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("span", "ids"))).alias("parts"))
    return short.union(whole.select("doc_id", F.flatten("parts.ids")))


def _decode(path: str, pattern: str, slice_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            for a, b in slices(offsets, slice_ids):
                ids = batch.column(1).slice(a, b - a)
                flat, offs = ids.flatten().to_numpy(zero_copy_only=False), offsets[a : b + 1] - offsets[a]
                parts = [flat[x:y] for x, y in zip(offs, offs[1:])]
                packed = pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())
                decoded = pa.array([r.decode(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, packed, decoded], ["doc_id", "ids", "packed", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str, slice_ids: int = 1 << 18) -> DataFrame:
    """doc_id, ids, packed (the ids as 32-bit integers, lowest byte first) and
    decoded (the raw bytes of the ids, one after the other).

    NULL ids decode to nothing; an id outside the vocabulary raises.
    """
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(path, pattern, slice_ids), "doc_id long, ids array<int>, packed binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The contract's columns from ids and decoded bytes."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
