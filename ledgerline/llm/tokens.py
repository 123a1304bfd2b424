"""Operator 9: token counts by rank-synchronous array merging.

The distinct pre-tokens of a slice of texts that the worker hasn't counted yet
are held as one ragged numpy array of byte symbols.  In each round every
sequence merges all occurrences of its own lowest-ranked pair at once;
sequences without a ranked pair leave with their count of surviving symbols.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices, utf8

#: Fixed value: how the byte-level tokenizers split text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file:
    itself for visible Latin-1 letters, the next one from U+0100 otherwise."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in visible}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(visible))
    return out


#: Pieces of more bytes are merged one by one, as a round over a ragged array
#: costs the length of everything in it.
LONG_PIECE = 512


class Merger:
    """Merge ranks of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.width = np.int64(max(vocab.values()) + 1)
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = [(vocab[a], vocab[b]) for a, b in pairs]
        self.rank_of = {pair: rank for rank, pair in enumerate(self.pairs)}
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.find = regex.compile(SPLIT).findall
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> np.ndarray:
        """Symbols left of each non-empty piece."""
        raw = [p.encode() for p in pieces]
        long = np.array([len(r) > LONG_PIECE for r in raw])
        left = np.empty(len(raw), np.int64)
        left[long] = [self.count_long(r) for r in raw if len(r) > LONG_PIECE]
        if not long.all():
            left[~long] = self.count_together([r for r in raw if len(r) <= LONG_PIECE])
        return left

    def count_long(self, raw: bytes) -> int:
        """Symbols left of one long piece: the same rounds, with the places of its
        pairs kept by rank, so that a round costs its merges and not the whole
        array.  Places that an earlier merge changed are passed over."""
        n = left = len(raw)
        symbols = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}

        def wait(place: int, pair: tuple[int, int]) -> None:
            rank = self.rank_of.get(pair)
            if rank is None:
                return
            if rank in places:
                places[rank].append(place)
            else:
                places[rank] = [place]
                heappush(ranks, rank)

        ranks: list[int] = []
        for place, pair in enumerate(zip(symbols, symbols[1:])):
            wait(place, pair)
        while ranks:
            rank = heappop(ranks)
            (a, b), merged = self.pairs[rank], int(self.merged[rank])
            for i in sorted(places.pop(rank)):
                j = after[i]
                if j == n or symbols[i] != a or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = merged, -1
                left -= 1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    wait(i, (merged, symbols[k]))
                if before[i] >= 0:
                    wait(before[i], (symbols[before[i]], merged))
        return left

    def count_together(self, raw: list[bytes]) -> np.ndarray:
        """Symbols left of each piece, all merged in one ragged array."""
        size = np.array([len(r) for r in raw], np.int64)
        left = size.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        none = len(self.rank)
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none)
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, none), heads)
            mine = np.repeat(lowest, np.diff(np.append(heads, len(symbols))))
            hit = np.flatnonzero((rank == mine[:-1]) & (rank < none))
            if not len(hit):
                break
            # of overlapping occurrences (aaa) every second one merges, from the left
            start = np.r_[True, np.diff(hit) != 1]
            run = np.flatnonzero(start)[np.cumsum(start) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            alive = np.repeat(lowest < none, np.diff(np.append(heads, len(symbols))))
            alive[hit + 1] = False
            left -= np.bincount(owner[hit], minlength=len(left))
            symbols, owner = symbols[alive], owner[alive]
        return left

    def texts(self, texts: list[str], most_known: int) -> list[int]:
        """Tokens of each text; special strings inside are one token each."""
        special, pieces = [], []
        for text in texts:
            found = 0
            if self.special and any(s in text for s in self.specials):
                parts = self.special.split(text)
                found, pieces_of = len(parts) - 1, [x for p in parts for x in self.find(p)]
            else:
                pieces_of = self.find(text)
            special.append(found)
            pieces.append(pieces_of)
        if len(self.known) > most_known:
            self.known.clear()
        new = list({x for p in pieces for x in p} - self.known.keys())
        if new:
            self.known.update(zip(new, self.count(new).tolist()))
        known = self.known.__getitem__
        return [n + sum(map(known, p)) for n, p in zip(special, pieces)]


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def _count(path: str, limit: int, slice_bytes: int, most_known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            _, offs = utf8(batch.column(1))
            for a, b in slices(offs, slice_bytes):
                tokens = np.array(m.texts([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], most_known), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offs[a : b + 1])), pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
    slice_bytes: int = 1 << 20, most_known: int = 500_000,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) per row.

    ``tokenizer`` is the path of a byte-level BPE .json file that every worker
    can read.  NULL text is empty (0 tokens).  Rows are independent: repeats
    give repeated rows, an empty table none; extra columns are ignored.  A
    worker holds one slice of texts (one text at least) and remembers the
    counts of at most ``most_known`` pre-tokens besides those of its slice.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(tokenizer, limit, slice_bytes, most_known), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
