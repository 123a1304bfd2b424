"""Operator 8: secrets in text, by fixed patterns and a linear-chain CRF.

Base patterns (contract of the query) give spans of kind assign, access and
hex.  The CRF tags tokens as outside, begin or inside of a secret from their
shape, the words and marks around them, and features of the whole text; spans
it finds beyond the base ones have kind crf.

Two hard constraints keep decoding cheap on long texts: a secret begins with a
known prefix, or with a token of 8 or more characters (6 after a keyword) that
has a digit, mixed case or a keyword before it; and an inside token follows its
predecessor without white space.  Chunks (runs without white space) that hold
no such token are outside by that definition, and Viterbi runs on the runs of
chunks between them.  So a secret of one case without digits can be found only
behind a keyword or prefix (the model takes plain letters of one case for
words), and of a passphrase with spaces at most its first word.

The CRF is trained here, on generated sequences of fixed seed and size
(``TRAINING_SEQUENCES``); no corpus rows are used.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import slices, utf8

#: Fixed values of the contract: patterns, and the least length of the named group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
#: Words that announce a secret, and public prefixes of access keys.
KEYWORDS = frozenset("password passwd pwd secret token key apikey api auth bearer credential credentials private signature access".split())
PREFIXES = ("sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "ya29", "eyJ", "npm_", "SG")

TRAINING_SEQUENCES = 2500
TOKEN = re.compile(r"[A-Za-z0-9_+/\-]+|[^\sA-Za-z0-9_+/\-]")
#: What opens a chunk: a digit, mixed case, a public prefix, or a keyword within or up to three chunks before.
OPENS = (re.compile(r"[0-9]+"), re.compile(r"[A-Z](?:(?<=[a-z][A-Z])|[A-Z][a-z])"))
WORD = re.compile(r"[A-Za-z]+")
KEYED = re.compile("|".join(sorted(KEYWORDS)), re.I)
CHUNK = re.compile(r"\S+")
MIXED = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e4


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int  # where the secret itself starts


def base_spans(text: str) -> list[Span]:
    """Contract spans of the three base kinds, in code points."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [Span("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a maximal run of 16 or more is the leftmost match of the run
    return out + [Span("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


# --- features ---------------------------------------------------------------

SIZES = {"length": 7, "digits": 6, "case": 4, "turns": 4, "hex": 2, "mixing": 5, "vowels": 4, "marks": 2, "prefix": 2, "before": 9, "after": 9, "keyword": 3, "file": 2, "place": 2, "class": 3}
_FIRST = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])[:-1].tolist()))
N_FEATURES = sum(SIZES.values())
_MARKS = {"": 0, "=": 1, ":": 2, '"': 3, "'": 3, "`": 3, "/": 4, "@": 5, ".": 6, "-": 7, "_": 7, "+": 7}


def _bucket(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def features(token: str, before: str, after: str, keyword: int, code: bool, first: bool) -> list[int]:
    """Feature numbers of a token; before and after are the characters beside
    it (empty: white space or a text border)."""
    n = len(token)
    digits = sum(c in string.digits for c in token)
    letters = [c for c in token if c in string.ascii_letters]
    kinds = [c in string.digits for c in token if c.isalnum()]
    vowels = sum(c in "aeiouAEIOU" for c in letters)
    values = {
        "length": _bucket(n, 8, 12, 16, 20, 32, 64),
        "digits": 0 if not digits else 5 if digits == n else 1 + _bucket(digits / n, 0.15, 0.4, 0.75),
        "case": 2 * any(c.islower() for c in letters) + any(c.isupper() for c in letters),
        "turns": _bucket(sum(a.islower() != b.islower() for a, b in zip(letters, letters[1:])), 1, 3, 5),
        "hex": int(n >= 16 and all(c in string.hexdigits for c in token)),
        "mixing": _bucket(sum(a != b for a, b in zip(kinds, kinds[1:])), 1, 2, 4, 8),
        "vowels": 0 if not letters else 1 + _bucket(vowels / len(letters), 0.15, 0.3),
        "marks": int(any(c in "-_+/" for c in token)),
        "prefix": int(token.startswith(PREFIXES)),
        "before": _MARKS.get(before, 8),
        "after": _MARKS.get(after, 8),
        "keyword": keyword,
        "file": int(code),
        "place": int(first),
        "class": 0 if token[0].isalnum() and token.isascii() else 1 if token.isascii() else 2,
    }
    return [_FIRST[k] + v for k, v in values.items()]


class Sequence(NamedTuple):
    tokens: list[tuple[int, int]]  # start, end
    features: np.ndarray  # tokens x groups
    begins: np.ndarray  # may begin a secret
    joined: np.ndarray  # follows its predecessor without white space


def _sequence(text: str, chunks: list[tuple[int, int]], code: bool) -> Sequence:
    tokens, rows, begins, joined = [], [], [], []
    for a, b in chunks:
        words = [w.lower() for w in WORD.findall(text[max(0, a - 48) : a])[-3:]]
        keyword = 2 if words and words[-1] in KEYWORDS else 1 if any(w in KEYWORDS for w in words) else 0
        for m in TOKEN.finditer(text, a, b):
            token, s, e = m[0], m.start(), m.end()
            tokens.append((s, e))
            rows.append(features(token, text[s - 1] if s > a else "", text[e] if e < b else "", keyword, code, s == a))
            begins.append(_may_begin(token, keyword))
            joined.append(s > a)
            if keyword < 2 and any(w.lower() in KEYWORDS for w in WORD.findall(token)):
                keyword = 2
    return Sequence(tokens, np.array(rows, np.int64), np.array(begins), np.array(joined))


def _may_begin(token: str, keyword: int) -> bool:
    if token.startswith(PREFIXES):
        return True
    if keyword and len(token) >= 6:
        return True
    return len(token) >= 8 and (any(c in string.digits for c in token) or MIXED.search(token) is not None)


def _capable(text: str, a: int, b: int, keyed: bool) -> bool:
    return any(_may_begin(m[0], keyed) for m in TOKEN.finditer(text, a, b))


def _open(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, behind a keyword) of chunks that may hold a secret, in order."""
    found: dict[int, tuple[int, bool]] = {}

    def add(at: int, end: int, keyed: bool) -> tuple[int, int]:
        while at and not text[at - 1].isspace():
            at -= 1
        chunk = CHUNK.match(text, at)
        end = chunk.end() if chunk else end
        found[at] = (end, keyed or found.get(at, (0, False))[1])
        return at, end

    for opens in (*OPENS, *(re.compile(re.escape(x)) for x in PREFIXES if x in text)):
        done = 0
        for m in opens.finditer(text):
            if m.start() >= done:
                done = add(m.start(), m.end(), False)[1]
    done, low = 0, text.lower()
    for m in KEYED.finditer(text) if any(x in low for x in KEYWORDS) else ():
        if m.start() < done:
            continue
        _, done = add(m.start(), m.end(), True)
        end = done
        for _ in range(3):
            after = CHUNK.search(text, end)
            if not after:
                break
            end = add(after.start(), after.end(), True)[1]
    for at in sorted(found):
        yield at, *found[at]


def sequences(text: str) -> Iterator[Sequence]:
    """Runs of neighbouring chunks that each hold a token able to begin a secret."""
    chunks: list[tuple[int, int]] = []
    code = None
    for a, b, keyed in _open(text):
        if not _capable(text, a, b, keyed):
            continue
        if code is None:
            code = sum(map(text.count, "{};=")) * 50 > len(text)
        if chunks and text[chunks[-1][1] : a].strip():
            yield _sequence(text, chunks, code)
            chunks = []
        chunks.append((a, b))
    if chunks:
        yield _sequence(text, chunks, bool(code))


# --- the chain --------------------------------------------------------------


class Chain(NamedTuple):
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # from x to

    def scores(self, s: Sequence) -> np.ndarray:
        e = self.weights[s.features].sum(axis=1)
        e[~s.begins, BEGIN] = NEVER
        e[~s.joined, INSIDE] = NEVER
        return e

    def decode(self, s: Sequence, caution: float) -> list[int]:
        """The best tags (Viterbi); caution is added to every outside score."""
        e = self.scores(s)
        e[:, OUTSIDE] += caution
        best, back = e[0] + self.moves[OUTSIDE], []
        for row in e[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _random(rng: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(low, high + 1)))


def _secret(rng: np.random.Generator) -> str:
    alnum = string.ascii_letters + string.digits
    kind = rng.integers(0, 12)
    if kind in (8, 10):  # without digits
        return _random(rng, string.ascii_letters, 14, 40)
    if kind == 9:
        return ["sk-", "sk_", "ghp_"][rng.integers(0, 3)] + _random(rng, string.ascii_letters, 20, 40)
    if kind == 11:
        return "SG." + _random(rng, string.ascii_letters if rng.random() < 0.5 else alnum, 20, 40)
    if kind == 0:
        return _random(rng, "0123456789abcdef", 24, 64)
    if kind == 1:
        return PREFIXES[rng.integers(0, len(PREFIXES))] + _random(rng, alnum, 16, 40)
    if kind == 2:
        return "eyJ" + _random(rng, alnum, 16, 40) + "." + _random(rng, alnum + "_-", 24, 80) + "." + _random(rng, alnum + "_-", 24, 43)
    if kind == 3:
        return _random(rng, alnum + "+/", 30, 64) + "=" * rng.integers(0, 3)
    if kind == 4:
        return "AKIA" + _random(rng, string.ascii_uppercase + string.digits, 16, 16)
    return _random(rng, alnum, 16, 48)


def _word(rng: np.random.Generator) -> str:
    syllables = "ba con de el fi gra ho in ja ker lo men no or pre qua ri so tion un ver wi xe yo zu the ing est".split()
    word = "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 6)))
    return word.capitalize() if rng.random() < 0.2 else word


def _plain(rng: np.random.Generator) -> str:
    """Text that could be a secret by its digits, its case or what is before it, and isn't one."""
    number = _random(rng, string.digits, 1, 6)
    kind = rng.integers(0, 18)
    return [
        lambda: _random(rng, string.digits, 8, 19),
        lambda: f"+{number[:2]}-{_random(rng, string.digits, 3, 3)}-{_random(rng, string.digits, 3, 4)}-{_random(rng, string.digits, 4, 4)}",
        lambda: f"{_word(rng)}.{number}@mail{number[0]}.example.com",
        lambda: f"https://www.{_word(rng)}.com/{_word(rng)}/{number}/{_word(rng)}-{_word(rng)}-{number}.html",
        lambda: f"20{_random(rng, string.digits, 2, 2)}-{_random(rng, string.digits, 2, 2)}-{_random(rng, string.digits, 2, 2)}T{_random(rng, string.digits, 2, 2)}:00:00Z",
        lambda: f"{_word(rng)}_{_word(rng)}_{number}",
        lambda: f"{_word(rng)}{_word(rng)}{number}",
        lambda: f"{_word(rng)}-{_word(rng)}-{number}",
        lambda: f"/usr/lib/{_word(rng)}{number}/{_word(rng)}_{number}.so",
        lambda: f"v{number}.{number}.{number}-{_word(rng)}{number}",
        lambda: f"{_word(rng)}({_word(rng)}{number})",
        lambda: f"{_word(rng).upper()}-{_random(rng, string.digits, 4, 8)}",
        lambda: f"{_word(rng).capitalize()}{_word(rng).capitalize()}{_word(rng).capitalize()}{number}",
        lambda: f"{number}{_word(rng)}{_word(rng)}",
        lambda: f"{_word(rng)}{_word(rng).capitalize()}{_word(rng).capitalize()}",
        lambda: f"{['key', 'secret', 'token', 'password', 'access', 'private'][rng.integers(0, 6)]} {_word(rng)}{_word(rng)} {_word(rng)}{_word(rng)}",
        lambda: f"{['key', 'password', 'auth', 'signature'][rng.integers(0, 4)]}: {_word(rng)}{_word(rng)}",
        lambda: f"{_word(rng)}{_word(rng)}-{_word(rng)}{_word(rng)}".upper(),
    ][kind]()


def training_text(rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A generated text and the spans of its secrets."""
    text, spans = "", []
    for _ in range(rng.integers(1, 4)):
        text += " ".join(_word(rng) for _ in range(rng.integers(0, 5))) + " "
        if rng.random() < 0.45:
            secret = _secret(rng)
            name = ["", "key ", "Bearer ", "auth=", "SECRET_KEY=", "api key: ", "credential:", "private-key '", 'access: "', "(", "?sig=", "deploy "][rng.integers(0, 12)]
            text += name
            spans.append((len(text), len(text) + len(secret)))
            text += secret + ["", '"', "'", ",", ".", ")", ";"][rng.integers(0, 7)]
        else:
            plain = _plain(rng)
            text += ["", "", "", "", "(", '"', "id=", "key: ", "Token "][rng.integers(0, 9)] + plain + ["", "", ",", ".", "###", "%%%"][rng.integers(0, 6)]
        text += " "
    return text, spans


def tags_of(s: Sequence, spans: list[tuple[int, int]]) -> list[int]:
    out = []
    for a, b in s.tokens:
        inside = [x for x in spans if x[0] <= a and b <= x[1]]
        out.append(OUTSIDE if not inside else BEGIN if a == inside[0][0] else INSIDE)
    return out


@cache
def trained(n: int = TRAINING_SEQUENCES, seed: int = 11, steps: int = 100, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood by full-batch Adam on generated sequences."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[Sequence, list[int]]] = []
    while len(rows) < n:
        text, spans = training_text(rng)
        for s in sequences(text):
            tags = tags_of(s, spans)
            legal = all((t != BEGIN or s.begins[k]) and (t != INSIDE or (s.joined[k] and k and tags[k - 1] != OUTSIDE)) for k, t in enumerate(tags))
            if legal and len(tags) <= 24:
                rows.append((s, tags))
    size = max(len(t) for _, t in rows)
    n = len(rows)
    feats, gold, live = np.zeros((n, size, len(SIZES)), np.int64), np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    ban = np.zeros((n, size, 3))
    for i, (s, tags) in enumerate(rows):
        k = len(tags)
        feats[i, :k], gold[i, :k], live[i, :k] = s.features, tags, True
        ban[i, :k, BEGIN][~s.begins] = NEVER
        ban[i, :k, INSIDE][~s.joined] = NEVER
    w, moves = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves)]
    legal = np.zeros((3, 3))
    legal[OUTSIDE, INSIDE] = NEVER
    hot = np.eye(3)[gold] * live[:, :, None]
    design = np.zeros((int(live.sum()), N_FEATURES), np.float32)
    design[np.arange(len(design))[:, None], feats[live]] = 1
    before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
    for step in range(1, steps + 1):
        e, m = ban.copy(), moves + legal
        e[live] += design @ w
        ahead = np.zeros((n, size, 3))
        ahead[:, 0] = e[:, 0] + m[OUTSIDE]
        for k in range(1, size):
            ahead[:, k] = np.where(live[:, k, None], _sum_exp(ahead[:, k - 1][:, :, None] + m, 1) + e[:, k], ahead[:, k - 1])
        total = _sum_exp(ahead[:, -1], 1)
        behind = np.zeros((n, size, 3))
        for k in range(size - 2, -1, -1):
            behind[:, k] = np.where(live[:, k + 1, None], _sum_exp(m[None] + (e[:, k + 1] + behind[:, k + 1])[:, None, :], 2), 0)
        share = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        g_w = design.T @ (share - hot)[live]
        g_m = np.zeros((3, 3))
        g_m[OUTSIDE] += share[:, 0].sum(axis=0)
        for k in range(1, size):
            on = live[:, k]
            joint = np.exp(ahead[on, k - 1][:, :, None] + m + (e[on, k] + behind[on, k])[:, None, :] - total[on][:, None, None])
            g_m += joint.sum(axis=0)
        np.add.at(g_m, (before[live], gold[live]), -1)
        for (mean, square), x, g in zip(state, (w, moves), (g_w / n + ridge * w, g_m / n + ridge * moves)):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            x -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Chain(w, moves + legal)


# --- scans ------------------------------------------------------------------


def secret_spans(text: str, chain: Chain, caution: float = 1.5) -> list[Span]:
    """Base spans, and CRF spans that reach beyond them, by start and kind."""
    out = base_spans(text)
    covered = [(s.start, s.end) for s in out]
    for s in sequences(text):
        tags = chain.decode(s, caution)
        k = 0
        while k < len(tags):
            if tags[k] != BEGIN:
                k += 1
                continue
            a, b = s.tokens[k]
            k += 1
            while k < len(tags) and tags[k] == INSIDE:
                b = s.tokens[k][1]
                k += 1
            if not any(x <= a and b <= y for x, y in covered):
                out.append(Span("crf", a, b, a))
    return sorted(out, key=lambda x: (x.start, KINDS.index(x.kind), x.end))


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every secret (the value of an assignment) replaced."""
    out, at = [], 0
    for a, b in sorted((s.value, s.end) for s in spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(chain: Chain, caution: float, names: list[str], carried: int, masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(carried)
            _, offs = utf8(column)
            for a, b in slices(offs, 8 << 20):
                rows, clean = [], []
                for text in column.slice(a, b - a).to_pylist():
                    spans = secret_spans(text or "", chain, caution)
                    rows.append([s._asdict() for s in spans])
                    clean.append(redact(text, spans) if spans else text)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
                last = [pa.array(clean, pa.string())] if masked else []
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:carried]), pa.array(rows, kind), *last], names)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", caution: float = 1.5) -> DataFrame:
    """doc_id and secrets: array of (kind, start, end, value), in code points,
    end exclusive; value is where the secret itself starts.

    NULL text is empty and, like text without secrets, has an empty array.
    Rows are independent: repeats are repeated, an empty table is empty;
    extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, secrets array<struct<kind:string,start:long,end:long,value:long>>"
    return rows.mapInArrow(_scan(trained(), caution, ["doc_id", "secrets"], 1, False), schema)


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", caution: float = 1.5) -> DataFrame:
    """The documents, same rows and columns, with secrets in the text replaced
    by [SECRET] and ``length_col``, if there is one, counted anew for those."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    df = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    found = T._parse_datatype_string("secrets array<struct<kind:string,start:long,end:long,value:long>>, masked string")
    schema = T.StructType([df.schema["row"], *found.fields])
    done = df.mapInArrow(_scan(trained(), caution, schema.fieldNames(), 1, True), schema)
    some = F.size("secrets") > 0
    new = {text_col: F.when(some, F.col("masked")).otherwise(F.col(f"row.`{text_col}`").cast("string"))}
    if length_col in docs.columns:
        length = docs.schema[length_col].dataType
        new[length_col] = F.when(some, F.length("masked").cast(length)).otherwise(F.col(f"row.`{length_col}`"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of a scan."""

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("crf"))
