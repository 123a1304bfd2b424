"""Operator 10: exact round trips, windows against a plain loop, native plan."""

import hashlib
import random

import pytest

from ledgerline.llm import chat, registry
from tests.conftest import SF001, plan_text

SCHEMA = "conv_id long, turn long, role string, text string, window string, n long"
NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "\\", "a\\<|\\\\n", "", " ", "é😀", "<<SYS>> <|\\im_end|>", "line\n\nline", "$1 \\1"]


def turns_of(seed, n=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randrange(1, 30)):
            role = "system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "as\nsis<|tant"])
            text = rng.choice([*NASTY, "w " * rng.randrange(1, 300)])
            rows.append((c, k, role, text, "clash", 1))
    rng.shuffle(rows)
    return rows


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def ordered(rows, conv):
    return sorted(((t, r or "", x or "") for c, t, r, x, *_ in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_round_trip(spark):
    rows = turns_of(1)
    out = {r.conv_id: r for r in chat.digests(chat.windows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(out) == {r[0] for r in rows}
    for conv, r in out.items():
        mine = ordered(rows, conv)
        loss = "".join(x for _, role, x in mine if role == "assistant")
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in mine))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


@pytest.mark.parametrize("block", [1024, 4])
def test_windows_match_a_plain_loop(spark, block):
    rows = turns_of(2)
    budget = chat.Budget(fresh=200, history=60, block_turns=block)
    got = {(r.conv_id, r.window): r for r in chat.windows(spark.createDataFrame(rows, SCHEMA), budget).collect()}
    seen = 0
    for conv in {r[0] for r in rows}:
        before, own = 0, []
        for _, role, x in ordered(rows, conv):
            own.append((before // budget.fresh, before, role, x))
            before += max(1, len(x.split()))
        for w in sorted({o[0] for o in own}):
            fresh = [o for o in own if o[0] == w]
            begin = fresh[0][1]
            history = [o for k, o in enumerate(own) if o[0] < w and begin - o[1] <= budget.history and not (k == 0 and o[2] == "system")]
            system = [own[0]] if own[0][2] == "system" and w > own[0][0] else []
            r = got[conv, w]
            assert (r.n_turns, r.n_repeated) == (len(fresh), len(history) + len(system))
            assert r.formatted.count(chat.START) == len(fresh) + len(history) + len(system)
            assert len(r.loss_spans) == sum(o[2] == "assistant" for o in fresh)
            seen += 1
    assert seen == len(got)


def test_edge_rows(spark):
    rows = [(None, None, None, None, None, None), (None, 1, "user", "x", None, None), (5, 1, "assistant", None, None, None), (5, 1, "assistant", None, None, None), (6, 0, "assistant", "y " * 100_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.conv_id: r for r in chat.digests(chat.windows(df)).collect()}
    assert (out[None].n_turns, out[None].turns_sha256) == (2, sha("\n\nuser\nx\n"))
    assert (out[5].n_turns, out[5].loss_chars) == (2, 0) and out[6].loss_chars == 200_000
    assert chat.windows(df.limit(0)).collect() == []


def test_native_plan(spark):
    plan = plan_text(registry.op10_chat_format(spark, SF001))
    assert "Python" not in plan and "Arrow" not in plan
