"""Operator 10: chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows at turn borders by prefix sums of turn
tokens (whitespace words, at least one).  A window holds the leading system
turns again, then as many turns before its first new one as ``history``
tokens allow, then its new turns.  Repeated turns are masked from the loss;
every assistant text is under the loss mask of exactly one window.

Prefix sums have two levels: blocks of turn numbers are summed and these sums
added up, then turns are added up within their block.  So a conversation that
holds a third of all turns is spread over tasks by block and then by window.

Template of a turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
Control strings inside roles and texts get a backslash after their first
character, and backslashes are doubled; reading back drops each escaping
backslash, so any text comes back unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import nz

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; "<|" covers all of that form.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


@dataclass(frozen=True)
class Budget:
    """Tokens of new turns that share a window, and of history repeated before
    them; prefix sums run within blocks of ``block_turns`` turn numbers."""

    fresh: int = 512
    history: int = 128
    block_turns: int = 1024


def escape(text: Column, *more: str) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    for c in more:
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def block_starts(t: DataFrame) -> DataFrame:
    """Per block of turns: turns and tokens of the conversation ahead of it, and
    the text of the conversation's first turn if that is a system turn."""
    sums = t.groupBy("block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.min(F.struct("turn", "role", "text")).alias("first"))
    ahead = Window.partitionBy("block.conv_id").orderBy(F.col("block.at").asc_nulls_first())
    so_far = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("first", F.first("first").over(so_far))
    return sums.select(
        "block",
        (F.sum("n").over(so_far) - F.col("n")).alias("n_ahead"),
        (F.sum("tokens").over(so_far) - F.col("tokens")).alias("tokens_ahead"),
        F.when(F.col("first.role") == "system", F.col("first.text")).alias("system_text"),
    )


def windows(
    turns: DataFrame, budget: Budget = Budget(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per window: conv_id, window, n_turns, n_repeated, formatted, loss_spans.

    formatted holds ``n_repeated`` repeated turns, then ``n_turns`` new ones;
    loss_spans is an array of (start, length), from 1, in characters of
    formatted: the escaped texts of the new assistant turns, in order.

    * Order is by turn (NULL first), then role and text, so ties and repeated
      rows have a defined place; every row is one turn.
    * NULL role or text is empty.  Rows of NULL conv_id form one conversation.
    * A turn longer than the budget ends its window; it is never cut.
    * Extra columns are ignored; an empty table gives no window.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), nz(F.col(role_col)).alias("role"), nz(F.col(text_col)).alias("text")
    )
    header, body = F.concat(F.lit(START), escape(F.col("role"), "\n"), F.lit("\n")), escape(F.col("text"))
    block = F.struct("conv_id", F.floor(F.col("turn") / F.lit(budget.block_turns)).alias("at"))
    words = F.greatest(F.lit(1), F.size(F.split(F.trim("text"), r"\s+"))).cast("long")
    t = t.withColumns({"block": block, "tokens": words})
    t = t.join(block_starts(t), "block")
    order = Window.partitionBy("block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns(
        {
            "n": F.col("n_ahead") + F.row_number().over(order),
            "before": F.col("tokens_ahead") + F.sum("tokens").over(so_far) - F.col("tokens"),
            "earlier": F.lag("tokens").over(order),
            "header": F.length(header),
            "body": F.length(body),
            "piece": F.concat(header, body, F.lit(END + "\n")),
        }
    )
    t = t.withColumn("own", F.floor(F.col("before") / F.lit(budget.fresh)).cast("long"))
    # the system turn travels with the first new turn of each window (and with
    # the first turn of a block, which can't see its predecessor)
    opens = F.coalesce(F.floor((F.col("before") - F.col("earlier")) / F.lit(budget.fresh)) < F.col("own"), F.lit(True))
    system = F.concat(F.lit(START + "system\n"), escape(F.col("system_text")), F.lit(END + "\n"))
    t = t.withColumn("system", F.when(opens & (F.col("own") > 0), system)).drop("block", "system_text")
    last = F.floor((F.col("before") + F.lit(budget.history)) / F.lit(budget.fresh)).cast("long")
    t = t.withColumn("window", F.explode(F.sequence("own", F.greatest("own", last))))
    own = F.col("own") == F.col("window")
    group = Window.partitionBy("conv_id", "window")
    ordered = group.orderBy("n")
    t = t.withColumns(
        {
            "fresh": own,
            "begin": F.min(F.when(own, F.col("before"))).over(group),
            "lead": F.first("system", ignorenulls=True).over(group.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    first_system = (F.col("n") == 1) & (F.col("role") == "system") & ~F.col("fresh")
    t = t.filter("begin IS NOT NULL").filter(F.col("fresh") | ((F.col("begin") - F.col("before") <= budget.history) & ~first_system))
    at = F.coalesce(F.sum(F.length("piece")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((at + F.coalesce(F.length("lead"), F.lit(0)) + F.col("header") + 1).cast("int").alias("start"), F.col("body").cast("int").alias("length"))
    t = t.withColumn("span", F.when(F.col("fresh") & (F.col("role") == "assistant"), span))
    w = t.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list("span")).alias("loss_spans"),
        F.count_if("fresh").alias("n_turns"),
        F.count_if(~F.col("fresh")).alias("history"),
        F.first("lead").alias("lead"),
    )
    return w.select(
        "conv_id",
        "window",
        "n_turns",
        (F.col("history") + F.col("lead").isNotNull().cast("long")).alias("n_repeated"),
        F.concat(F.coalesce("lead", F.lit("")), F.array_join(F.col("pieces.piece"), "")).alias("formatted"),
        "loss_spans",
    )


def read_back(w: DataFrame) -> DataFrame:
    """The new turns and loss text of each window, parsed from its formatted text:
    conv_id, window, turns (array of role, text), loss, n_chars."""
    part = F.split("formatted", r"<\|im_start\|>")
    name = r"(?s)^((?:[^\\\n]++|\\.)*+)\n.*$"

    def turn(x: Column) -> Column:
        role = F.regexp_extract(x, name, 1)
        begin = F.length(role) + 2
        text = F.substring(x, begin, F.length(x) - begin + 1 - len(END) - 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return w.select(
        "conv_id",
        "window",
        F.transform(F.slice(part, (F.col("n_repeated") + 2).cast("int"), F.col("n_turns").cast("int")), turn).alias("turns"),
        F.array_join(loss, "").alias("loss"),
        F.length("formatted").alias("n_chars"),
    )


def digests(w: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, all read back from the formatted windows."""
    r = read_back(w)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    r = r.select("conv_id", F.struct("window", lines.alias("lines"), "loss").alias("part"), F.size("turns").alias("n"), "n_chars")
    r = r.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"))
    all_loss = F.array_join(F.col("parts.loss"), "")
    return r.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("parts.lines"), ""), 256).alias("turns_sha256"),
        F.length(all_loss).cast("long").alias("loss_chars"),
        F.sha2(all_loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
