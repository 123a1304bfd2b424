"""D6-D9 as one change over a whole graph of declared references.

The rows asked for are deleted, the deletion follows the references from parent
to child as far as it goes, and renamed keys reach every column that refers to
them. Either the whole change is made or none of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.io import materialize

# (child, fk column, parent, parent key, action on parent delete)
Reference = tuple[str, str, str, str, str]
ACTIONS = ("cascade", "set_null", "restrict", "no_action")
# Long chains: the keys found so far are written as one table after so many rounds.
ROUNDS_A_WRITE = 10


@dataclass(frozen=True)
class Change:
    """``tables``: the next versions, or the given ones if the change is refused.
    ``blockers``: reference, key_value, blocking_rows; empty if it is made.
    ``rounds``: how many times a deletion was carried on to children."""

    tables: dict[str, DataFrame]
    blockers: DataFrame
    refused: bool
    rounds: int


def _label(ref: Reference) -> str:
    child, fk, parent, pk, _ = ref
    return f"{child}.{fk} -> {parent}.{pk}"


def _mark(df: DataFrame, column: str, keys: DataFrame, mark: Column, name: str) -> DataFrame:
    """``df`` with a column ``name``: ``mark`` of the row of ``keys`` (a distinct
    ``_key``) that equals ``column``, else NULL. Rows without a value, however many,
    are dealt by all their columns."""
    marked = keys.select(F.col("_key"), F.xxhash64("_key").alias("_key_deal"), mark.alias(name))
    deal = F.when(F.col(column).isNull(), F.xxhash64(*df.columns)).otherwise(F.xxhash64(column))
    j = df.withColumn("_deal", deal).join(marked, (F.col("_deal") == F.col("_key_deal")) & (F.col(column) == F.col("_key")), "left")
    return j.drop("_deal", "_key", "_key_deal")


def _gone(df: DataFrame, table: str, dead: Mapping[tuple[str, str], DataFrame], references: Sequence[Reference], own: bool = True) -> DataFrame:
    """``df`` with the column ``_gone``: whether the row is deleted, by a key of its own
    or by a parent that it cascades from."""
    hits = []
    if own:
        hits += [(key, (t, key)) for t, key in dead if t == table]
    hits += [(fk, (parent, pk)) for child, fk, parent, pk, action in references if child == table and action == "cascade" and (parent, pk) in dead]
    for i, (column, at) in enumerate(hits):
        df = _mark(df, column, dead[at], F.lit(True), f"_gone{i}")
    names = [f"_gone{i}" for i in range(len(hits))]
    return df.withColumn("_gone", F.coalesce(*names, F.lit(False))).drop(*names)


def _deleted_keys(
    tables: Mapping[str, DataFrame], references: Sequence[Reference], requested: Mapping[str, DataFrame]
) -> tuple[dict[tuple[str, str], DataFrame], dict[tuple[str, str], DataFrame], int]:
    """Keys of all deleted rows and of the requested ones, by (table, key column),
    and the rounds taken: each round carries the keys that the last one found on
    to the children that are parents themselves, until nothing new is found."""
    referenced = {(parent, pk) for _, _, parent, pk, _ in references}

    def keys_of(table: str, rows: DataFrame, *more: str) -> dict[tuple[str, str], DataFrame]:
        columns = sorted({c for t, c in referenced if t == table} | set(more))
        return {(table, c): rows.filter(F.col(c).isNotNull()).select(F.col(c).alias("_key")).distinct() for c in columns}

    fresh: dict[tuple[str, str], DataFrame] = {}
    for table, wanted in requested.items():
        column = wanted.columns[0]
        rows = tables[table].join(wanted.select(column).distinct(), column, "left_semi")
        for at, keys in keys_of(table, rows, column).items():
            fresh[at] = materialize(keys, "deleted-keys")
    fresh = {at: keys for at, keys in fresh.items() if not keys.isEmpty()}
    asked, dead, rounds = dict(fresh), {}, 0
    while fresh:
        for at, keys in fresh.items():
            dead[at] = dead[at].unionByName(keys) if at in dead else keys
            if rounds % ROUNDS_A_WRITE == ROUNDS_A_WRITE - 1:
                dead[at] = materialize(dead[at], "deleted-keys")
        following: dict[tuple[str, str], DataFrame] = {}
        carried = [r for r in references if r[4] == "cascade" and (r[2], r[3]) in fresh]
        for table in dict.fromkeys(r[0] for r in carried):
            if not any(t == table for t, _ in referenced):
                continue
            rows = reduce(DataFrame.unionByName, [
                tables[table].join(fresh[(parent, pk)].withColumnRenamed("_key", fk), fk, "left_semi").select(*tables[table].columns)
                for child, fk, parent, pk, _ in carried if child == table
            ])
            for at, keys in keys_of(table, rows).items():
                new = materialize(keys.join(dead[at], "_key", "left_anti") if at in dead else keys, "deleted-keys")
                if not new.isEmpty():
                    following[at] = new
        fresh = following
        rounds += 1
    return dead, asked, rounds


def _renames(references: Sequence[Reference], renamed: Mapping[str, DataFrame], keys: Mapping[str, str]) -> dict[tuple[str, str], DataFrame]:
    """The mapping of every (table, column) that a renamed key reaches, over any
    number of references."""
    reached = {(t, keys[t]): m for t, m in renamed.items()}
    todo = list(reached)
    while todo:
        table, column = todo.pop()
        for child, fk, parent, pk, _ in references:
            if (parent, pk) != (table, column) or reached.get((child, fk)) is reached[table, column]:
                continue
            if (child, fk) in reached:
                raise ValueError(f"{child}.{fk} would follow two renamed keys")
            reached[child, fk] = reached[table, column]
            todo.append((child, fk))
    return reached


def apply_change(
    tables: Mapping[str, DataFrame],
    references: Sequence[Reference],
    deleted: Mapping[str, DataFrame] | None = None,
    renamed: Mapping[str, tuple[str, DataFrame]] | None = None,
) -> Change:
    """Delete and rename rows of several tables in one step.

    ``deleted``: by table, a DataFrame whose first column bears the name of a
    column of the table; rows with one of its values are deleted. Values that the
    table lacks, repeated ones and NULL delete nothing more.
    ``renamed``: by table, a key column and a DataFrame (old_key, new_key).

    - 'cascade': children of deleted rows are deleted, and theirs, over any
      number of tables, cycles and references of a table to itself included.
    - 'set_null': children that stay lose the reference.
    - 'restrict': a row that the request itself does not delete and that refers to a
      deleted row blocks the change.
    - 'no_action': only rows that stay in the end block it.
    - A renamed key changes in its table and in all columns that refer to it. It
      blocks the change if its old key is mapped twice, if two old keys get
      one new key, or if a row that stays and isn't renamed has the new key.

    With a blocker the tables come back as they were given. Referenced keys are
    taken to be unique (see ``integrity.key_violations``); of equal keys all rows go. NULL
    refers to nothing. Keys found in a round are written under the
    shared checkpoint folder; the driver learns only whether there are any. A round costs
    one join per reference that it follows, of the child with new keys alone.
    """
    deleted, renamed = dict(deleted or {}), dict(renamed or {})
    for ref in references:
        if ref[4] not in ACTIONS:
            raise ValueError(f"unknown action {ref[4]!r} of {_label(ref)}")
    dead, asked, rounds = _deleted_keys(tables, references, deleted)

    blocking = []
    for child, fk, parent, pk, action in references:
        if action not in ("restrict", "no_action") or (parent, pk) not in dead:
            continue
        if action == "restrict":
            # only rows that the request names are no longer there
            own = {at: keys for at, keys in asked.items() if at[0] == child}
            rows = _gone(tables[child], child, own, [])
        else:
            rows = _gone(tables[child], child, dead, references)
        refs = rows.filter(~F.col("_gone") & F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_key")).agg(F.count(F.lit(1)).alias("blocking_rows"))
        blocking.append(refs.join(dead[parent, pk], "_key", "left_semi").select(
            F.lit(_label((child, fk, parent, pk, action))).alias("reference"), F.col("_key").cast("string").alias("key_value"), "blocking_rows"))

    maps = {t: m.select(F.col("old_key").alias("_key"), F.col("new_key").alias("_new")).filter("_key IS NOT NULL") for t, (_, m) in renamed.items()}
    for table, (key, _) in renamed.items():
        m = maps[table]
        stays = _gone(tables[table].select(*dict.fromkeys([key, *_columns_at(table, dead, references)])), table, dead, references)
        stays = stays.filter(~F.col("_gone") & F.col(key).isNotNull()).select(F.col(key).alias("_key"))
        used = m.join(stays.distinct(), "_key", "left_semi")
        fixed = stays.join(m, "_key", "left_anti").groupBy("_key").agg(F.count(F.lit(1)).alias("blocking_rows"))
        clashes = [
            m.groupBy("_key").agg(F.count(F.lit(1)).alias("blocking_rows")).filter("blocking_rows > 1"),
            used.groupBy(F.col("_new").alias("_key")).agg(F.count(F.lit(1)).alias("blocking_rows")).filter("blocking_rows > 1"),
            fixed.join(used.select(F.col("_new").alias("_key")).distinct(), "_key", "left_semi"),
        ]
        for label, rows in zip(("old key mapped twice", "new key given twice", "new key in use"), clashes):
            blocking.append(rows.select(F.lit(f"{table}.{key}: {label}").alias("reference"), F.col("_key").cast("string").alias("key_value"), "blocking_rows"))

    spark = next(iter(tables.values())).sparkSession
    none = spark.createDataFrame([], "reference string, key_value string, blocking_rows bigint")
    if not blocking:
        blockers, refused = none, False
    else:
        blockers = materialize(reduce(DataFrame.unionByName, blocking), "blockers")
        refused = not blockers.isEmpty()
    if refused:
        return Change(dict(tables), blockers, True, rounds)

    reached = _renames(references, maps, {t: key for t, (key, _) in renamed.items()})
    after = {}
    for table, df in tables.items():
        columns = df.columns
        if any((r[2], r[3]) in dead for r in references if r[0] == table and r[4] == "cascade") or any(t == table for t, _ in dead):
            df = _gone(df, table, dead, references).filter(~F.col("_gone")).drop("_gone")
        for child, fk, parent, pk, action in references:
            if child == table and action == "set_null" and (parent, pk) in dead:
                df = _mark(df, fk, dead[parent, pk], F.lit(True), "_lost").withColumn(fk, F.when(F.col("_lost").isNull(), F.col(fk))).drop("_lost")
        for (t, column), m in reached.items():
            if t == table:
                df = _mark(df, column, m, F.col("_new"), "_renamed").withColumn(column, F.coalesce(F.col("_renamed"), F.col(column))).drop("_renamed")
        after[table] = df.select(*columns)
    return Change(after, blockers, False, rounds)


def _columns_at(table: str, dead: Mapping[tuple[str, str], DataFrame], references: Sequence[Reference]) -> list[str]:
    """The columns of ``table`` that tell whether a row is deleted."""
    own = [c for t, c in dead if t == table]
    return own + [fk for child, fk, parent, pk, action in references if child == table and action == "cascade" and (parent, pk) in dead]
