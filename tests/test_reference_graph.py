"""D6-D9 as one change: chains, cycles, restrict, renames, all or nothing;
against a plain worklist in Python."""

import random

import pytest

from ledgerline.operators.reference_graph import apply_change


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in columns))


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def keys(spark, column, *ks):
    return frame(spark, [(k,) for k in ks], [column])


TREE = [("node", "up", "node", "id", "cascade")]


def test_a_table_that_refers_to_itself_with_a_cycle(spark):
    node = frame(spark, [(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 7), (8, None), (9, 99)], ["id", "up"])
    got = apply_change({"node": node}, TREE, deleted={"node": keys(spark, "id", 2, 5, 7, 100)})
    assert not got.refused and got.blockers.isEmpty()
    assert values(got.tables["node"]) == values(frame(spark, [(1, None), (8, None), (9, 99)], ["id", "up"]))


def test_a_chain_longer_than_the_rounds_between_writes(spark):
    node = frame(spark, [(i, i - 1 or None) for i in range(1, 15)], ["id", "up"])
    got = apply_change({"node": node}, TREE, deleted={"node": keys(spark, "id", 2)})
    assert values(got.tables["node"]) == [(1, None)] and got.rounds == 13


def test_rows_asked_for_by_another_column_go_alone(spark):
    # a row that is deleted because of its parent does not take the rows that look like it along
    node = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, None, "b"), (4, None, "a")], "id bigint, up bigint, kind string")
    got = apply_change({"node": node}, TREE, deleted={"node": spark.createDataFrame([("a",), (None,)], "kind string")})
    assert values(got.tables["node"]) == [(3, None, "b")]


def test_restrict_and_no_action(spark):
    parent, middle = frame(spark, [(1,), (2,)], ["p"]), frame(spark, [(10, 1), (11, 2)], ["m", "p"])
    leaf = frame(spark, [(100, 10, 1), (101, 10, 1), (102, 11, None)], ["l", "m", "p"])
    tables = {"parent": parent, "middle": middle, "leaf": leaf}
    refs = [("middle", "p", "parent", "p", "cascade"), ("leaf", "m", "middle", "m", "cascade")]

    late = apply_change(tables, [*refs, ("leaf", "p", "parent", "p", "no_action")], deleted={"parent": keys(spark, "p", 1)})
    assert not late.refused and values(late.tables["leaf"]) == [(102, 11, None)]

    at_once = apply_change(tables, [*refs, ("leaf", "p", "parent", "p", "restrict")], deleted={"parent": keys(spark, "p", 1)})
    assert at_once.refused and values(at_once.blockers) == [("leaf.p -> parent.p", "1", 2)]
    assert all(at_once.tables[t] is tables[t] for t in tables)

    named = apply_change(tables, [*refs, ("leaf", "p", "parent", "p", "restrict")], deleted={"parent": keys(spark, "p", 1), "leaf": keys(spark, "l", 100, 101)})
    assert not named.refused and values(named.tables["leaf"]) == [(102, 11, None)]

    deep = apply_change(tables, [refs[0], ("leaf", "m", "middle", "m", "restrict")], deleted={"parent": keys(spark, "p", 1)})
    assert deep.refused and values(deep.blockers) == [("leaf.m -> middle.m", "10", 2)]


def test_renamed_keys_reach_grandchildren_and_clash(spark):
    a, b, c = frame(spark, [(1,), (2,), (3,)], ["k"]), frame(spark, [(1,), (2,)], ["k"]), frame(spark, [(7, 1), (8, None), (9, 5)], ["c", "k"])
    tables = {"a": a, "b": b, "c": c}
    refs = [("b", "k", "a", "k", "cascade"), ("c", "k", "b", "k", "cascade")]

    def renaming(*pairs, **more):
        return apply_change(tables, refs, renamed={"a": ("k", frame(spark, list(pairs), ["old_key", "new_key"]))}, **more)

    got = renaming((1, 2), (2, 1), (50, 3))     # a swap; 50 is nobody's key
    assert not got.refused
    assert [values(got.tables[t]) for t in "abc"] == [[(1,), (2,), (3,)], [(1,), (2,)], [(7, 2), (8, None), (9, 5)]]
    assert values(renaming((1, 3)).blockers) == [("a.k: new key in use", "3", 1)]
    assert values(renaming((1, 6), (1, 7)).blockers) == [("a.k: old key mapped twice", "1", 2)]
    assert values(renaming((1, 6), (2, 6)).blockers) == [("a.k: new key given twice", "6", 2)]
    freed = renaming((1, 3), deleted={"a": keys(spark, "k", 3)})
    assert not freed.refused and values(freed.tables["c"]) == [(7, 3), (8, None), (9, 5)]


def test_empty_tables_and_unknown_actions(spark):
    none = frame(spark, [], ["id", "up"])
    got = apply_change({"node": none}, TREE, deleted={"node": keys(spark, "id", 1)})
    assert got.tables["node"].count() == 0 and not got.refused
    with pytest.raises(ValueError):
        apply_change({"node": none}, [("node", "up", "node", "id", "ignore")])


@pytest.mark.parametrize("seed", range(3))
def test_against_a_worklist(spark, seed):
    rng = random.Random(seed)

    def pick(n):
        return rng.choice([None, *range(n), n + 5])

    n = 40
    rows = {"x": [(i, pick(n), pick(n)) for i in range(n)], "y": [(i, pick(n), pick(n)) for i in range(n)]}
    refs = [("x", "r", "x", "id", "cascade"), ("x", "s", "y", "id", "set_null"), ("y", "r", "x", "id", "cascade"), ("y", "s", "y", "id", "set_null")]
    dead = {("x", k) for k in rng.sample(range(n), 3)}
    wanted = [k for _, k in dead]
    todo = list(dead)
    while todo:
        t, k = todo.pop()
        for child, fk, parent, _, action in refs:
            if parent == t and action == "cascade":
                for row in rows[child]:
                    if row["id r s".split().index(fk)] == k and (child, row[0]) not in dead:
                        dead.add((child, row[0]))
                        todo.append((child, row[0]))
    expected = {t: sorted([(i, r, None if ("y", s) in dead else s) for i, r, s in rows[t] if (t, i) not in dead], key=str) for t in rows}
    got = apply_change({t: frame(spark, rows[t], ["id", "r", "s"]) for t in rows}, refs, deleted={"x": keys(spark, "id", *wanted)})
    assert {t: values(got.tables[t]) for t in rows} == expected
