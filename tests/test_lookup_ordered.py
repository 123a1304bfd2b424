"""S8 lookup layout and S9 positions: rows kept, row groups skipped, order."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerline.sources.lookup import lookup, rank_bounds, write_lookup_layout
from ledgerline.sources.ordered import FOLDER, read_page, with_positions, write_in_order
from tests.conftest import plan_text

ROWS, BLOCK, FILES = 80_000, 100, 8
COLUMNS = ["customer", "bought", "product", "seller", "category"]


def _items(spark):
    """A third of the rows has one customer, one seller and one category."""
    n, hot = F.col("id"), F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        n,
        F.when(hot, F.lit("hot")).otherwise(F.sha2(F.concat(F.lit("c"), (F.xxhash64(n) % 20_000).cast("string")), 256)).alias("customer"),
        (F.lit(dt.datetime(2018, 1, 1)).cast("timestamp_ntz") + F.make_interval(secs=F.abs(F.hash(n)) % 30_000_000)).alias("bought"),
        F.pmod(F.xxhash64(n, F.lit(1)), F.lit(30_000)).alias("product"),
        F.when(hot, F.lit(0)).otherwise(F.pmod(F.hash(n, F.lit(2)), F.lit(2_000))).alias("seller"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.pmod(F.hash(n, F.lit(3)), F.lit(70)).cast("string"))).alias("category"),
    )


def _rows_read(df) -> int:
    """Rows of the row groups that the scan decoded (its own metric)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "items")
    stored = str(tmp_path_factory.mktemp("lookup") / "rows")
    _items(spark).write.parquet(stored)
    write_lookup_layout(spark.read.parquet(stored), path, COLUMNS, FILES, BLOCK)
    return spark.read.parquet(stored), spark.read.parquet(path), path


def test_layout_keeps_every_row_and_cuts_row_groups(laid_out):
    rows, laid, path = laid_out
    assert laid.columns == [*rows.columns, "_day_of_bought"]
    assert laid.drop("_day_of_bought").exceptAll(rows).count() == 0 and laid.count() == ROWS
    groups = [g for f in pq.ParquetDataset(path).fragments for g in f.row_groups]
    assert len(groups) >= ROWS / BLOCK and all(g.num_rows <= BLOCK for g in groups)
    # a hot value isn't one file
    sizes = [f.count_rows() for f in pq.ParquetDataset(path).fragments]
    assert max(sizes) < 2 * ROWS / FILES


# 800 row groups over five columns: about 800^(1/5) = 3.8 cuts of each column
@pytest.mark.parametrize("column, wanted, share", [
    ("customer", "point", 0.05), ("product", "point", 0.05), ("seller", "point", 0.1), ("category", "point", 0.5), ("bought", "point", 0.4),
    ("product", (500, 800), 0.5), ("seller", (500, 510), 0.5), ("bought", (dt.datetime(2018, 6, 1), dt.datetime(2018, 6, 4)), 0.5),
])
def test_lookup_by_each_column_skips_row_groups(spark, laid_out, column, wanted, share):
    rows, laid, _ = laid_out
    if wanted == "point":
        value = rows.where(~F.col(column).cast("string").isin("hot", "0")).orderBy("id").first()[column]
        found, condition = lookup(laid, column, [value]), F.col(column) == F.lit(value)
    else:
        low, before = wanted
        found = lookup(laid, column, low=low, before=before)
        condition = (F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(before))
    expected = rows.where(condition)
    assert found.columns == rows.columns
    assert found.exceptAll(expected).count() == 0 and found.count() == expected.count() > 0
    spark.conf.set("parquet.filter.columnindex.enabled", "false")  # whole row groups are read or skipped
    try:
        read = _rows_read(found)
    finally:
        spark.conf.unset("parquet.filter.columnindex.enabled")
    print(column, wanted, read / ROWS)
    assert read < share * ROWS


def test_lookup_of_nothing_and_of_hot_values(laid_out):
    rows, laid, _ = laid_out
    assert lookup(laid, "product", []).count() == 0 and lookup(laid, "customer", ["nobody"]).count() == 0
    assert lookup(laid, "seller", [0, 1]).count() == rows.where("seller in (0, 1)").count() > ROWS // 3
    assert lookup(laid, "product", before=0).count() == 0 and lookup(laid, "product", low=0).count() == ROWS
    with pytest.raises(ValueError):
        lookup(laid, "product")
    with pytest.raises(ValueError):
        lookup(laid, "product", [1], low=2)


def test_layout_of_odd_rows(spark, tmp_path):
    rows = [(None, None, "a", 1), (5, float("nan"), None, 1), (5, float("nan"), None, 1), (-2 ** 62, float("inf"), "b", 2), (None, -0.0, "a", 3)]
    df = spark.createDataFrame(rows, "k long, x double, s string, _cell int")
    write_lookup_layout(df, str(tmp_path / "odd"), ["k", "x", "s", "_cell"], 3)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    write_lookup_layout(df.where("false"), str(tmp_path / "none"), ["k", "s"], 3)
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).count() == 0
    assert rank_bounds(df.where("k is null"), ["k"], 3) == {"k": []}
    with pytest.raises(ValueError):
        write_lookup_layout(df, str(tmp_path / "bad"), ["k", "k"], 3)
    with pytest.raises(ValueError):
        write_lookup_layout(df, str(tmp_path / "bad"), ["k"], 3, bits=9)


def test_positions_with_a_hot_key_and_nulls(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("key"), F.lit(1).alias("_row"))
    placed = with_positions(df, [F.col("key").asc_nulls_last()])
    got = sorted(placed.select("position", "key", "id").collect())
    assert [r[0] for r in got] == list(range(1, 20_001))
    keys = [r[1] for r in got]
    known = [k for k in keys if k is not None]
    assert keys[:len(known)] == known == sorted(known)
    assert sorted(r[2] for r in got) == list(range(20_000))
    assert "Window" not in plan_text(placed)


def test_positions_of_no_rows_and_of_copies(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (None, None)], "k int, s string")
    got = sorted(with_positions(df, [F.col("k").desc_nulls_first()]).select("position", "k").collect())
    assert got == [(1, None), (2, 2), (3, 1), (4, 1)]
    assert with_positions(df.where("false"), ["k"]).collect() == []
    with pytest.raises(ValueError):
        with_positions(df.withColumn("Position", F.lit(1)), ["k"])


def test_pages_read_their_folders_only(spark, tmp_path):
    path = str(tmp_path / "ordered")
    df = spark.range(5_000).select((F.lit(5_000) - F.col("id")).alias("k"))
    write_in_order(df, path, ["k"], block_rows=1_000)
    folders = sorted(p.name for p in (tmp_path / "ordered").iterdir() if p.is_dir())
    assert folders == [f"{FOLDER}={p:019d}" for p in (1, 1001, 2001, 3001, 4001)]
    stored = spark.read.parquet(path)
    page = read_page(stored, 1_500, 2_100, 1_000)
    assert [tuple(r) for r in page.collect()] == [(k, k) for k in range(1_500, 2_101)]
    assert len(page.inputFiles()) >= 1 and _rows_read(stored.where(F.col(FOLDER).cast("bigint").between(1_001, 2_001))) == 2_000
    assert read_page(stored, 10, 9, 1_000).collect() == [] and read_page(stored, 9_000, 9_100, 1_000).collect() == []
