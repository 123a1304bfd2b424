"""S1 with a reject channel: broken lines are kept, placed and explained."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from ledgerline.sources.rejects import load_csv

HEADER = "product_id,product_category_name\n"


def dump(files: dict[str, str]) -> str:
    path = tempfile.mkdtemp(prefix="ll-rejects-")
    for name, text in files.items():
        with open(os.path.join(path, name), "w") as f:
            f.write(text)
    return path


def found(load):
    return sorted((r.file.rsplit("/", 1)[1], r.record, r.line, r.problem, r.column_name) for r in load.rejects.collect())


def test_rejects_name_file_record_line_and_problem(spark):
    path = dump({
        "a.csv": HEADER + '1,x\n\n2\n3,"say ""a, b"""\nfour,y\n5,z,extra\n,\n',
        "b.csv": HEADER + "99999999999999999999,big\n6,ok\n",
        "c.csv": HEADER,
    })
    load = load_csv(spark, path, "products")
    assert sorted(map(tuple, load.rows.collect()), key=str) == sorted([(1, "x"), (3, 'say "a, b"'), (None, None), (6, "ok")], key=str)
    assert found(load) == [
        ("a.csv", 2, "2", "field_count", None),
        ("a.csv", 4, "four,y", "value", "product_id"),
        ("a.csv", 5, "5,z,extra", "field_count", None),
        ("b.csv", 1, "99999999999999999999,big", "value", "product_id"),
    ]
    assert sorted((r.file.rsplit("/", 1)[1], r.n_records, r.n_rejected) for r in load.report.collect()) == [("a.csv", 6, 3), ("b.csv", 2, 1)]


def test_records_are_counted_over_the_blocks_of_a_file(spark):
    lines = [f"{i},name {i}" if i % 97 else f"x{i},name {i}" for i in range(1, 5001)]
    path = dump({"big.csv": HEADER + "\n".join(lines) + "\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        load = load_csv(spark, path, "products")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rejects = load.rejects.collect()
    assert len({r.block for r in rejects}) > 3
    assert sorted((r.record, r.line) for r in rejects) == [(i, lines[i - 1]) for i in range(97, 5001, 97)]
    assert load.rows.count() + len(rejects) == 5000


def test_quoted_line_breaks(spark):
    path = dump({"a.csv": HEADER + '1,"two\nlines"\nx,"also\ntwo"\n2,c\n'})
    load = load_csv(spark, path, "products", multi_line=True)
    assert sorted(map(tuple, load.rows.collect())) == [(1, "two\nlines"), (2, "c")]
    assert [(r[1], r[3], r[4]) for r in found(load)] == [(2, "value", "product_id")]


def test_another_header_fails_the_load(spark):
    path = dump({"a.csv": HEADER + "1,x\n", "b.csv": "product_category_name,product_id\nx,1\n"})
    with pytest.raises(Exception, match="header"):
        load_csv(spark, path, "products")


def test_without_header_and_with_no_records(spark):
    load = load_csv(spark, dump({"a.csv": "1,x\n"}), "products", header=False)
    assert [tuple(r) for r in load.rows.collect()] == [(1, "x")]
    empty = load_csv(spark, dump({"a.csv": HEADER}), "products")
    assert empty.rows.count() == empty.rejects.count() == empty.report.count() == 0


def test_typed_columns_of_a_given_schema(spark):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("at", T.DateType()), T.StructField("price", T.DecimalType(6, 2))])
    load = load_csv(spark, dump({"a.csv": "1,2024-02-30,1.5\n2,2024-02-29,1.5\n3,2024-02-29,abc\n 4,2024-02-29,1\n"}), schema, header=False)
    assert [(r.k, r.problem, r.column_name) for r in load.rejects.selectExpr("int(trim(split(line, ',')[0])) AS k", "problem", "column_name").sort("k").collect()] == [
        (1, "value", "at"), (3, "value", "price"), (4, "value", "k")]
    assert load.rows.count() == 1
