"""Keyed writes, ids and audits."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder import operators as op
from larder.sources import append, load, load_text


def test_append_keyed_in_sequence(spark):
    existing = spark.createDataFrame([(1,), (2,)], "id long")
    new = spark.createDataFrame(
        [(1, 1), (2, 5), (3, 5), (4, None), (5, 6)], "seq long, id long"
    )
    rows = op.append_keyed(existing, new, "id").decided.collect()
    assert {r.seq: r.reason for r in rows} == {
        1: "duplicate key", 2: None, 3: "duplicate key", 4: "missing key", 5: None,
    }


def test_a_rejected_row_does_not_take_the_key(spark):
    new = spark.createDataFrame(
        [(1, 5, "bad"), (2, 5, None), (3, 5, None)], "seq long, id long, reason string"
    )
    rows = op.append_keyed(new.select("id").limit(0), new, "id").decided.collect()
    assert {r.seq: r.reason for r in rows} == {1: "bad", 2: None, 3: "duplicate key"}


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, 2, "x"), (3, 2, None), (2, 3, "z")], "seq long, id long, v string")
    assert sorted(map(tuple, op.upsert(old, new, "id").collect())) == [(1, "a"), (2, None), (3, "z")]


def test_update_can_set_null_and_ignores_unknown(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, w int")
    new = spark.createDataFrame(
        [(1, 2, "x"), (2, 2, None), (3, 9, "q")], "seq long, id long, v string"
    )
    assert sorted(map(tuple, op.update_by_key(old, new, "id", ["v"]).collect())) == [
        (1, "a", 1), (2, None, 2),
    ]


def test_next_id_of_an_empty_table(spark):
    assert op.next_id(spark.createDataFrame([], "id long"), "id").first().NextID == 1


def test_assigned_ids_are_dense_and_ordered(spark):
    values = list(range(1000)) * 3
    random.Random(1).shuffle(values)
    rows = [(v, n) for n, v in enumerate(values)]
    new = spark.createDataFrame(rows, "a long, b long").repartition(7)
    old = spark.createDataFrame([(41,), (17,)], "id long")
    got = op.assign_ids(old, new, "id", ["a", "b"]).collect()
    assert sorted((r.id, r.a, r.b) for r in got) == [
        (42 + n, a, b) for n, (a, b) in enumerate(sorted(rows))
    ]


def test_assigned_ids_of_nothing(spark):
    new = spark.createDataFrame([], "a long")
    assert op.assign_ids(None, new, "id", ["a"]).collect() == []


def test_pk_violations(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    assert {(r.key, r.n) for r in op.pk_violations(df, "id").collect()} == {(1, 2), (None, 1)}


def test_fk_violations(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id long, ref long")
    parent = spark.createDataFrame([(1,)], "pk long")
    assert [r.id for r in op.fk_violations(child, "ref", parent, "pk").collect()] == [3]


def test_type_violations(spark):
    df = spark.createDataFrame(
        [("abc", "12", "1234567.00", "2026-02-30"), ("ab", "1.5", "1.234", "2026-02-28"), (None,) * 4],
        "v string, i string, d string, t string",
    )
    spec = {"v": "VARCHAR(2)", "i": "INT", "d": "DECIMAL(8,2)", "t": "DATE"}
    found = {tuple(r) for r in op.type_violations(df, spec).collect()}
    assert found == {
        ("v", "abc", "VARCHAR(2)"),
        ("i", "1.5", "INT"),
        ("d", "1234567.00", "DECIMAL(8,2)"),
        ("t", "2026-02-30", "DATE"),
    }


def test_type_violations_of_typed_columns(spark):
    df = spark.createDataFrame(
        [(1, Decimal("1.50"), Decimal("1234567.00"), 7), (2, None, Decimal("1.00"), None)],
        "i long, whole decimal(8,2), amount decimal(12,2), n int",
    )
    spec = {"i": "INT", "whole": "INT", "amount": "DECIMAL(8,2)", "n": "DECIMAL(8,2)"}
    assert {tuple(r) for r in op.type_violations(df, spec).collect()} == {
        ("whole", "1.50", "INT"), ("amount", "1234567.00", "DECIMAL(8,2)"),
    }
    numbers = spark.createDataFrame([(Decimal("45.00"), 2.0), (Decimal("45.50"), 2.5), (None, 1e300)], "d decimal(8,2), f double")
    found = op.type_violations(numbers, {"d": "INT", "f": "INT"}).collect()
    assert sorted((r.column, r.value) for r in found) == [("d", "45.50"), ("f", "1.0E300"), ("f", "2.5")]
    assert op.type_violations(df, {"i": "INT"}).isEmpty()


def test_typed_files(spark, tmp_path):
    text = tmp_path / "recipes.csv"
    text.write_text("RecipeID,ProductID,IngredientID,quantity_required\n1,2,3,0.40\n2,2,4,\n")
    recipes = load(spark, str(text), "Recipes", "csv")
    assert [f.dataType.simpleString() for f in recipes.schema] == ["bigint"] * 3 + ["decimal(8,2)"]
    assert recipes.count() == 2
    stored = str(tmp_path / "recipes")
    append(recipes.withColumn("ProductID", F.col("ProductID").cast("int")), stored)
    append(recipes.withColumn("ProductID", F.col("ProductID").cast("int")), stored)
    again = load(spark, stored, "Recipes")
    assert again.schema == recipes.schema
    assert again.count() == 4


def test_a_bad_file_is_an_error_and_auditable(spark, tmp_path):
    text = tmp_path / "recipes.csv"
    text.write_text("RecipeID,ProductID,IngredientID,quantity_required\n1,x,3,0.40\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        load(spark, str(text), "Recipes", "csv").collect()
    raw = load_text(spark, str(text), "Recipes")
    found = op.type_violations(raw, {"ProductID": "INT", "quantity_required": "DECIMAL(8,2)"})
    assert [tuple(r) for r in found.collect()] == [("ProductID", "x", "INT")]


def test_upsert_refuses_missing_keys(spark):
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, 1, "z")], "seq long, k long, v string")
    assert sorted(map(tuple, op.upsert(base, new, "k").collect())) == [(1, "z")]
    assert {(r.seq, r.reason) for r in op.missing_keys(new, "k").collect()} == {(1, "missing key"), (2, "missing key")}


def test_unknown_columns_of_a_mapping(spark, tmp_path):
    spark.createDataFrame([(1,)], "x long").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no column SupplierId"):
        load(spark, str(tmp_path / "t"), "Suppliers", columns={"SupplierId": F.col("x")})
