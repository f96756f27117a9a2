"""The ledger: NULLs, repeated recipe lines, and equal results in any split."""

from __future__ import annotations

import random
from decimal import Decimal

from larder import operators as op

STOCK = "IngredientID long, Current_stock decimal(20,2)"
RECIPE = "RecipeID long, ProductID long, IngredientID long, quantity_required decimal(8,2)"


def stock_of(df):
    return {r.IngredientID: r.Current_stock for r in df.collect()}


def test_receipts(spark):
    stock = spark.createDataFrame([(n, Decimal(10)) for n in (1, 2, 3)] + [(4, None)], STOCK)
    batches = spark.createDataFrame(
        [(1, 5), (1, 6), (2, None), (2, 1), (4, 1), (9, 1), (None, 1)],
        "IngredientID long, Quantity_Received int",
    )
    assert stock_of(op.apply_batch_receipts(stock, batches)) == {1: 21, 2: None, 3: 10, 4: None}


def test_deductions(spark):
    stock = spark.createDataFrame([(n, Decimal(10)) for n in range(1, 7)], STOCK)
    recipes = spark.createDataFrame(
        [
            (1, 1, 1, Decimal("0.30")),
            (3, 1, 2, Decimal("9.00")),
            (2, 1, 2, Decimal("0.50")),
            (4, 2, 3, Decimal("1.00")),
            (5, 1, 4, None),
            (6, 1, 5, Decimal("4.00")),
            (7, 3, 6, Decimal("1.00")),
            (8, 1, None, Decimal("1.00")),
        ],
        RECIPE,
    )
    lines = spark.createDataFrame(
        [(1, 2), (1, 1), (2, None), (2, 1), (77, 5), (None, 1)], "ProductID long, Quantity int"
    )
    assert stock_of(op.deduct_ingredients(stock, recipes, lines)) == {
        1: Decimal("9.10"), 2: Decimal("8.50"), 3: None, 4: None, 5: Decimal("-2.00"), 6: 10,
    }


def test_a_null_recipe_line_that_counts_poisons(spark):
    stock = spark.createDataFrame([(1, Decimal(10))], STOCK)
    recipes = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, Decimal(1))], RECIPE)
    lines = spark.createDataFrame([(1, 2)], "ProductID long, Quantity int")
    assert stock_of(op.deduct_ingredients(stock, recipes, lines)) == {1: None}


def test_one_batch_equals_line_by_line(spark):
    rng = random.Random(3)
    stock = {n: Decimal(1000) for n in range(8)}
    recipe = {}
    for n in range(30):
        recipe.setdefault((rng.randrange(6), rng.randrange(8)), (n, Decimal(rng.randrange(1, 500)) / 100))
    lines = [(rng.randrange(7), rng.randrange(1, 9)) for _ in range(60)]
    want = dict(stock)
    for product, quantity in lines:
        for (p, i), (_, need) in recipe.items():
            if p == product:
                want[i] -= need * quantity
    recipes = spark.createDataFrame([(n, p, i, q) for (p, i), (n, q) in recipe.items()], RECIPE)
    got = spark.createDataFrame(list(stock.items()), STOCK)
    rows = spark.createDataFrame(lines, "ProductID long, Quantity int")
    assert stock_of(op.deduct_ingredients(got, recipes, rows)) == want
    for part in (lines[:1], lines[1:20], lines[20:]):
        rows = spark.createDataFrame(part, "ProductID long, Quantity int")
        got = op.deduct_ingredients(got, recipes, rows)
    assert stock_of(got) == want


def test_final_total(spark):
    df = spark.createDataFrame(
        [(Decimal(10), Decimal(1), Decimal(3)), (Decimal(10), None, Decimal(0))],
        "Total_Amount decimal(8,2), Tax_Amount decimal(8,2), Discount_Amount decimal(8,2)",
    )
    assert [r.Final_Total for r in op.order_final_total(df).collect()] == [8, None]


def test_rollup(spark):
    orders = spark.createDataFrame(
        [(n, Decimal(7), Decimal(99)) for n in (1, 2, 3)],
        "Order_ID long, Total_Amount decimal(8,2), Final_Total decimal(8,2)",
    )
    lines = "Order_ID long, Line_Total decimal(8,3)"
    old = spark.createDataFrame([(1, Decimal("1.5")), (2, Decimal(4))], lines)
    new = spark.createDataFrame([(1, Decimal(2)), (1, None), (3, None), (None, Decimal(1))], lines)
    after = op.rollup_order_total(orders, old.union(new), new)
    assert {r.Order_ID: (r.Total_Amount, r.Final_Total) for r in after.collect()} == {
        1: (Decimal("3.5"), 99), 2: (7, 99), 3: (None, 99),
    }
