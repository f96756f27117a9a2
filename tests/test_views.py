"""Edge rows of the views, lookups and expressions."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.functions import label, label_id, lenient_int, strip, warranty_status
from larder.plans import lookups, views

INGREDIENTS = (
    "IngredientID long, Name string, CategoryID long, unit_of_measure string,"
    " Reorder_level string, Current_stock decimal(20,2)"
)
ORDERS = (
    "Order_ID long, CustomerID long, Order_Date string, Total_Amount int, Tax_Amount int,"
    " Discount_Amount int, Final_Total int"
)


def test_lenient_int(spark):
    texts = ["20", "12abc", "abc", "", None, " -7", "+3", "1.9", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(lenient_int(F.col("t"))).collect()]
    assert got == [20, 12, 0, 0, None, -7, 3, 1, 0]


def test_stock_status_with_nulls(spark):
    rows = [
        (1, "a", 1, "kg", "10", Decimal(9)),
        (2, "b", 1, "kg", "10", Decimal(10)),
        (3, "c", 1, "kg", None, Decimal(1)),
        (4, "d", 1, "kg", "10", None),
        (5, "e", 1, "kg", "12abc", Decimal(11)),
        (6, "f", 9, "kg", "10", Decimal(1)),
    ]
    kinds = spark.createDataFrame([(1, "k")], "CategoryID long, CategoryName string")
    levels = views.current_stock_levels(spark.createDataFrame(rows, INGREDIENTS), kinds)
    status = {r.IngredientID: r.StockStatus for r in levels.collect()}
    assert status == {1: "LOW", 2: "OK", 3: "OK", 4: "OK", 5: "LOW"}


def test_pending_orders_drop_null_status(spark):
    pos = spark.createDataFrame(
        [(1, 1, "Delivered"), (2, 1, "delivered"), (3, 1, None), (4, 2, "Pending")],
        "PO_ID long, SupplierID long, Status string",
    ).withColumns({c: F.lit(None) for c in ("Order_date", "Exp_deleivey_date", "Total_Amount")})
    suppliers = spark.createDataFrame([(1, "s", "c")], "SupplierID long, Name string, Contact_person string")
    pending = views.pending_purchase_orders(pos, suppliers)
    assert [r.PO_ID for r in pending.collect()] == [2]
    assert pending.columns == [
        "PO_ID", "Supplier", "Contact_person", "Order_date", "Exp_deleivey_date", "Total_Amount",
        "Status",
    ]


def test_order_summary_rows(spark):
    orders = spark.createDataFrame(
        [(n, 1, "d", 1, 1, 1, 1) for n in (1, 2, 3, 4)]
        + [(5, 9, "d", 1, 1, 1, 1), (6, 2, "d", 1, 1, 1, 1), (None, 1, "d", 1, 1, 1, 1)],
        ORDERS,
    )
    customers = spark.createDataFrame(
        [(1, "A", "B"), (2, "A", None)], "CustomerID long, First_Name string, Last_Name string"
    )
    payments = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (3, None), (99, 1), (None, 1)],
        "Order_ID long, Payment_Status int",
    )
    rows = views.order_summary(orders, customers, payments).collect()
    found = sorted((r.Order_ID or 0, r.Customer or "", r.PaymentStatus) for r in rows)
    assert found == [
        (0, "A B", "Unpaid"),
        (1, "A B", "Paid"),
        (1, "A B", "Unpaid"),
        (2, "A B", "Unpaid"),
        (3, "A B", "Unpaid"),
        (4, "A B", "Unpaid"),
        (6, "", "Unpaid"),
    ]


def test_recent_orders_agrees_with_the_summary(spark):
    orders = spark.createDataFrame(
        [(n, n % 3, f"2026-01-{n % 4 + 1:02d}", 1, 1, 1, 1) for n in range(40)], ORDERS
    )
    customers = spark.createDataFrame(
        [(1, "A", "B"), (2, "C", "D")], "CustomerID long, First_Name string, Last_Name string"
    )
    payments = spark.createDataFrame(
        [(n % 40, n % 2) for n in range(70)], "Order_ID long, Payment_Status int"
    )
    summary = views.order_summary(orders, customers, payments).collect()
    summary.sort(key=lambda r: r.PaymentStatus)
    summary.sort(key=lambda r: (r.Order_Date, r.Order_ID), reverse=True)
    assert lookups.recent_orders(orders, customers, payments, 7).collect() == summary[:7]


@pytest.mark.parametrize("empty", [True, False])
def test_salary_summary(spark, empty):
    rows = [] if empty else [(Decimal("1.50"),), (Decimal("2.00"),), (None,)]
    df = spark.createDataFrame(rows, "Salary decimal(12,2)")
    want = (0, None, None, None, None) if empty else (3, Decimal("3.50"), 1.75, Decimal("2.00"), Decimal("1.50"))
    assert tuple(views.salary_summary(df).first()) == want


def test_rider_without_deliveries_counts_zero(spark):
    riders = spark.createDataFrame(
        [(1, "A", "B", "bike"), (2, "C", None, "car")],
        "Rider_ID long, First_Name string, Last_Name string, Vehicle_Type string",
    )
    deliveries = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 0), (3, None, 1), (None, 1, 1)],
        "Delivery_ID long, Rider_ID long, Delivery_Status int",
    )
    rows = views.rider_performance(riders, deliveries).collect()
    assert {r.Rider_ID: (r.Rider, r.CompletedDeliveries) for r in rows} == {1: ("A B", 1), 2: (None, 0)}


def test_warranty_edges(spark):
    days = ["2026-03-31", "2026-04-01", "2026-04-30", "2026-05-01", None, "soon"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = [r[0] for r in df.select(warranty_status(F.col("d"), F.lit("2026-04-01").cast("date"))).collect()]
    assert got == ["Expired", "Expiring Soon", "Expiring Soon", "Valid", "Valid", "Valid"]


def test_labels(spark):
    df = spark.createDataFrame(
        [(7, "A — B", Decimal("12.50")), (8, None, Decimal(1))], "id long, name string, price decimal(8,2)"
    )
    first, second = df.select(
        label("id", "name").alias("l"), label("id", "name", "price").alias("p")
    ).collect()
    assert (first.l, first.p) == ("7 — A — B", "7 — A — B  (Rs. 12.50)")
    assert (second.l, second.p) == (None, None)
    assert df.select(label_id(label("id", "name"))).first()[0] == 7


def test_strip(spark):
    df = spark.createDataFrame([(" \t a b\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "", None]


def test_sorted_lookups(spark):
    df = spark.createDataFrame([(2, "b"), (3, "c"), (1, "a")], "Order_ID long, x string")
    assert [r[0] for r in lookups.order_ids_desc(df).collect()] == [3, 2, 1]
    named = df.select(F.col("Order_ID").alias("SupplierID"), F.col("x").alias("Name"))
    assert [r[0] for r in lookups.supplier_lookup(named).collect()] == [1, 2, 3]
