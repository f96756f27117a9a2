"""The tea house against results worked out by hand."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder import operators as op
from larder.operators.integrity import audit_references
from larder.plans import lookups, views
from larder.plans.naming import named_views, query, register_tables, register_views
from larder.sources import append, load_all
from larder.sources.catalog import TABLES
from tests import seed


@pytest.fixture(scope="module")
def raw(spark):
    return {name: df.cache() for name, df in seed.tea_house(spark).items()}


@pytest.fixture(scope="module")
def loaded(raw):
    """All rows appended to empty tables, so that every rule has acted."""
    empty = {name: df.where(F.lit(False)) for name, df in raw.items()}
    rows = {name: df.withColumn("seq", F.monotonically_increasing_id()) for name, df in raw.items()}
    after, refused = op.bulk_append(empty, rows, "2031-05-13 09:00:00")
    return {n: df.cache() for n, df in after.items()}, {n: df.cache() for n, df in refused.items()}


def pairs(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_refused_rows(raw, loaded):
    after, refused = loaded
    assert {n: df.count() for n, df in refused.items() if not df.isEmpty()} == {"Batches": 1, "Deliveries": 1, "Employees": 1}
    assert refused["Batches"].first().reason == "duplicate key"
    assert refused["Deliveries"].first().Delivery_ID == 103
    assert refused["Employees"].first().Employee_ID == 114
    assert sum(df.count() for df in after.values()) == sum(df.count() for df in raw.values()) - 3


def test_stock_after_receipts_and_orders(loaded):
    # 10 + 3 - 3 * 0.5 - 0.4; an unknown receipt; 6 + 2 - 3 * 0.25; an unknown stock.
    stock = pairs(loaded[0]["Ingredients"], "IngredientID", "Current_stock")
    assert stock == {1: Decimal("11.10"), 2: None, 3: Decimal("7.25"), 4: None}


def test_orders_after_load(loaded):
    orders = loaded[0]["Orders"]
    assert pairs(orders, "Order_ID", "Total_Amount") == {71: 7, 72: Decimal("7.75"), 73: 2}
    # The final total is that of the order as it came in.
    assert pairs(orders, "Order_ID", "Final_Total") == {71: Decimal("7.35"), 72: 4, 73: 2}


def test_dispatch_times(loaded):
    times = pairs(loaded[0]["Deliveries"], "Delivery_ID", "Dispatch_Time")
    assert times == {101: "2031-05-10 12:00:00", 102: "2031-05-13 09:00:00"}


def test_top_selling(raw):
    rows = views.top_selling_products(raw["Order_Details"], raw["Products"]).collect()
    assert {r.Product: (r.TotalSold, r.TotalRevenue) for r in rows} == {
        "Tea": (3, Decimal("10.5")), "Iced tea": (1, Decimal("4.25")), "Old blend": (1, 2),
    }


def test_view_sizes(raw):
    sizes = {n: df.count() for n, df in named_views(raw, "2031-06-01").items()}
    assert sizes == {
        "vw_CurrentStockLevels": 4,
        "vw_PendingPurchaseOrders": 1,
        "vw_ProductRecipeDetail": 5,
        "vw_ActiveProducts": 2,
        "vw_OrderSummary": 4,
        "vw_TopSellingProducts": 3,
        "vw_ActiveDeliveries": 2,
        "vw_RiderPerformance": 3,
        "vw_EquipmentStatusSummary": 3,
        "vw_SalarySummary": 1,
    }


def test_stock_status(raw, loaded):
    before = views.current_stock_levels(raw["Ingredients"], raw["Ingredient_Categories"])
    assert pairs(before, "Ingredient", "StockStatus") == {"Leaves": "OK", "Milk": "LOW", "Sugar": "LOW", "Ice": "OK"}
    after = views.current_stock_levels(loaded[0]["Ingredients"], raw["Ingredient_Categories"])
    assert pairs(after, "Ingredient", "StockStatus")["Sugar"] == "LOW"


def test_rider_performance(raw):
    done = views.rider_performance(raw["Delivery_Riders"], raw["Deliveries"])
    assert pairs(done, "Rider_ID", "CompletedDeliveries") == {1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize(
    ("as_of", "expected"),
    [
        ("2031-05-01", ["Expiring Soon", "Valid", "Valid"]),
        ("2031-05-30", ["Expiring Soon", "Expiring Soon", "Valid"]),
        ("2031-06-01", ["Expired", "Expiring Soon", "Valid"]),
        ("2033-01-02", ["Expired"] * 3),
    ],
)
def test_warranty(raw, as_of, expected):
    rows = views.equipment_status_summary(raw["Kitchen_Equipment"], as_of)
    assert [r.WarrantyStatus for r in rows.orderBy("Equipment_ID").collect()] == expected


def test_salary_summary(raw):
    assert tuple(views.salary_summary(raw["Employees"]).first()) == (4, 6000, 1500.0, 3000, 0)


def test_recent_orders(raw):
    rows = lookups.recent_orders(raw["Orders"], raw["customers"], raw["payments"]).collect()
    assert [r.Order_ID for r in rows] == [73, 72, 72, 71]
    assert sorted(r.PaymentStatus for r in rows) == ["Paid", "Paid", "Unpaid", "Unpaid"]


def test_feasibility_on_final_stock(spark, raw, loaded):
    requests = spark.createDataFrame([(32, 10), (33, 2), (31, 30), (99, 1)], "ProductID long, Quantity int")
    found = op.check_feasibility(requests, raw["Recipes"], loaded[0]["Ingredients"])
    needed = {(r.ProductID, r.Ingredient, r.RequiredQty): r.IsFeasible for r in found.collect()}
    assert needed == {
        (32, "Leaves", Decimal("4.00")): "Yes", (32, "Ice", Decimal("10.00")): "No", (33, "Milk", Decimal("4.00")): "No",
        (31, "Leaves", Decimal("15.00")): "No", (31, "Sugar", Decimal("7.50")): "No", (31, "Sugar", Decimal("270.00")): "No",
    }
    assert {r.ProductID: r.CanMake for r in op.feasibility_verdict(found).collect()} == {31: False, 32: False, 33: False}


def test_new_lines_change_stock_and_totals(spark, raw):
    cmds = spark.createDataFrame([(1, 73, 31, 4), (2, 73, 33, 1)], "seq long, Order_ID long, ProductID long, Quantity int")
    menu = views.active_products(raw["Products"], raw["Product_categories"])
    verdict = op.add_order_line(cmds, raw["Order_Details"], menu)
    assert [r.seq for r in verdict.rejected.collect()] == [2]
    stock, orders, lines = op.apply_order_lines(verdict, raw["Ingredients"], raw["Recipes"], raw["Orders"], raw["Order_Details"])
    assert pairs(stock, "IngredientID", "Current_stock") == {1: 8, 2: 8, 3: 5, 4: None}
    # The order's own line of 2 and four cups of tea.
    assert pairs(orders, "Order_ID", "Total_Amount") == {71: 7, 72: Decimal("4.25"), 73: 16}
    assert orders.schema == raw["Orders"].schema
    assert lines.agg(F.max("Order_Detail_ID")).first()[0] == 85


def test_next_id(raw):
    assert op.next_id(raw["Order_Details"], "Order_Detail_ID").first().NextID == 85


def test_rider_busy(spark, raw):
    new = spark.createDataFrame([(n, n) for n in range(1, 4)], "seq long, Rider_ID long")
    new = new.withColumn("Delivery_Status", F.lit(0))
    verdict = op.validate_rider(raw["Deliveries"], new)
    assert {r.Rider_ID for r in verdict.accepted.collect()} == {1, 3}


def test_integrity(raw):
    assert [tuple(r) for r in op.audit_keys(raw).collect()] == [("Batches", "22", 2)]
    assert audit_references(raw).isEmpty()
    for name, df in raw.items():
        found = {(r.column, r.value) for r in op.type_violations(df, TABLES[name].columns).collect()}
        assert found == ({("Amount_Paid", "7.35")} if name == "payments" else set())


def test_a_stored_shop_is_read_back(spark, raw, tmp_path):
    for name, df in raw.items():
        append(df, f"{tmp_path}/{name}")
    back = load_all(spark, str(tmp_path))
    assert {n: df.schema for n, df in back.items()} == {n: df.schema for n, df in raw.items()}
    assert views.salary_summary(back["Employees"]).first() == views.salary_summary(raw["Employees"]).first()


def test_sql_by_name(spark, raw):
    register_tables(raw)
    register_views(spark, raw, "2031-06-01")
    total = query(spark, "SELECT Total_Amount FROM Orders WHERE Order_ID = ?", [72])
    assert total.first().Total_Amount == Decimal("4.25")
    menu = query(spark, "SELECT ProductID FROM vw_ActiveProducts WHERE Base_Price > ?", [4])
    assert [r.ProductID for r in menu.collect()] == [32]
