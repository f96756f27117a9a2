"""What holds for any rows, on the smallest benchmark tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larder import operators as op
from larder.plans import views
from larder.suite import queries as q
from larder.suite.tables import Bound


@pytest.fixture(scope="module")
def t(spark):
    return Bound(spark, "/root/testdata/sf0.001")


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_stock_is_conserved(t):
    start = total(t.ingredients, "Current_stock")
    received = total(t.batches, "Quantity_Received")
    lines = t.order_details.join(t.recipes, "ProductID")
    used = total(lines, F.col("Quantity") * F.col("quantity_required"))
    after = op.apply_batch_receipts(t.ingredients, t.batches)
    after = op.deduct_ingredients(after, t.recipes, t.order_details)
    assert total(after, "Current_stock") == start + received - used


def test_revenue_is_complete(t):
    sales = views.top_selling_products(t.order_details, t.products)
    assert total(sales, "TotalRevenue") == total(t.order_details, "Line_Total")


def test_completed_deliveries_are_complete(t):
    done = t.deliveries.where("Delivery_Status = 1").join(t.delivery_riders, "Rider_ID")
    performance = views.rider_performance(t.delivery_riders, t.deliveries)
    assert total(performance, "CompletedDeliveries") == done.count()
    assert performance.count() == t.delivery_riders.count()


def test_order_summary_has_a_row_per_payment_or_order(t):
    paid = t.payments.groupBy("Order_ID").count()
    want = total(
        t.orders.join(paid, "Order_ID", "left"), F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))
    )
    assert views.order_summary(t.orders, t.customers, t.payments).count() == want


def test_upsert_keeps_keys_unique(t):
    after = op.upsert(t.recipes, q.recipe_changes(t, t.source("events")), "RecipeID")
    assert op.pk_violations(after, "RecipeID").isEmpty()


def test_receipts_commute_with_orders(t):
    one = op.deduct_ingredients(t.ingredients, t.recipes, t.order_details)
    one = op.apply_batch_receipts(one, t.batches)
    two = op.apply_batch_receipts(t.ingredients, t.batches)
    two = op.deduct_ingredients(two, t.recipes, t.order_details)
    assert one.exceptAll(two).isEmpty()


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("place_purchase_order", "PO_ID"),
        ("receive_batch", "BatchID"),
        ("add_recipe_ingredient", "RecipeID"),
        ("place_order", "Order_ID"),
        ("process_payment", "Payment_ID"),
        ("assign_delivery", "Delivery_ID"),
    ],
)
def test_each_command_is_decided_once(t, name, key):
    decided = q.REGISTRY[name](t.spark, t.dir).cache()
    assert decided.count() == t.source("events").count()
    assert decided.select("seq").distinct().count() == decided.count()
    assert op.pk_violations(decided.where("reason IS NULL"), key).isEmpty()
