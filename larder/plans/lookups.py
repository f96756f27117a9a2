"""The small reads behind selection lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import full_name
from larder.plans.views import order_summary


def customer_lookup(customers: DataFrame) -> DataFrame:
    return customers.select("CustomerID", full_name().alias("Name"))


def product_lookup(menu: DataFrame, with_price: bool = True) -> DataFrame:
    """Id and name of the products on the menu, with their price if wanted."""
    price = ["Base_Price"] if with_price else []
    return menu.select("ProductID", F.col("Product").alias("Name"), *price)


def order_ids_desc(orders: DataFrame) -> DataFrame:
    return orders.select("Order_ID").orderBy(F.desc("Order_ID"))


def supplier_lookup(suppliers: DataFrame) -> DataFrame:
    return suppliers.select("SupplierID", "Name").orderBy("SupplierID")


def ingredient_lookup(ingredients: DataFrame) -> DataFrame:
    return ingredients.select("IngredientID", "Name").orderBy("IngredientID")


def rider_lookup(riders: DataFrame) -> DataFrame:
    return riders.select("Rider_ID", full_name().alias("Name"))


def active_delivery_ids(deliveries: DataFrame) -> DataFrame:
    is_open = F.col("Delivery_Status") == 0
    return deliveries.where(is_open).select("Delivery_ID").orderBy("Delivery_ID")


def equipment_lookup(equipment: DataFrame) -> DataFrame:
    return equipment.select("Equipment_ID", "Equipment_Name").orderBy("Equipment_ID")


def order_total_point(orders: DataFrame, order_id: int) -> DataFrame:
    """The final total of one order; the filter reaches the scan."""
    return orders.where(F.col("Order_ID") == order_id).select("Final_Total")


def recent_orders(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, n: int = 10
) -> DataFrame:
    """The first ``n`` rows of the order summary, newest orders first.

    The higher id comes first among the orders of one day.  Each order gives
    at least one row, so the ``n`` newest orders are enough.  They are picked
    from the ids, dates and customers alone, and fetched by their ids: ``n``
    ids, which is what is broadcast.
    """
    newest = [F.desc("Order_Date"), F.desc("Order_ID")]
    keys = orders.select("Order_ID", "Order_Date", "CustomerID")
    known = keys.join(customers.select("CustomerID"), "CustomerID", "left_semi")
    ids = F.broadcast(known.orderBy(*newest).limit(n).select("Order_ID"))
    picked, ours = (df.join(ids, "Order_ID", "left_semi") for df in (orders, payments))
    rows = order_summary(picked, customers, ours)
    return rows.orderBy(*newest, F.asc("PaymentStatus")).limit(n)
