"""Tables and views under their names, and parameterised SQL over them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from larder.plans import views


def named_views(
    tables: Mapping[str, DataFrame], as_of: Column | dt.date | str | None = None
) -> dict[str, DataFrame]:
    """The ten views under the names they are read by."""
    t = tables
    # The view names.
    return {
        "vw_CurrentStockLevels": views.current_stock_levels(
            t["Ingredients"], t["Ingredient_Categories"]
        ),
        "vw_PendingPurchaseOrders": views.pending_purchase_orders(
            t["Purchase_Order"], t["Suppliers"]
        ),
        "vw_ProductRecipeDetail": views.product_recipe_detail(
            t["Recipes"], t["Products"], t["Product_categories"], t["Ingredients"]
        ),
        "vw_ActiveProducts": views.active_products(t["Products"], t["Product_categories"]),
        "vw_OrderSummary": views.order_summary(t["Orders"], t["customers"], t["payments"]),
        "vw_TopSellingProducts": views.top_selling_products(t["Order_Details"], t["Products"]),
        "vw_ActiveDeliveries": views.active_deliveries(
            t["Deliveries"], t["Delivery_Riders"], t["Customer_Addresses"]
        ),
        "vw_RiderPerformance": views.rider_performance(t["Delivery_Riders"], t["Deliveries"]),
        "vw_EquipmentStatusSummary": views.equipment_status_summary(t["Kitchen_Equipment"], as_of),
        "vw_SalarySummary": views.salary_summary(t["Employees"]),
    }


def register_views(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    as_of: Column | dt.date | str | None = None,
) -> list[str]:
    """Make the views readable by name from SQL; returns the names."""
    found = named_views(tables, as_of)
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return list(found)


def register_tables(tables: Mapping[str, DataFrame]) -> list[str]:
    """Make the tables readable by name from SQL; returns the names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def query(spark: SparkSession, sql: str, params: Sequence[Any] = ()) -> DataFrame:
    """SQL text with positional ``?`` parameters."""
    return spark.sql(sql, args=list(params))
