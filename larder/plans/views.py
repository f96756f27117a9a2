"""The ten reporting views, each a function of the tables it reads.

Dimensions are joined without hints: Catalyst broadcasts one whose size it
knows to be small, adaptive execution one that turns out to be, and a larger
one is sort-merged with hot keys split at run time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import as_date, full_name, lenient_int, warranty_status


def current_stock_levels(ingredients: DataFrame, categories: DataFrame) -> DataFrame:
    """Ingredients with category, ``LOW`` where the stock is below the reorder level."""
    low = F.col("Current_stock") < lenient_int(F.col("Reorder_level"))
    return ingredients.join(categories.select("CategoryID", "CategoryName"), "CategoryID").select(
        "IngredientID",
        F.col("Name").alias("Ingredient"),
        "CategoryName",
        "Current_stock",
        "Reorder_level",
        "unit_of_measure",
        F.when(low, "LOW").otherwise("OK").alias("StockStatus"),
    )


def pending_purchase_orders(purchase_orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Purchase orders not delivered yet, with their supplier."""
    names = suppliers.select("SupplierID", F.col("Name").alias("Supplier"), "Contact_person")
    return (
        purchase_orders.where(F.col("Status") != "Delivered")
        .join(names, "SupplierID")
        .select(
            "PO_ID",
            "Supplier",
            "Contact_person",
            "Order_date",
            "Exp_deleivey_date",
            "Total_Amount",
            "Status",
        )
    )


def _on_menu(products: DataFrame, product_categories: DataFrame) -> DataFrame:
    return products.where(F.col("is_active") == 1).join(
        product_categories.select("CategoryID", "Category_Name"), "CategoryID"
    )


def product_recipe_detail(
    recipes: DataFrame,
    products: DataFrame,
    product_categories: DataFrame,
    ingredients: DataFrame,
) -> DataFrame:
    """The bill of materials of active products, one row per recipe line."""
    menu = _on_menu(products, product_categories).select(
        "ProductID", F.col("Name").alias("Product"), "Category_Name", "Base_Price"
    )
    stock = ingredients.select(
        "IngredientID", F.col("Name").alias("Ingredient"), "unit_of_measure", "Current_stock"
    )
    return (
        recipes.join(menu, "ProductID")
        .join(stock, "IngredientID")
        .select(
            "ProductID",
            "Product",
            "Category_Name",
            "Base_Price",
            "Ingredient",
            "quantity_required",
            "unit_of_measure",
            "Current_stock",
        )
    )


def active_products(products: DataFrame, product_categories: DataFrame) -> DataFrame:
    """The menu: active products with their category."""
    return _on_menu(products, product_categories).select(
        "ProductID", F.col("Name").alias("Product"), "Category_Name", "Description", "Base_Price"
    )


def order_summary(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with customer and whether paid: one row per payment, one if there is none.

    This is the left join of orders with payments, written as its two halves.
    An inner join lets adaptive execution split an order with very many
    payments, which an outer join cannot do on that side; the orders without
    payments come from an anti join against the distinct order ids.  Both
    halves read one shuffle of the orders: null-safe equality keeps Catalyst
    from filtering one half and not the other, and the customers, who would be
    joined into each half, come after the union.
    """
    known = payments.where(F.col("Order_ID").isNotNull())
    paid = known.select(
        F.col("Order_ID").alias("_order"),
        F.when(F.col("Payment_Status") == 1, "Paid").otherwise("Unpaid").alias("PaymentStatus"),
    )
    same = F.col("Order_ID").eqNullSafe(F.col("_order"))
    without = orders.join(paid.select("_order").distinct(), same, "left_anti")
    rows = (
        orders.join(paid, same)
        .drop("_order")
        .unionByName(without.withColumn("PaymentStatus", F.lit("Unpaid")))
    )
    names = customers.select("CustomerID", full_name().alias("Customer"))
    return rows.join(names, "CustomerID").select(
        "Order_ID",
        "Customer",
        "Order_Date",
        "Total_Amount",
        "Tax_Amount",
        "Discount_Amount",
        "Final_Total",
        "PaymentStatus",
    )


def top_selling_products(order_lines: DataFrame, products: DataFrame) -> DataFrame:
    """Units and revenue per product that was sold; summed by id, then named."""
    sold = order_lines.groupBy("ProductID").agg(
        F.sum("Quantity").alias("TotalSold"), F.sum("Line_Total").alias("TotalRevenue")
    )
    names = products.select("ProductID", F.col("Name").alias("Product"))
    return sold.join(names, "ProductID").select("Product", "TotalSold", "TotalRevenue")


def active_deliveries(deliveries: DataFrame, riders: DataFrame, addresses: DataFrame) -> DataFrame:
    """Deliveries under way, with rider and address."""
    names = riders.select("Rider_ID", full_name().alias("Rider"), "Vehicle_Type")
    return (
        deliveries.where(F.col("Delivery_Status") == 0)
        .join(names, "Rider_ID")
        .join(addresses.select("AddressID", "Address_Line", "City"), "AddressID")
        .select(
            "Delivery_ID",
            "Order_ID",
            "Rider",
            "Vehicle_Type",
            "Address_Line",
            "City",
            "Dispatch_Time",
        )
    )


def rider_performance(riders: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Completed deliveries of every rider, zero included; counted by id, then named."""
    done = (
        deliveries.where(F.col("Delivery_Status") == 1)
        .groupBy("Rider_ID")
        .agg(F.count("Delivery_ID").alias("_done"))
    )
    return riders.join(done, "Rider_ID", "left").select(
        "Rider_ID",
        full_name().alias("Rider"),
        "Vehicle_Type",
        F.coalesce(F.col("_done"), F.lit(0)).alias("CompletedDeliveries"),
    )


def equipment_status_summary(
    equipment: DataFrame, as_of: Column | dt.date | str | None = None
) -> DataFrame:
    """Equipment with the state of its warranty on ``as_of``."""
    return equipment.select(
        "Equipment_ID",
        "Equipment_Name",
        "Status",
        "Purchase_Date",
        "Warranty_Expiry",
        warranty_status(F.col("Warranty_Expiry"), as_date(as_of)).alias("WarrantyStatus"),
    )


def salary_summary(employees: DataFrame) -> DataFrame:
    """Head count and payroll figures; one row even without employees."""
    salary = F.col("Salary")
    return employees.agg(
        F.count(F.lit(1)).alias("TotalEmployees"),
        F.sum(salary).alias("TotalMonthlyPayroll"),
        # From the exact sum, so that it does not depend on the order of addition.
        F.try_divide(F.sum(salary).cast("double"), F.count(salary)).alias("AverageSalary"),
        F.max(salary).alias("HighestSalary"),
        F.min(salary).alias("LowestSalary"),
    )
