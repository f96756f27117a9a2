"""The stock ledger and the order totals: state plus new rows gives new state.

Sums are taken per key before any join, so that many receipts or lines of one
ingredient, product or order combine on the map side.  ``sum`` skips NULL,
whereas adding NULL to a stock makes it NULL for good; each sum therefore
carries a flag that tells whether a NULL was among its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOCK = T.DecimalType(20, 2)
# Quantities that come as floating point; their sums stay exact.
QUANTITY = T.DecimalType(20, 4)
# Movements are not rounded before they meet the stock: a stream has many.
DELTA = T.DecimalType(30, 6)

# One movement: an ingredient, a signed amount, and whether it is unknown.
MOVEMENT = T.StructType(
    [
        T.StructField("IngredientID", T.LongType()),
        T.StructField("delta", DELTA),
        T.StructField("unknown", T.BooleanType()),
    ]
)


def exact(quantities: DataFrame, column: str) -> Column:
    """A quantity that can be summed without loss: decimals and integers as they are."""
    held = quantities.schema[column].dataType
    kept = isinstance(held, (T.DecimalType, T.IntegralType))
    return F.col(column) if kept else F.col(column).cast(QUANTITY)


def receipt_movements(new_batches: DataFrame) -> DataFrame:
    """The receipts as one movement per ingredient."""
    quantity = exact(new_batches, "Quantity_Received")
    return (
        new_batches.where(F.col("IngredientID").isNotNull())
        .groupBy("IngredientID")
        .agg(
            F.sum(quantity).cast(DELTA).alias("delta"),
            F.bool_or(quantity.isNull()).alias("unknown"),
        )
    )


def sold_quantities(new_lines: DataFrame) -> DataFrame:
    """Units ordered per product, and whether one of the quantities was NULL."""
    return (
        new_lines.where(F.col("ProductID").isNotNull())
        .groupBy("ProductID")
        .agg(
            F.sum(exact(new_lines, "Quantity")).alias("sold"),
            F.bool_or(F.col("Quantity").isNull()).alias("sold_unknown"),
        )
    )


def usage_movements(recipes: DataFrame, sold: DataFrame) -> DataFrame:
    """What the sold quantities use up, through the recipes, one movement per ingredient.

    Each recipe meets a product once, with the sum of its order lines.  Of
    several recipe lines for one product and ingredient the one with the
    smallest RecipeID counts.  Sold quantities keep their fractions.
    """
    lines = recipes.groupBy("ProductID", "IngredientID").agg(
        F.min_by("quantity_required", "RecipeID").alias("_need")
    )
    whole = isinstance(sold.schema["sold"].dataType, T.IntegralType)
    used = F.col("_need") * (F.col("sold").cast("decimal(18,0)") if whole else F.col("sold"))
    return (
        sold.join(lines, "ProductID")
        .where(F.col("IngredientID").isNotNull())
        .groupBy("IngredientID")
        .agg(
            (-F.sum(used)).cast(DELTA).alias("delta"),
            F.bool_or(F.col("sold_unknown") | F.col("_need").isNull()).alias("unknown"),
        )
    )


def net_movements(movements: DataFrame) -> DataFrame:
    """At most two movements per ingredient: what came in and what went out, unrounded."""
    out = F.coalesce(F.col("delta") < 0, F.lit(False)).alias("_out")
    return (
        movements.groupBy("IngredientID", out)
        .agg(F.sum("delta").cast(DELTA).alias("delta"), F.bool_or("unknown").alias("unknown"))
        .drop("_out")
    )


def apply_movements(ingredients: DataFrame, movements: DataFrame) -> DataFrame:
    """Stock after the movements; ingredients without any keep theirs.

    What came in and what went out are each rounded once, in all, so that the
    stock does not depend on how many movements they came as.
    """
    came = F.sum(F.when(F.col("delta") >= 0, F.col("delta"))).cast(STOCK)
    went = F.sum(F.when(F.col("delta") < 0, F.col("delta"))).cast(STOCK)
    net = movements.groupBy("IngredientID").agg(
        F.coalesce(came + went, came, went).alias("delta"), F.bool_or("unknown").alias("unknown")
    )
    stock = F.col("Current_stock")
    after = (
        F.when(F.col("unknown").isNull(), stock)
        .when(~F.col("unknown"), stock + F.col("delta"))
        .cast(STOCK)
    )
    joined = ingredients.join(net, "IngredientID", "left")
    return joined.withColumn("Current_stock", after).select(ingredients.columns)


def apply_batch_receipts(ingredients: DataFrame, new_batches: DataFrame) -> DataFrame:
    """Add what was received to the stock."""
    return apply_movements(ingredients, receipt_movements(new_batches))


def deduct_ingredients(ingredients: DataFrame, recipes: DataFrame, new_lines: DataFrame) -> DataFrame:
    """Take off the stock what the ordered products need; it may go below zero."""
    return apply_movements(ingredients, usage_movements(recipes, sold_quantities(new_lines)))


def order_final_total(new_orders: DataFrame) -> DataFrame:
    """Final total of new orders: total plus tax less discount."""
    final = F.col("Total_Amount") + F.col("Tax_Amount") - F.col("Discount_Amount")
    return new_orders.withColumn("Final_Total", final)


def rollup_order_total(orders: DataFrame, all_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    """Total of all lines, for each order that got a new line; others keep theirs.

    The total has the type that ``orders`` gives it; one that doesn't fit is an
    error, as the cast is checked.

    The lines are summed before they meet the touched orders, so a long order
    is combined on the map side; where few orders are touched, Catalyst moves
    the semi join below the sum.  Final_Total is not refreshed.
    """
    touched = new_lines.select("Order_ID").where(F.col("Order_ID").isNotNull()).distinct()
    totals = all_lines.groupBy("Order_ID").agg(F.sum("Line_Total").alias("_total"))
    fresh = totals.join(touched, "Order_ID", "left_semi").withColumn("_fresh", F.lit(True))
    total = F.when(F.col("_fresh"), F.col("_total")).otherwise(F.col("Total_Amount"))
    total = total.cast(orders.schema["Total_Amount"].dataType)
    joined = orders.join(fresh, "Order_ID", "left")
    return joined.withColumn("Total_Amount", total).select(orders.columns)
