"""Whether the stock allows a requested quantity of a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_feasibility(requests: DataFrame, recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Per request and recipe line: needed, in stock, and ``Yes`` or ``No``.

    Recipes meet the stock first, so that the requests are shuffled once and
    before each of them becomes several rows.
    """
    needed = F.col("quantity_required") * F.col("Quantity")
    stock = F.col("Current_stock")
    stocked = recipes.select("ProductID", "IngredientID", "quantity_required").join(
        ingredients.select("IngredientID", "Name", "Current_stock"), "IngredientID"
    )
    return requests.join(stocked, "ProductID").select(
        "ProductID",
        "Quantity",
        F.col("Name").alias("Ingredient"),
        needed.alias("RequiredQty"),
        stock.alias("CurrentStock"),
        F.when(stock >= needed, "Yes").otherwise("No").alias("IsFeasible"),
    )


def feasibility_verdict(feasibility: DataFrame) -> DataFrame:
    """Whether every line of a request is feasible; no recipe, no row.

    Grouping by the request as one value keeps the partitioning of the join
    below from serving for the grouping as well; it would hold the join back
    from splitting a product that very many requests are for.
    """
    request = F.struct("ProductID", "Quantity").alias("_request")
    makes = F.bool_and(F.col("IsFeasible") == "Yes").alias("CanMake")
    return feasibility.groupBy(request).agg(makes).select("_request.*", "CanMake")
