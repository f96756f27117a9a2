"""Validated commands: a batch of commands in, accepted and rejected rows out.

Commands carry a sequence column ``seq``, unique in the batch, that says which
came first.  Accepted rows have the columns of the table they are meant for,
next to ``seq``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import as_date, as_stamp, strip
from larder.operators.joining import attach, flag, within, without
from larder.operators.keyed import assign_ids, update_by_key
from larder.operators.ledger import (
    apply_batch_receipts,
    deduct_ingredients,
    order_final_total,
    rollup_order_total,
)
from larder.operators.rules import RIDER_BUSY, SALARY_NOT_POSITIVE, busy_riders
from larder.operators.turns import opened, settle
from larder.operators.verdict import (
    DUPLICATE_KEY,
    MISSING_KEY,
    REASON,
    Verdict,
    judge,
    reject_taken_keys,
)
from larder.session import stored
from larder.sources.catalog import TABLES

# The states a piece of equipment may be in, the defaults of a
# purchase order and of a received batch.
EQUIPMENT_STATES = ("Working", "Under Repair", "Not Working")
PO_STATUS, PO_DAYS, SHELF_DAYS = "Pending", 7, 180


def _shaped(rows: DataFrame, table: str, seq: str) -> DataFrame:
    """``seq``, the columns of ``table`` that are present, and the reason."""
    columns = [c for c in TABLES[table].columns if c in rows.columns]
    return rows.select(seq, *columns, REASON)


def _or_default(rows: DataFrame, column: str, default: Column) -> Column:
    return F.coalesce(F.col(column), default) if column in rows.columns else default


def place_purchase_order(
    cmds: DataFrame, purchase_orders: DataFrame, suppliers: DataFrame, seq: str = "seq"
) -> Verdict:
    """Add purchase orders; without a date they are due in a week, without a status pending."""
    rows = flag(cmds, "SupplierID", suppliers, "SupplierID", "_supplier")
    rows = judge(rows, (~F.col("_supplier"), "supplier not found"))
    due = _or_default(rows, "Exp_deleivey_date", F.date_add("Order_date", PO_DAYS))
    status = _or_default(rows, "Status", F.lit(PO_STATUS))
    rows = rows.withColumns({"Exp_deleivey_date": due, "Status": status})
    shaped = _shaped(rows, "Purchase_Order", seq)
    return Verdict(reject_taken_keys(shaped, purchase_orders, "PO_ID", seq, dear=True))


def receive_batch(
    cmds: DataFrame,
    batches: DataFrame,
    ingredients: DataFrame,
    purchase_orders: DataFrame,
    seq: str = "seq",
) -> Verdict:
    """Add received batches, of which all is still left; a missing reference may be NULL."""
    rows = flag(cmds, "IngredientID", ingredients, "IngredientID", "_ingredient")
    rows = flag(rows, "PO_ID", purchase_orders, "PO_ID", "_order")
    rows = judge(
        rows,
        (F.col("IngredientID").isNotNull() & ~F.col("_ingredient"), "ingredient not found"),
        (F.col("PO_ID").isNotNull() & ~F.col("_order"), "purchase order not found"),
    )
    rows = rows.withColumns(
        {
            "Expiry_date": _or_default(rows, "Expiry_date", F.date_add("Receive_date", SHELF_DAYS)),
            "Remaining_Quantity": F.col("Quantity_Received"),
        }
    )
    return Verdict(reject_taken_keys(_shaped(rows, "Batches", seq), batches, "BatchID", seq, dear=True))


def receive_into_stock(verdict: Verdict, ingredients: DataFrame) -> DataFrame:
    """Stock after the accepted batches."""
    return apply_batch_receipts(ingredients, verdict.accepted)


def add_recipe_ingredient(
    cmds: DataFrame,
    recipes: DataFrame,
    products: DataFrame,
    ingredients: DataFrame,
    seq: str = "seq",
) -> Verdict:
    """Add recipe lines for known products and ingredients."""
    rows = flag(cmds, "ProductID", products, "ProductID", "_product")
    rows = flag(rows, "IngredientID", ingredients, "IngredientID", "_ingredient")
    rows = judge(
        rows,
        (~F.col("_product"), "product not found"),
        (~F.col("_ingredient"), "ingredient not found"),
    )
    return Verdict(reject_taken_keys(_shaped(rows, "Recipes", seq), recipes, "RecipeID", seq, dear=True))


def place_order(
    cmds: DataFrame, orders: DataFrame, customers: DataFrame, seq: str = "seq"
) -> Verdict:
    """Add order headers; their total is zero until lines come in."""
    rows = flag(cmds, "CustomerID", customers, "CustomerID", "_customer")
    rows = judge(rows, (~F.col("_customer"), "customer not found"))
    rows = rows.withColumn("Total_Amount", F.lit(0).cast("decimal(8,2)"))
    shaped = _shaped(order_final_total(rows), "Orders", seq)
    return Verdict(reject_taken_keys(shaped, orders, "Order_ID", seq, dear=True))


def add_order_line(cmds: DataFrame, lines: DataFrame, menu: DataFrame, seq: str = "seq") -> Verdict:
    """Price order lines from the menu; accepted ones get ids after the largest stored."""
    prices = menu.select("ProductID", F.col("Base_Price").alias("Unit_Price"))
    prices = prices.withColumn("_offered", F.lit(True))
    rows = attach(cmds, prices, "ProductID")
    rows = judge(rows, (F.col("_offered").isNull(), "product not on the menu"))
    rows = rows.withColumn("Line_Total", F.col("Unit_Price") * F.col("Quantity"))
    # Read for the ids, for the refused and with the result.
    shaped = stored(_shaped(rows, "Order_Details", seq), "priced")
    offered = assign_ids(lines, shaped.where(F.col(REASON).isNull()), "Order_Detail_ID", [seq])
    refused = shaped.where(F.col(REASON).isNotNull())
    return Verdict(offered.unionByName(refused, allowMissingColumns=True))


def apply_order_lines(
    verdict: Verdict, ingredients: DataFrame, recipes: DataFrame, orders: DataFrame, lines: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ingredients, orders and lines after the accepted lines of ``add_order_line``.

    The lines are stored once: their ids, the stock they use and the totals
    they change all come from the same rows.
    """
    new = stored(verdict.accepted.select(lines.columns), "order-lines")
    all_lines = lines.unionByName(new)
    return (
        deduct_ingredients(ingredients, recipes, new),
        rollup_order_total(orders, all_lines, new),
        all_lines,
    )


def process_payment(
    cmds: DataFrame, payments: DataFrame, orders: DataFrame, seq: str = "seq"
) -> Verdict:
    """Add payments; each must cover the final total of its order."""
    due = orders.select("Order_ID", F.col("Final_Total").alias("_due"))
    due = due.where(F.col("Order_ID").isNotNull()).withColumn("_order", F.lit(True))
    rows = judge(
        attach(cmds, due, "Order_ID"),
        (F.col("_order").isNull(), "order not found"),
        (F.col("Amount_Paid") < F.col("_due"), "underpayment"),
    )
    rows = rows.withColumn("Payment_Status", F.lit(1))
    return Verdict(reject_taken_keys(_shaped(rows, "payments", seq), payments, "Payment_ID", seq, dear=True))


def assign_delivery(
    cmds: DataFrame,
    deliveries: DataFrame,
    orders: DataFrame,
    riders: DataFrame,
    now: Column | dt.datetime | str | None = None,
    seq: str = "seq",
) -> Verdict:
    """Dispatch deliveries of known orders by known, free riders.

    An accepted command takes both its rider and its key from all later ones,
    a refused one takes neither.  See :func:`settle` for how that order of
    events is followed without walking through the commands one by one.
    """
    ordered = flag(cmds, "Order_ID", orders, "Order_ID", "_order")
    known = riders.select("Rider_ID").where(F.col("Rider_ID").isNotNull())
    busy = busy_riders(deliveries)
    free = known.join(busy, "Rider_ID", "left_anti")
    bids = (
        ordered.where(F.col("_order"))
        .where(F.col("Delivery_ID").isNotNull())
        .select(seq, "Rider_ID", "Delivery_ID", F.lit(True).alias("opens"))
    )
    bids = without(within(bids, free, "Rider_ID"), deliveries, "Delivery_ID")
    taken = opened(settle(bids, seq), seq)
    # All that is known of a rider in one row, so that the commands meet it in one join.
    facts = (
        known.withColumn("_rider", F.lit(True))
        .join(busy.withColumn("_busy", F.lit(True)), "Rider_ID", "left")
        .join(taken, "Rider_ID", "left")
    )
    rows = judge(
        attach(ordered, facts, "Rider_ID"),
        (~F.col("_order"), "order not found"),
        (F.col("_rider").isNull(), "rider not found"),
        (F.col("_busy") | (F.col(seq) > F.col("_from")), RIDER_BUSY),
        (F.col("Delivery_ID").isNull(), MISSING_KEY),
        (F.col("_from").isNull() | (F.col(seq) < F.col("_from")), DUPLICATE_KEY),
    )
    rows = rows.withColumns(
        {
            "Dispatch_Time": as_stamp(now),
            "Delivery_Time": F.lit(None).cast("string"),
            "Delivery_Status": F.lit(0),
        }
    )
    return Verdict(_shaped(rows, "Deliveries", seq))


def complete_delivery(
    cmds: DataFrame,
    deliveries: DataFrame,
    now: Column | dt.datetime | str | None = None,
    seq: str = "seq",
) -> DataFrame:
    """Close the named deliveries; ids that do not occur change nothing."""
    done = cmds.select("Delivery_ID", seq).withColumns(
        {"Delivery_Status": F.lit(1), "Delivery_Time": as_stamp(now)}
    )
    return update_by_key(deliveries, done, "Delivery_ID", ["Delivery_Time", "Delivery_Status"], seq)


def hire_employee(
    cmds: DataFrame,
    employees: DataFrame,
    as_of: Column | dt.date | str | None = None,
    seq: str = "seq",
) -> Verdict:
    """Add employees, hired on ``as_of``; names and phone lose surrounding blanks."""
    rows = cmds.withColumns({c: strip(F.col(c)) for c in ("First_Name", "Last_Name", "Phone")})
    rows = judge(
        rows.withColumn("Hire_Date", as_date(as_of)),
        (F.coalesce(F.col("First_Name"), F.lit("")) == "", "blank first name"),
        (F.coalesce(F.col("Last_Name"), F.lit("")) == "", "blank last name"),
        (F.col("Salary") <= 0, SALARY_NOT_POSITIVE),
    )
    return Verdict(reject_taken_keys(_shaped(rows, "Employees", seq), employees, "Employee_ID", seq))


def update_equipment_status(cmds: DataFrame) -> Verdict:
    """Refuse unknown states; NULL passes."""
    unknown = ~F.col("Status").isin(*EQUIPMENT_STATES)
    return Verdict(judge(cmds, (unknown, "unknown status")))


def apply_equipment_status(verdict: Verdict, equipment: DataFrame, seq: str = "seq") -> DataFrame:
    """Equipment after the accepted changes; ids that do not occur change nothing."""
    return update_by_key(equipment, verdict.accepted, "Equipment_ID", ["Status"], seq)
