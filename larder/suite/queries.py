"""One registered query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from larder import operators as op
from larder import streaming
from larder.functions import label, label_id
from larder.operators.commands import apply_equipment_status, receive_into_stock
from larder.operators.integrity import audit_references
from larder.operators.keyed import last_per_key
from larder.operators.ledger import MOVEMENT, net_movements
from larder.plans import lookups, views
from larder.plans.naming import query, register_views
from larder.session import fresh_dir
from larder.sources import TABLES, BatchLog, KeyTable, TieredLog, append, largest_key, load, load_quarantined, reject_counts
from larder.suite.tables import PO_STATUS, Bound, day, money

AS_OF = "1998-06-01"
NOW = "2026-04-01 10:00:00"

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(build: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
    """Register ``build`` under its own name."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Bound(spark, sf_dir))
    return build


def pairs(column: str) -> Column:
    """A key that two neighbouring ids share, so that keys repeat in a batch."""
    return F.col(column) - F.col(column) % 2


def decided(verdict: op.Verdict, *columns: str) -> DataFrame:
    return verdict.decided.select("seq", *columns, "reason")


def events(t: Bound) -> DataFrame:
    """All events, with their id as the sequence of commands."""
    return t.source("events").withColumn("seq", F.col("event_id"))


# --- tables: reading, appending, replacing -----------------------------------


@registered
def typed_scan(t: Bound) -> DataFrame:
    return load(
        t.spark,
        f"{t.dir}/lineitem.parquet",
        "Batches",
        columns={
            "BatchID": F.col("l_orderkey"),
            "IngredientID": F.col("l_suppkey"),
            "PO_ID": F.col("l_orderkey"),
            "Receive_date": F.col("l_shipdate"),
            "Quantity_Received": F.col("l_quantity"),
        },
    ).drop("Expiry_date", "Remaining_Quantity")


def numbered_lines(t: Bound) -> DataFrame:
    """All line items with an id in their total order."""
    lines = t.source("lineitem")
    return op.assign_ids(None, lines, "seq", lines.columns)


@registered
def bulk_append(t: Bound) -> DataFrame:
    lines = numbered_lines(t)
    received = lines.where(F.col("l_linestatus") == "F")
    rows = {
        "Batches": received.select(
            "seq",
            F.col("seq").alias("BatchID"),
            F.col("l_suppkey").alias("IngredientID"),
            F.col("l_orderkey").alias("PO_ID"),
            F.col("l_quantity").cast("int").alias("Quantity_Received"),
        ),
        "Order_Details": lines.select(
            "seq",
            F.col("seq").alias("Order_Detail_ID"),
            F.col("l_orderkey").alias("Order_ID"),
            F.col("l_partkey").alias("ProductID"),
            F.col("l_quantity").cast("int").alias("Quantity"),
            money("l_extendedprice").alias("Line_Total"),
        ),
    }
    state = {
        "Ingredients": t.ingredients,
        "Recipes": t.recipes,
        "Orders": t.orders,
        "Batches": rows["Batches"].drop("seq").where(F.lit(False)),
        "Order_Details": rows["Order_Details"].drop("seq").where(F.lit(False)),
    }
    after, _ = op.bulk_append(state, rows, NOW)
    stock = after["Ingredients"].select(
        F.lit("stock").alias("what"),
        F.col("IngredientID").alias("id"),
        F.col("Current_stock").cast("decimal(20,2)").alias("amount"),
    )
    totals = after["Orders"].select(
        F.lit("order").alias("what"),
        F.col("Order_ID").alias("id"),
        F.col("Total_Amount").cast("decimal(20,2)").alias("amount"),
    )
    return stock.unionByName(totals)


@registered
def bulk_append_rules(t: Bound) -> DataFrame:
    """What becomes of new staff and orders that repeat keys, with salaries of all kinds."""
    rows = {
        "Orders": t.orders.drop("Final_Total")
        .withColumn("seq", F.col("Order_ID"))
        .withColumn("Order_ID", F.col("Order_ID") - F.col("Order_ID") % 4)
        .withColumn("Final_Total", F.lit(None).cast("decimal(20,2)")),
        "Employees": t.source("customer").select(
            F.col("c_custkey").alias("seq"), pairs("c_custkey").alias("Employee_ID"), money("c_acctbal").alias("Salary")
        ),
    }
    empty = {name: new.drop("seq").where(F.lit(False)) for name, new in rows.items()}
    after, refused = op.bulk_append(empty, rows)
    parts = []
    for name, key, amount in (("Orders", "Order_ID", "Final_Total"), ("Employees", "Employee_ID", "Salary")):
        kept = after[name].withColumn("reason", F.lit(None).cast("string"))
        for part in (kept, refused[name]):
            parts.append(
                part.select(F.lit(name).alias("what"), F.col(key).alias("id"), F.col(amount).cast("decimal(20,2)").alias("amount"), "reason")
            )
    return reduce(DataFrame.unionByName, parts)


@registered
def bulk_append_deliveries(t: Bound) -> DataFrame:
    """New deliveries of riders who are free, busy or not known, with keys that are stored and dispatch times that miss."""
    every = t.source("events").select(
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("Delivery_ID"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("Rider_ID"),
        F.when(F.col("event_id") % 3 == 2, "noon").when(F.col("event_id") % 3 == 1, "").alias("Dispatch_Time"),
        F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).alias("Delivery_Status"),
    )
    is_stored = F.col("seq") % 10 == 0
    stored = every.where(is_stored).select(
        "Delivery_ID", "Rider_ID", F.lit("t").alias("Dispatch_Time"), F.when(F.col("Rider_ID") % 7 == 0, 0).otherwise(1).alias("Delivery_Status")
    )
    new = every.where(~is_stored | (F.col("seq") % 20 == 0))
    after, refused = op.bulk_append({"Deliveries": stored}, {"Deliveries": new}, NOW)
    kept = after["Deliveries"].withColumn("reason", F.lit(None).cast("string"))
    both = kept.unionByName(refused["Deliveries"].select(kept.columns))
    return both.select("Delivery_ID", "Rider_ID", "Dispatch_Time", "Delivery_Status", "reason")


@registered
def bulk_append_plain(t: Bound) -> DataFrame:
    """The tables without rules: every other row is stored, the others and some of the stored are appended."""
    names = [n for n in TABLES if n not in ("Batches", "Order_Details", "Orders", "Employees", "Deliveries")]
    state, rows = {}, {}
    for name in names:
        key = F.col(TABLES[name].key)
        # The categories of products have names for keys.
        number = F.length(key) if name == "Product_categories" else key
        state[name] = t[name].where(number % 2 == 0)
        rows[name] = t[name].where((number % 2 != 0) | (number % 10 == 0)).withColumn("seq", key)
    after, refused = op.bulk_append(state, rows)
    parts = []
    for name in names:
        kept = after[name].withColumn("reason", F.lit(None).cast("string"))
        parts += [p.select(F.lit(name).alias("what"), F.col(TABLES[name].key).cast("string").alias("id"), "reason") for p in (kept, refused[name])]
    return reduce(DataFrame.unionByName, parts)


@registered
def table_append(t: Bound) -> DataFrame:
    """Store the delivered purchase orders, append the others, read them back typed."""
    path = fresh_dir(t.spark, "append")
    is_done = F.col("Status") == PO_STATUS["F"]
    append(t.purchase_order.where(is_done), path)
    append(t.purchase_order.where(~is_done), path)
    return t.spark.read.parquet(path).select("PO_ID", "SupplierID", "Total_Amount", "Status")


@registered
def append_twice(t: Bound) -> DataFrame:
    """Two runs append each its half of the purchase orders; one of them is repeated."""
    path = fresh_dir(t.spark, "append")
    is_done = F.col("Status") == PO_STATUS["F"]
    for run, rows in (("done", is_done), ("open", ~is_done), ("done", is_done)):
        append(t.purchase_order.where(rows), path, batch=run)
    return t.spark.read.parquet(path).select("PO_ID", "SupplierID", "Total_Amount", "Status")


@registered
def quarantine(t: Bound) -> DataFrame:
    """The purchase orders as text in which every 50th line is broken: what is loaded, and why the rest is not."""
    path = fresh_dir(t.spark, "text")
    whole = t.purchase_order.withColumn("Total_Amount", F.floor("Total_Amount")).select([F.col(c).cast("string") for c in TABLES["Purchase_Order"].columns])
    lines = whole.withColumn("Total_Amount", F.when(F.col("PO_ID") % 50 == 0, "about ten").otherwise(F.col("Total_Amount")))
    lines.write.option("header", True).csv(path)
    good, rejected = load_quarantined(t.spark, path, "Purchase_Order")
    kept = good.select(F.lit("kept").alias("what"), F.col("PO_ID").cast("string").alias("detail"), F.lit(1).cast("long").alias("n"))
    refused = reject_counts(rejected).select(F.lit("refused").alias("what"), F.concat_ws(" ", "column", "rule").alias("detail"), "n")
    return kept.unionByName(refused)


@registered
def append_to_buckets(t: Bound) -> DataFrame:
    """The keyed append, with the stored keys in buckets."""
    new = events(t).select("seq", (F.col("user_id") * 40).alias("Order_ID"), day("ts").alias("Order_Date"))
    delivered = t.source("orders").where(F.col("o_orderstatus") == "F")
    keys = KeyTable(t.spark, fresh_dir(t.spark, "keys"), "Order_ID", buckets=16).add(delivered.select(F.col("o_orderkey").alias("Order_ID")))
    return decided(op.append_to_key_table(keys, new), "Order_ID", "Order_Date")


@registered
def next_id_from_footers(t: Bound) -> DataFrame:
    largest = largest_key(t.spark, f"{t.dir}/lineitem.parquet", "l_orderkey")
    return largest.select((F.coalesce("largest", F.lit(0)) + 1).cast("bigint").alias("NextID"))


@registered
def named_views(t: Bound) -> DataFrame:
    names = register_views(t.spark, t, AS_OF)
    counts = [f"SELECT '{n}' AS view_name, count(*) AS n FROM {n}" for n in names]
    return t.spark.sql(" UNION ALL ".join(counts))


@registered
def param_query(t: Bound) -> DataFrame:
    register_views(t.spark, t, AS_OF)
    return query(
        t.spark,
        "SELECT Order_ID, Customer, Order_Date, Final_Total FROM vw_OrderSummary"
        " WHERE Final_Total >= ? AND PaymentStatus = ?",
        [100000, "Paid"],
    )


@registered
def append_keyed(t: Bound) -> DataFrame:
    new = events(t).select(
        "seq", (F.col("user_id") * 40).alias("Order_ID"), day("ts").alias("Order_Date")
    )
    delivered = t.source("orders").where(F.col("o_orderstatus") == "F")
    stored = delivered.select(F.col("o_orderkey").alias("Order_ID"))
    return decided(op.append_keyed(stored, new, "Order_ID"), "Order_ID", "Order_Date")


def recipe_changes(t: Bound, rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("event_id").alias("seq"),
        pairs("event_id").alias("RecipeID"),
        F.col("user_id").alias("ProductID"),
        F.col("user_id").alias("IngredientID"),
        (money("value") / 10).cast("decimal(8,2)").alias("quantity_required"),
    )


@registered
def upsert_by_key(t: Bound) -> DataFrame:
    return op.upsert(t.recipes, recipe_changes(t, t.source("events")), "RecipeID")


def without_some_keys(t: Bound) -> DataFrame:
    keep = F.col("seq") % 50 != 0
    return recipe_changes(t, t.source("events")).withColumn("RecipeID", F.when(keep, F.col("RecipeID")))


@registered
def upsert_without_keys(t: Bound) -> DataFrame:
    return op.upsert(t.recipes, without_some_keys(t), "RecipeID")


@registered
def missing_keys(t: Bound) -> DataFrame:
    return op.missing_keys(without_some_keys(t), "RecipeID").select("seq", "ProductID", "reason")


@registered
def update_by_key(t: Bound) -> DataFrame:
    changes = events(t).select(
        "seq", (F.col("user_id") * 90).alias("Equipment_ID"), F.col("event_type").alias("Status")
    )
    return op.update_by_key(t.kitchen_equipment, changes, "Equipment_ID", ["Status"])


@registered
def next_id(t: Bound) -> DataFrame:
    return op.next_id(t.order_details, "Order_Detail_ID")


@registered
def assign_ids(t: Bound) -> DataFrame:
    lines = t.source("lineitem")
    ids = op.assign_ids(t.orders, lines, "Order_ID", lines.columns)
    return ids.select("Order_ID", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


# --- integrity ---------------------------------------------------------------


@registered
def pk_violations(t: Bound) -> DataFrame:
    return op.audit_keys(t)


@registered
def fk_violations(t: Bound) -> DataFrame:
    return audit_references(t)


@registered
def type_violations(t: Bound) -> DataFrame:
    found = [
        op.type_violations(t[name], TABLES[name].columns).select(
            F.lit(name).alias("table"), "column", "value", "rule"
        )
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, found)


# --- views -------------------------------------------------------------------


@registered
def current_stock_levels(t: Bound) -> DataFrame:
    return views.current_stock_levels(t.ingredients, t.ingredient_categories)


@registered
def pending_purchase_orders(t: Bound) -> DataFrame:
    return views.pending_purchase_orders(t.purchase_order, t.suppliers)


@registered
def product_recipe_detail(t: Bound) -> DataFrame:
    return views.product_recipe_detail(t.recipes, t.products, t.product_categories, t.ingredients)


@registered
def active_products(t: Bound) -> DataFrame:
    return views.active_products(t.products, t.product_categories)


@registered
def order_summary(t: Bound) -> DataFrame:
    return views.order_summary(t.orders, t.customers, t.payments)


@registered
def top_selling_products(t: Bound) -> DataFrame:
    return views.top_selling_products(t.order_details, t.products)


@registered
def active_deliveries(t: Bound) -> DataFrame:
    return views.active_deliveries(t.deliveries, t.delivery_riders, t.customer_addresses)


@registered
def rider_performance(t: Bound) -> DataFrame:
    return views.rider_performance(t.delivery_riders, t.deliveries)


@registered
def equipment_status_summary(t: Bound) -> DataFrame:
    return views.equipment_status_summary(t.kitchen_equipment, AS_OF)


@registered
def salary_summary(t: Bound) -> DataFrame:
    return views.salary_summary(t.employees)


# --- ledger and rules --------------------------------------------------------


@registered
def apply_batch_receipts(t: Bound) -> DataFrame:
    return op.apply_batch_receipts(t.ingredients, t.batches)


@registered
def deduct_ingredients(t: Bound) -> DataFrame:
    return op.deduct_ingredients(t.ingredients, t.recipes, t.order_details)


def quarters(df: DataFrame, column: str) -> DataFrame:
    """The same rows with a quarter of the quantity, so that most have a fraction."""
    return df.withColumn(column, (F.col(column) * F.lit(Decimal("0.25"))).cast("decimal(14,2)"))


@registered
def fractional_stock_after(t: Bound) -> DataFrame:
    received = op.apply_batch_receipts(t.ingredients, quarters(t.batches, "Quantity_Received"))
    after = op.deduct_ingredients(received, t.recipes, quarters(t.order_details, "Quantity"))
    return after.select("IngredientID", "Current_stock")


@registered
def order_final_total(t: Bound) -> DataFrame:
    final = op.order_final_total(t.orders.drop("Final_Total"))
    return final.withColumn("Final_Total", F.col("Final_Total").cast("decimal(20,2)"))


@registered
def rollup_order_total(t: Bound) -> DataFrame:
    after = op.rollup_order_total(t.orders, t.order_details, t.open_details)
    return after.withColumn("Total_Amount", F.col("Total_Amount").cast("decimal(22,2)"))


def new_deliveries(t: Bound) -> DataFrame:
    """Events that are no deliveries yet, as new ones; sign-ups are open."""
    other = t.source("events").where(~F.col("event_type").isin("click", "view"))
    return other.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("Delivery_ID"),
        (F.col("user_id") * 10).alias("Rider_ID"),
        F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("Delivery_Status"),
    )


@registered
def validate_rider(t: Bound) -> DataFrame:
    verdict = op.validate_rider(t.deliveries, new_deliveries(t))
    return decided(verdict, "Delivery_ID", "Rider_ID", "Delivery_Status")


@registered
def stamp_dispatch_time(t: Bound) -> DataFrame:
    kind = F.col("event_type")
    given = F.when(kind == "click", "").when(kind != "view", F.col("props"))
    new = t.source("events").select(
        F.col("event_id").alias("Delivery_ID"), given.alias("Dispatch_Time")
    )
    return op.stamp_dispatch_time(new, NOW)


@registered
def validate_salary(t: Bound) -> DataFrame:
    return op.validate_salary(t.employees).decided.select("Employee_ID", "Salary", "reason")


# --- commands ----------------------------------------------------------------


@registered
def place_purchase_order(t: Bound) -> DataFrame:
    cmds = events(t).select(
        "seq",
        pairs("event_id").alias("PO_ID"),
        F.col("user_id").alias("SupplierID"),
        day("ts").alias("Order_date"),
        money(F.col("value") * 100).alias("Total_Amount"),
    )
    stored = t.purchase_order.where(F.col("Status") == PO_STATUS["F"])
    verdict = op.place_purchase_order(cmds, stored, t.suppliers)
    return decided(verdict, *TABLES["Purchase_Order"].columns)


def batch_commands(t: Bound) -> DataFrame:
    return events(t).select(
        "seq",
        pairs("event_id").alias("BatchID"),
        F.col("user_id").alias("IngredientID"),
        (F.col("event_id") * 2).alias("PO_ID"),
        day("ts").alias("Receive_date"),
        F.floor("value").cast("int").alias("Quantity_Received"),
    )


@registered
def receive_batch(t: Bound) -> DataFrame:
    verdict = op.receive_batch(batch_commands(t), t.batches, t.ingredients, t.purchase_order)
    return decided(verdict, *TABLES["Batches"].columns)


@registered
def receive_into_stock_after(t: Bound) -> DataFrame:
    verdict = op.receive_batch(batch_commands(t), t.batches, t.ingredients, t.purchase_order)
    after = receive_into_stock(verdict, t.ingredients)
    return after.select("IngredientID", "Current_stock")


@registered
def add_recipe_ingredient(t: Bound) -> DataFrame:
    cmds = events(t).select(
        "seq",
        pairs("event_id").alias("RecipeID"),
        (F.col("user_id") * 14).alias("ProductID"),
        F.floor(F.col("value")).cast("bigint").alias("IngredientID"),
        (money("value") / 10).cast("decimal(8,2)").alias("quantity_required"),
    )
    verdict = op.add_recipe_ingredient(cmds, t.recipes, t.products, t.ingredients)
    return decided(verdict, *TABLES["Recipes"].columns)


def requests(t: Bound) -> DataFrame:
    return t.order_details.select("ProductID", "Quantity")


@registered
def check_feasibility(t: Bound) -> DataFrame:
    return op.check_feasibility(requests(t), t.recipes, t.ingredients).withColumn(
        "RequiredQty", F.col("RequiredQty").cast("decimal(20,2)")
    )


@registered
def feasibility_verdict(t: Bound) -> DataFrame:
    return op.feasibility_verdict(op.check_feasibility(requests(t), t.recipes, t.ingredients))


@registered
def place_order(t: Bound) -> DataFrame:
    cmds = events(t).select(
        "seq",
        (pairs("event_id") * 2).alias("Order_ID"),
        (F.col("user_id") * 11).alias("CustomerID"),
        day("ts").alias("Order_Date"),
        money("value").alias("Tax_Amount"),
        money(F.floor("value")).alias("Discount_Amount"),
    )
    verdict = op.place_order(cmds, t.orders, t.customers)
    rows = decided(verdict, *TABLES["Orders"].columns)
    return rows.withColumn("Final_Total", F.col("Final_Total").cast("decimal(20,2)"))


def line_commands(t: Bound) -> DataFrame:
    return events(t).select(
        "seq",
        F.col("event_id").alias("Order_ID"),
        (F.col("user_id") * 14).alias("ProductID"),
        (F.floor("value") + 1).cast("int").alias("Quantity"),
    )


@registered
def add_order_line(t: Bound) -> DataFrame:
    cmds = line_commands(t)
    menu = views.active_products(t.products, t.product_categories)
    rows = decided(
        op.add_order_line(cmds, t.order_details, menu), *TABLES["Order_Details"].columns
    )
    return rows.withColumn("Line_Total", F.col("Line_Total").cast("decimal(20,2)"))


@registered
def order_lines_after(t: Bound) -> DataFrame:
    """Stock and order totals after the new lines."""
    menu = views.active_products(t.products, t.product_categories)
    verdict = op.add_order_line(line_commands(t), t.order_details, menu)
    stock, orders, _ = op.apply_order_lines(verdict, t.ingredients, t.recipes, t.orders, t.order_details)
    return stock.select(
        F.lit("stock").alias("what"), F.col("IngredientID").alias("id"), F.col("Current_stock").cast("decimal(20,2)").alias("amount")
    ).unionByName(
        orders.select(F.lit("order").alias("what"), F.col("Order_ID").alias("id"), F.col("Total_Amount").cast("decimal(20,2)").alias("amount"))
    )


@registered
def process_payment(t: Bound) -> DataFrame:
    cmds = events(t).select(
        "seq",
        F.col("event_id").alias("Payment_ID"),
        (pairs("event_id") * 2).alias("Order_ID"),
        day("ts").alias("Payment_Date"),
        money(F.col("value") * 5000).alias("Amount_Paid"),
    )
    verdict = op.process_payment(cmds, t.payments, t.orders)
    return decided(verdict, *TABLES["payments"].columns)


@registered
def assign_delivery(t: Bound) -> DataFrame:
    cmds = events(t).select(
        "seq",
        F.col("event_id").alias("Delivery_ID"),
        (F.col("event_id") * 2).alias("Order_ID"),
        (F.floor("value") * 15).cast("bigint").alias("Rider_ID"),
        F.col("user_id").alias("AddressID"),
    )
    verdict = op.assign_delivery(cmds, t.deliveries, t.orders, t.delivery_riders, NOW)
    return decided(verdict, "Delivery_ID", "Order_ID", "Rider_ID", "Dispatch_Time")


@registered
def complete_delivery(t: Bound) -> DataFrame:
    bought = events(t).where(F.col("event_type") == "purchase")
    cmds = bought.select("seq", (F.col("event_id") + 1).alias("Delivery_ID"))
    return op.complete_delivery(cmds, t.deliveries, NOW)


def hires(customers: DataFrame) -> DataFrame:
    """Customers as new employees; some lack a last name."""
    segment = F.col("c_mktsegment")
    return customers.select(
        F.col("c_custkey").alias("seq"),
        pairs("c_custkey").alias("Employee_ID"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")).alias("First_Name"),
        F.when(segment == "MACHINERY", "   ").otherwise(segment).alias("Last_Name"),
        F.lit(" 0300 ").alias("Phone"),
        money("c_acctbal").alias("Salary"),
    )


def staff(t: Bound) -> DataFrame:
    return t.source("supplier").select(F.col("s_suppkey").alias("Employee_ID"))


@registered
def hire_employee(t: Bound) -> DataFrame:
    verdict = op.hire_employee(hires(t.source("customer")), staff(t), AS_OF)
    return decided(verdict, *TABLES["Employees"].columns)


def equipment_commands(t: Bound) -> DataFrame:
    letter = F.col("o_orderstatus")
    status = F.when(letter == "F", "Working").when(letter == "O", "Under Repair")
    return t.source("orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderkey") * 2).alias("Equipment_ID"),
        status.otherwise("Broken").alias("Status"),
    )


@registered
def update_equipment_status(t: Bound) -> DataFrame:
    return decided(op.update_equipment_status(equipment_commands(t)), "Equipment_ID", "Status")


@registered
def equipment_after_update(t: Bound) -> DataFrame:
    verdict = op.update_equipment_status(equipment_commands(t))
    return apply_equipment_status(verdict, t.kitchen_equipment)


# --- lookups -----------------------------------------------------------------


@registered
def customer_lookup(t: Bound) -> DataFrame:
    return lookups.customer_lookup(t.customers)


@registered
def product_lookup(t: Bound) -> DataFrame:
    return lookups.product_lookup(views.active_products(t.products, t.product_categories))


@registered
def product_lookup_names(t: Bound) -> DataFrame:
    menu = views.active_products(t.products, t.product_categories)
    return lookups.product_lookup(menu, with_price=False)


@registered
def order_ids_desc(t: Bound) -> DataFrame:
    return lookups.order_ids_desc(t.orders)


@registered
def supplier_lookup(t: Bound) -> DataFrame:
    return lookups.supplier_lookup(t.suppliers)


@registered
def ingredient_lookup(t: Bound) -> DataFrame:
    return lookups.ingredient_lookup(t.ingredients)


@registered
def rider_lookup(t: Bound) -> DataFrame:
    return lookups.rider_lookup(t.delivery_riders)


@registered
def active_delivery_ids(t: Bound) -> DataFrame:
    return lookups.active_delivery_ids(t.deliveries)


@registered
def equipment_lookup(t: Bound) -> DataFrame:
    return lookups.equipment_lookup(t.kitchen_equipment)


@registered
def order_total_point(t: Bound) -> DataFrame:
    return lookups.order_total_point(t.orders, 101)


@registered
def recent_orders(t: Bound) -> DataFrame:
    return lookups.recent_orders(t.orders, t.customers, t.payments)


@registered
def label_format(t: Bound) -> DataFrame:
    menu = lookups.product_lookup(views.active_products(t.products, t.product_categories))
    return menu.select(
        label("ProductID", "Name").alias("label"),
        label("ProductID", "Name", "Base_Price").alias("priced_label"),
    )


@registered
def label_parse(t: Bound) -> DataFrame:
    named = lookups.customer_lookup(t.customers).select(label("CustomerID", "Name").alias("label"))
    return named.select("label", label_id("label").alias("id"))


# --- streams -----------------------------------------------------------------


def log(t: Bound, name: str, schema) -> BatchLog:
    return BatchLog(t.spark, fresh_dir(t.spark, name), schema).create()


def tiered(t: Bound, name: str, schema, fold) -> TieredLog:
    return TieredLog(t.spark, fresh_dir(t.spark, name), schema, fold)


def checkpoint(t: Bound) -> str:
    return fresh_dir(t.spark, "stream")


@registered
def stream_stock_ledger(t: Bound) -> DataFrame:
    moves = tiered(t, "stock", MOVEMENT, net_movements)
    streaming.stream_stock_ledger(
        t.batches_of(t.stream("lineitem", "l_orderkey")),
        t.order_details_of(t.stream("lineitem", "l_orderkey")),
        lambda: t.recipes,
        moves,
        checkpoint(t),
    ).awaitTermination()
    return streaming.stock_now(t.ingredients, moves).select("IngredientID", "Current_stock")


@registered
def stream_order_totals(t: Bound) -> DataFrame:
    total = T.StructField("Total_Amount", T.DecimalType(22, 2))
    totals = tiered(t, "totals", T.StructType([T.StructField("Order_ID", T.LongType()), total]), streaming.total_sums)
    # Shipped lines are stored already, the others come in.
    opening, coming = (t.order_details_of(s.where(f"l_linestatus {is_it} 'F'")) for s, is_it in ((t.source("lineitem"), "="), (t.stream("lineitem", "l_orderkey"), "<>")))
    streaming.stream_order_totals(coming, totals, checkpoint(t)).awaitTermination()
    return streaming.current_totals(totals, opening)


def board_events(t: Bound) -> DataFrame:
    kind = F.col("event_type")
    return (
        t.stream("events", "event_id")
        .where(kind.isin("view", "click"))
        .select(
            F.col("event_id").alias("seq"),
            F.when(kind == "view", streaming.DISPATCH).otherwise(streaming.COMPLETION).alias("kind"),
            (F.col("user_id") * 2 + F.col("event_id") % 2).alias("Delivery_ID"),
            F.col("user_id").alias("Rider_ID"),
        )
    )


@registered
def stream_dispatch(t: Bound) -> DataFrame:
    decisions = log(t, "decisions", streaming.DECISION)
    riders = log(t, "riders", streaming.RIDER_STATE)
    streaming.stream_dispatch(board_events(t), decisions, riders, checkpoint(t)).awaitTermination()
    return decisions.read().drop("batch")


@registered
def stream_dispatch_keyed(t: Bound) -> DataFrame:
    decisions = log(t, "decisions", streaming.DECISION)
    streaming.stream_dispatch_keyed(board_events(t), decisions, checkpoint(t)).awaitTermination()
    return decisions.read().drop("batch")


@registered
def stream_validated_append(t: Bound) -> DataFrame:
    rows = t.stream("customer", "c_custkey").select(
        F.col("c_custkey").alias("seq"),
        pairs("c_custkey").alias("Employee_ID"),
        money("c_acctbal").alias("Salary"),
    )
    refused = rows.withColumn("reason", F.lit("")).schema
    accepted, rejected = log(t, "accepted", rows.schema), log(t, "rejected", refused)
    streaming.stream_validated_append(
        rows, lambda: staff(t), accepted, rejected, checkpoint(t)
    ).awaitTermination()
    kept = accepted.read().withColumn("reason", F.lit(None).cast("string"))
    return kept.unionByName(rejected.read()).drop("batch")


@registered
def stream_validated_append_keyed(t: Bound) -> DataFrame:
    rows = t.stream("customer", "c_custkey").select(
        F.col("c_custkey").alias("seq"),
        pairs("c_custkey").alias("Employee_ID"),
        money("c_acctbal").alias("Salary"),
    )
    refused = rows.withColumn("reason", F.lit("")).schema
    accepted, rejected = log(t, "accepted", rows.schema), log(t, "rejected", refused)
    streaming.stream_validated_append_keyed(rows, staff(t), accepted, rejected, checkpoint(t)).awaitTermination()
    kept = accepted.read().withColumn("reason", F.lit(None).cast("string"))
    return kept.unionByName(rejected.read()).drop("batch")


@registered
def stream_upsert(t: Bound) -> DataFrame:
    changes = recipe_changes(t, t.stream("events", "event_id"))
    newest = tiered(t, "recipes", t.recipes.schema, lambda rows: last_per_key(rows, "RecipeID", "batch"))
    streaming.stream_upsert(changes, newest, checkpoint(t), "RecipeID").awaitTermination()
    return streaming.current_rows(t.recipes, newest, "RecipeID")


@registered
def stream_fractional_stock(t: Bound) -> DataFrame:
    moves = log(t, "stock", MOVEMENT)
    streaming.stream_stock_ledger(
        quarters(t.batches_of(t.stream("lineitem", "l_orderkey")), "Quantity_Received"),
        quarters(t.order_details_of(t.stream("lineitem", "l_orderkey")), "Quantity"),
        lambda: t.recipes,
        moves,
        checkpoint(t),
    ).awaitTermination()
    return streaming.stock_now(t.ingredients, moves).select("IngredientID", "Current_stock")
