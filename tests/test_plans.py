"""The plans hold for large and for lopsided data."""

from __future__ import annotations

import inspect
import re

import pytest
from pyspark.sql import functions as F

from larder import operators as op
from larder.plans import lookups, views
from larder.suite.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
ROWS = 90_000


def plan_of(df) -> str:
    """The plan as it was executed."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def large(conf):
    """Nothing is small enough to broadcast."""
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")


@pytest.fixture
def splitting(conf, large):
    """Partitions count as skewed at test size."""
    conf(
        adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="1KB",
        adaptive__coalescePartitions__enabled="false",
        shuffle__partitions="16",
    )


def hot():
    """A key that a third of the rows have."""
    return F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).cast("bigint")


@pytest.fixture
def rows(spark):
    """Many rows with a column that does not compress."""
    return spark.range(ROWS).repartition(8).withColumn("seq", F.xxhash64("id"))


@pytest.fixture
def keys(spark):
    return spark.range(1000)


def renamed(keys, name, **more):
    return keys.select(F.col("id").alias(name), *[v.alias(k) for k, v in more.items()])


def orders_of(keys):
    names = ("Order_Date", "Total_Amount", "Tax_Amount", "Discount_Amount", "Final_Total")
    return renamed(keys, "Order_ID", CustomerID=F.col("id") % 50, **{n: F.lit(1) for n in names})


def test_an_order_with_very_many_payments_is_split(rows, keys, splitting):
    customers = renamed(keys, "CustomerID", First_Name=F.lit("a"), Last_Name=F.lit("b"))
    payments = rows.select(
        hot().alias("Order_ID"), (F.col("seq") % 2).cast("int").alias("Payment_Status")
    )
    df = views.order_summary(orders_of(keys), customers, payments)
    assert df.count() == ROWS
    assert "skew=true" in plan_of(df)


def test_a_rider_in_a_third_of_the_rows_is_split(rows, keys, splitting):
    deliveries = renamed(keys, "Delivery_ID", Rider_ID=F.col("id") % 100, Delivery_Status=F.lit(1))
    new = rows.select("seq", hot().alias("Rider_ID"), F.lit(0).alias("Delivery_Status"))
    verdict = op.validate_rider(deliveries, new)
    assert verdict.accepted.count() == 1000
    assert "skew=true" in plan_of(verdict.decided)


def test_assigning_one_rider_a_third_of_the_time_is_split(rows, keys, splitting):
    cmds = rows.select(
        "seq",
        F.col("id").alias("Delivery_ID"),
        (F.col("id") % 1000).alias("Order_ID"),
        hot().alias("Rider_ID"),
        F.lit(1).alias("AddressID"),
    )
    deliveries = renamed(keys, "Delivery_ID", Rider_ID=F.col("id") % 100, Delivery_Status=F.lit(1))
    verdict = op.assign_delivery(
        cmds, deliveries.where("Delivery_ID < 0"), orders_of(keys), renamed(keys, "Rider_ID")
    )
    assert verdict.accepted.count() == 1000
    assert "skew=true" in plan_of(verdict.decided)


def test_a_parent_of_a_third_of_the_commands_is_split(rows, keys, splitting):
    cmds = rows.select(
        "seq",
        F.col("id").alias("PO_ID"),
        hot().alias("SupplierID"),
        F.current_date().alias("Order_date"),
        F.lit(1).alias("Total_Amount"),
    )
    stored = renamed(keys, "PO_ID").where("PO_ID < 5")
    verdict = op.place_purchase_order(cmds, stored, renamed(keys, "SupplierID"))
    assert verdict.rejected.count() == 5
    assert "skew=true" in plan_of(verdict.decided)


def test_a_key_of_a_third_of_the_commands_is_spread(rows, keys, large):
    """The join is on key and sequence, so the key does not meet in one task."""
    cmds = rows.select("seq", hot().alias("id"))
    df = op.append_keyed(keys.where("id < 5"), cmds, "id").decided
    assert df.where("reason IS NULL").count() == 995
    plan = plan_of(df)
    assert re.search(r"Exchange hashpartitioning\(id#\d+L, seq#\d+L", plan)
    assert "Window" not in plan


def test_dangling_references_of_one_parent_are_split(rows, keys, splitting):
    child = rows.select("seq", hot().alias("ref"))
    df = op.fk_violations(child, "ref", keys.where("id <> 7"), "id")
    assert df.count() > ROWS / 3
    assert "skew=true" in plan_of(df)


def test_a_product_of_a_third_of_the_requests_is_split(rows, keys, splitting):
    product = F.col("id") % 1000
    recipes = keys.select(
        F.col("id").alias("RecipeID"),
        product.alias("ProductID"),
        (F.col("id") % 990).alias("IngredientID"),
        F.lit(1).alias("quantity_required"),
    )
    stock = renamed(keys, "IngredientID", Name=F.lit("x"), Current_stock=F.col("id") % 7)
    wanted = rows.select(hot().alias("ProductID"), F.col("seq").alias("Quantity"))
    df = op.check_feasibility(wanted, recipes, stock)
    assert df.count() == ROWS
    assert "skew=true" in plan_of(df)
    verdict = plan_of(op.feasibility_verdict(df))
    assert "skew=true" in verdict
    assert "partial_bool_and" in verdict or "partial_min" in verdict


def test_top_k_reads_no_more_than_it_needs(spark):
    from larder.suite.tables import Bound

    t = Bound(spark, SMALL)
    plan = plan_of(lookups.recent_orders(t.orders, t.customers, t.payments))
    assert "TakeOrderedAndProject" in plan


def test_point_lookup_reaches_the_scan(spark):
    plan = plan_of(REGISTRY["order_total_point"](spark, SMALL))
    assert "EqualTo(o_orderkey,101)" in plan
    assert "o_custkey" not in plan


def test_sales_combine_before_the_shuffle_and_the_join(spark, large):
    plan = plan_of(REGISTRY["top_selling_products"](spark, SMALL))
    join = plan.index("SortMergeJoin")
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(ProductID") > join
    assert "l_shipdate" not in plan


def test_order_summary_shuffles_the_orders_once(spark, large):
    plan = plan_of(REGISTRY["order_summary"](spark, SMALL))
    assert plan.count("o_totalprice") and "ReusedExchange [Order_ID" in plan


@pytest.mark.parametrize("name", [n for n in REGISTRY if not n.startswith("stream_")])
def test_no_query_degenerates(spark, large, name):
    plan = plan_of(REGISTRY[name](spark, SMALL))
    for bad in ("NestedLoopJoin", "Cartesian", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert bad not in plan
    assert not re.search(r"\bWindow\b", plan)


def test_nothing_is_cut_short_or_kept_locally():
    import larder.operators.commands as commands
    import larder.operators.keyed as keyed
    import larder.operators.verdict as verdict
    import larder.streaming.jobs as jobs

    for module in (commands, keyed, verdict, jobs):
        assert "localCheckpoint" not in inspect.getsource(module)


def test_references_are_checked_in_one_pass(spark, large, monkeypatch):
    """Each table is scanned once, and one join leads from dangling values back to the rows."""
    from larder.operators import integrity
    from larder.suite.tables import Bound

    facts, real = [], integrity.stored
    monkeypatch.setattr(integrity, "stored", lambda df, name: facts.append(df) or real(df, name))
    tables = Bound(spark, SMALL)
    found = integrity.audit_references(tables)

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan")

    # The suite derives some tables from several files.
    assert len(facts) == 1 and scans(facts[0]) <= sum(scans(tables[name]) for name in tables)
    plan = plan_of(found)
    assert plan.count("Join") == 1 and "SortAggregate" not in plan


def test_a_reference_that_a_third_of_the_rows_have_is_split(spark, rows, keys, splitting):
    from larder.operators.integrity import audit_references

    children = rows.select(F.col("seq").alias("PO_ID"), hot().alias("SupplierID"))
    found = audit_references({"Suppliers": renamed(keys, "SupplierID").where("SupplierID <> 7"), "Purchase_Order": children})
    assert found.count() > ROWS / 3
    assert "skew=true" in plan_of(found)


def test_references_of_other_types_meet(spark):
    from larder.operators.integrity import audit_references

    parents = spark.createDataFrame([(5,), (6,)], "SupplierID int")
    children = spark.createDataFrame([(1, "5.00"), (2, "5.50"), (3, None), (4, "7.00")], "PO_ID long, s string").select("PO_ID", F.col("s").cast("decimal(8,2)").alias("SupplierID"))
    found = audit_references({"Suppliers": parents, "Purchase_Order": children}).collect()
    assert {(r.key, r.value) for r in found} == {("2", "5.50"), ("4", "7.00")}


@pytest.mark.parametrize("name", ["upsert_by_key", "update_by_key", "complete_delivery", "equipment_after_update"])
def test_newest_rows_come_from_hash_aggregation(spark, large, name):
    plan = plan_of(REGISTRY[name](spark, SMALL))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


PARENTS = {
    "place_purchase_order": 1, "receive_batch": 2, "add_recipe_ingredient": 2, "place_order": 1, "process_payment": 1,
}


@pytest.mark.parametrize("name", PARENTS)
def test_each_parent_is_joined_once(spark, rows, keys, large, name):
    """One join for each parent, one with the stored keys and one with the winners; the rows' exchange is read twice."""
    amounts = {c: F.lit(1) for c in ("Total_Amount", "Tax_Amount", "Discount_Amount", "Amount_Paid", "Quantity_Received", "quantity_required")}
    days = {c: F.current_date() for c in ("Order_date", "Receive_date", "Order_Date")}
    refs = {c: F.col("id") % 900 for c in ("SupplierID", "IngredientID", "PO_ID", "ProductID", "CustomerID", "Order_ID")}
    cmds = rows.select("seq", *[v.alias(k) for k, v in (refs | amounts | days).items() if k not in ("Order_Date",)], F.col("id").alias("own"))
    parents = {c: renamed(keys, c) for c in refs}
    due = renamed(keys, "Order_ID", Final_Total=F.lit(0))

    def own(key):
        return cmds.withColumn(key, F.col("own")).drop("own"), renamed(keys, key).where(f"{key} < 5")

    build = {
        "place_purchase_order": lambda: op.place_purchase_order(*own("PO_ID"), parents["SupplierID"]),
        "receive_batch": lambda: op.receive_batch(*own("BatchID"), parents["IngredientID"], parents["PO_ID"]),
        "add_recipe_ingredient": lambda: op.add_recipe_ingredient(*own("RecipeID"), parents["ProductID"], parents["IngredientID"]),
        "place_order": lambda: op.place_order(*own("Order_ID"), parents["CustomerID"]),
        "process_payment": lambda: op.process_payment(*own("Payment_ID"), due),
    }
    verdict = build[name]()
    plan = plan_of(verdict.decided)
    executed = plan.split("ReusedExchange")
    assert len(executed) >= 2
    assert plan.count("SortMergeJoin") == PARENTS[name] + 2
