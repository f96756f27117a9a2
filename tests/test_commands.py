"""Validated commands: each reason, their order, and sequences."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder import operators as op
from larder.operators import turns
from larder.operators.commands import apply_equipment_status, receive_into_stock


def reasons(verdict, by="seq"):
    return {r[by]: r.reason for r in verdict.decided.collect()}


def ids(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_purchase_orders(spark):
    cmds = spark.createDataFrame(
        [(1, 10, 7), (2, 11, 9), (3, 11, 7), (4, 11, 7), (5, 12, None), (6, 1, 7)],
        "seq long, PO_ID long, SupplierID long",
    ).withColumns({"Order_date": F.lit("2026-01-30").cast("date"), "Total_Amount": F.lit(5)})
    verdict = op.place_purchase_order(cmds, ids(spark, "PO_ID", [1]), ids(spark, "SupplierID", [7]))
    assert reasons(verdict) == {
        1: None,
        2: "supplier not found",
        3: None,
        4: "duplicate key",
        5: "supplier not found",
        6: "duplicate key",
    }
    first = verdict.accepted.where("seq = 1").first()
    assert (str(first.Exp_deleivey_date), first.Status) == ("2026-02-06", "Pending")
    assert verdict.accepted.count() + verdict.rejected.count() == 6


def test_given_defaults_are_kept(spark):
    cmds = spark.createDataFrame(
        [(1, 10, 7, "Shipped"), (2, 11, 7, None)], "seq long, PO_ID long, SupplierID long, Status string"
    ).withColumns({"Order_date": F.lit("2026-01-30").cast("date"), "Total_Amount": F.lit(5)})
    verdict = op.place_purchase_order(cmds, ids(spark, "PO_ID", []), ids(spark, "SupplierID", [7]))
    assert {r.seq: r.Status for r in verdict.accepted.collect()} == {1: "Shipped", 2: "Pending"}


def test_batches(spark):
    cmds = spark.createDataFrame(
        [(1, 1, 5, 3), (2, 2, 6, 3), (3, 3, 5, 4), (4, 4, None, None), (5, 1, 5, 3)],
        "seq long, BatchID long, IngredientID long, PO_ID long",
    ).withColumns(
        {"Receive_date": F.lit("2026-01-01").cast("date"), "Quantity_Received": F.lit(4)}
    )
    stock = spark.createDataFrame([(5, Decimal(1))], "IngredientID long, Current_stock decimal(20,2)")
    verdict = op.receive_batch(cmds, ids(spark, "BatchID", []), stock, ids(spark, "PO_ID", [3]))
    assert reasons(verdict) == {
        1: None,
        2: "ingredient not found",
        3: "purchase order not found",
        4: None,
        5: "duplicate key",
    }
    row = verdict.accepted.where("seq = 1").first()
    assert (str(row.Expiry_date), row.Remaining_Quantity) == ("2026-06-30", 4)
    assert receive_into_stock(verdict, stock).first().Current_stock == 5


def test_recipe_lines(spark):
    cmds = spark.createDataFrame(
        [(1, 1, 1, 1), (2, 2, 2, 1), (3, 3, 1, 2), (4, 1, 1, 1), (5, 5, None, 1)],
        "seq long, RecipeID long, ProductID long, IngredientID long",
    ).withColumn("quantity_required", F.lit(Decimal("0.5")))
    verdict = op.add_recipe_ingredient(
        cmds, ids(spark, "RecipeID", []), ids(spark, "ProductID", [1]), ids(spark, "IngredientID", [1])
    )
    assert reasons(verdict) == {
        1: None,
        2: "product not found",
        3: "ingredient not found",
        4: "duplicate key",
        5: "product not found",
    }


def test_orders(spark):
    cmds = spark.createDataFrame(
        [(1, 1, 1, Decimal(5), Decimal(2)), (2, 2, 9, Decimal(0), Decimal(0)), (3, 3, 1, None, Decimal(0))],
        "seq long, Order_ID long, CustomerID long, Tax_Amount decimal(8,2), Discount_Amount decimal(8,2)",
    )
    verdict = op.place_order(cmds, ids(spark, "Order_ID", []), ids(spark, "CustomerID", [1]))
    assert reasons(verdict) == {1: None, 2: "customer not found", 3: None}
    assert {r.seq: (r.Total_Amount, r.Final_Total) for r in verdict.accepted.collect()} == {
        1: (0, 3), 3: (0, None),
    }


def test_order_lines(spark):
    cmds = spark.createDataFrame(
        [(3, 1, 1, 2), (1, 1, 2, 1), (2, 1, 1, 1)],
        "seq long, Order_ID long, ProductID long, Quantity int",
    )
    menu = spark.createDataFrame([(1, Decimal("2.50"))], "ProductID long, Base_Price decimal(8,2)")
    verdict = op.add_order_line(cmds, ids(spark, "Order_Detail_ID", [30]), menu)
    assert {r.seq: (r.Order_Detail_ID, r.Line_Total, r.reason) for r in verdict.decided.collect()} == {
        1: (None, None, "product not on the menu"),
        2: (31, Decimal("2.50"), None),
        3: (32, Decimal("5.00"), None),
    }


def test_payments(spark):
    cmds = spark.createDataFrame(
        [(1, 1, 101, Decimal(1259)), (2, 1, 101, Decimal(1260)), (3, 2, 101, Decimal(9999)),
         (4, 3, 999, Decimal(1)), (5, 4, 102, Decimal(1)), (6, 5, None, Decimal(1)),
         (7, 6, 101, None), (8, 7, 101, Decimal(2000))],
        "seq long, Payment_ID long, Order_ID long, Amount_Paid decimal(20,2)",
    ).withColumn("Payment_Date", F.current_date())
    orders = spark.createDataFrame(
        [(101, Decimal(1260)), (102, None)], "Order_ID long, Final_Total decimal(8,2)"
    )
    verdict = op.process_payment(cmds, ids(spark, "Payment_ID", [7]), orders)
    assert reasons(verdict) == {
        1: "underpayment", 2: None, 3: None, 4: "order not found", 5: None,
        6: "order not found", 7: None, 8: "duplicate key",
    }
    assert {r.Payment_Status for r in verdict.accepted.collect()} == {1}


def test_riders_in_a_batch(spark):
    deliveries = spark.createDataFrame(
        [(1, 3, 0), (2, 4, 1), (3, None, 0)], "Delivery_ID long, Rider_ID long, Delivery_Status int"
    )
    new = spark.createDataFrame(
        [(1, 3, 1), (2, 4, 1), (3, 4, 0), (4, 4, 1), (5, None, 0), (6, None, 0), (7, 5, None), (8, 5, 0)],
        "seq long, Rider_ID long, Delivery_Status int",
    )
    assert reasons(op.validate_rider(deliveries, new)) == {
        1: "rider busy", 2: None, 3: None, 4: "rider busy", 5: None, 6: None, 7: None, 8: None,
    }


def one_by_one(commands, stored_keys, busy, orders, riders):
    """Deliveries as a database would take them, one after the other."""
    keys, busy, out = set(stored_keys), set(busy), {}
    for seq, key, order, rider in sorted(commands):
        if order not in orders:
            out[seq] = "order not found"
        elif rider not in riders:
            out[seq] = "rider not found"
        elif rider in busy:
            out[seq] = "rider busy"
        elif key is None:
            out[seq] = "missing key"
        elif key in keys:
            out[seq] = "duplicate key"
        else:
            out[seq] = None
            keys.add(key)
            busy.add(rider)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dispatch_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    commands = [
        (n, rng.choice([None, *range(1, 25)]), rng.randrange(6), rng.choice([None, *range(25)]))
        for n in range(120)
    ]
    stored, busy = {100, 1, 2}, {3, 4}
    deliveries = spark.createDataFrame(
        [(k, k % 3, 1) for k in stored] + [(200 + r, r, 0) for r in busy],
        "Delivery_ID long, Rider_ID long, Delivery_Status int",
    )
    cmds = spark.createDataFrame(
        commands, "seq long, Delivery_ID long, Order_ID long, Rider_ID long"
    ).withColumn("AddressID", F.lit(1))
    verdict = op.assign_delivery(
        cmds, deliveries, ids(spark, "Order_ID", range(5)), ids(spark, "Rider_ID", range(23)),
        "2026-01-01 08:00:00",
    )
    want = one_by_one(commands, stored | {203, 204}, busy, set(range(5)), set(range(23)))
    assert reasons(verdict) == want
    assert {r.Dispatch_Time for r in verdict.accepted.collect()} == {"2026-01-01 08:00:00"}


def test_dispatch_needs_more_rounds_where_bids_wait(spark):
    # Each bid waits for the one before it, in turn for its rider and its key.
    commands = [(n, (n + 1) // 2 + 1, 1, n // 2 + 1) for n in range(9)]
    cmds = spark.createDataFrame(
        commands, "seq long, Delivery_ID long, Order_ID long, Rider_ID long"
    ).withColumn("AddressID", F.lit(1))
    deliveries = spark.createDataFrame([], "Delivery_ID long, Rider_ID long, Delivery_Status int")
    verdict = op.assign_delivery(
        cmds, deliveries, ids(spark, "Order_ID", [1]), ids(spark, "Rider_ID", range(9))
    )
    assert reasons(verdict) == one_by_one(commands, set(), set(), {1}, set(range(9)))


@pytest.mark.parametrize("seed", range(3))
def test_bulk_deliveries_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [
        (n, rng.choice([None, *range(1, 40)]), rng.choice([None, *range(15)]), rng.choice([0, 1, None]))
        for n in range(120)
    ]
    keys, busy, want = {1, 2, 100}, {3}, {}
    for seq, key, rider, status in rows:
        if rider in busy:
            want[seq] = "rider busy"
        elif key is None or key in keys:
            want[seq] = "missing key" if key is None else "duplicate key"
        else:
            want[seq] = None
            keys.add(key)
            if status == 0 and rider is not None:
                busy.add(rider)
    shape = "Delivery_ID long, Order_ID long, Rider_ID long, Dispatch_Time string, Delivery_Status int"
    state = spark.createDataFrame([(1, 1, 1, "t", 1), (2, 1, 2, "t", 1), (100, 1, 3, "t", 0)], shape)
    new = spark.createDataFrame(
        [(s, k, 1, r, None, st) for s, k, r, st in rows], "seq long, " + shape
    )
    after, refused = op.bulk_append({"Deliveries": state}, {"Deliveries": new}, "2026-01-01 08:00:00")
    got = {r.seq: r.reason for r in refused["Deliveries"].collect()}
    assert got == {s: r for s, r in want.items() if r}
    stored = {r.Delivery_ID: r.Dispatch_Time for r in after["Deliveries"].collect()}
    assert stored == {1: "t", 2: "t", 100: "t"} | {
        k: "2026-01-01 08:00:00" for s, k, _, _ in rows if want[s] is None
    }


def test_complete_delivery(spark):
    deliveries = spark.createDataFrame(
        [(1, None, 0), (2, "t", 1), (3, None, 0)],
        "Delivery_ID long, Delivery_Time string, Delivery_Status int",
    )
    cmds = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, 1)], "seq long, Delivery_ID long")
    after = op.complete_delivery(cmds, deliveries, "2026-01-01 08:00:00")
    assert sorted(tuple(r) for r in after.collect())[:2] == [
        (1, "2026-01-01 08:00:00", 1), (2, "2026-01-01 08:00:00", 1),
    ]
    assert after.where("Delivery_ID = 3").first().Delivery_Status == 0


def test_dispatch_time(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "Dispatch_Time string")
    after = op.stamp_dispatch_time(df, "2026-01-01 08:00:00").collect()
    assert [r[0] for r in after] == ["2026-01-01 08:00:00"] * 2 + ["x"]


def test_hiring(spark):
    cmds = spark.createDataFrame(
        [(1, 1, " A\t", "B", " 1 ", 5), (2, 2, " ", "B", "", 5), (3, 3, "A", None, "", 5),
         (4, 4, "A", "B", "", 0), (5, 5, "A", "B", "", None), (6, 1, "A", "B", "", 5), (7, 9, "A", "B", "", 1)],
        "seq long, Employee_ID long, First_Name string, Last_Name string, Phone string, Salary long",
    )
    verdict = op.hire_employee(cmds, ids(spark, "Employee_ID", [9]), "2026-01-02")
    assert reasons(verdict) == {
        1: None, 2: "blank first name", 3: "blank last name", 4: "salary not positive", 5: None,
        6: "duplicate key", 7: "duplicate key",
    }
    row = verdict.accepted.where("seq = 1").first()
    assert (row.First_Name, row.Phone, str(row.Hire_Date)) == ("A", "1", "2026-01-02")


def test_equipment(spark):
    cmds = spark.createDataFrame(
        [(1, 1, "Working"), (2, 2, "Lost"), (3, 3, None), (4, 9, "Working"), (5, 1, "Not Working")],
        "seq long, Equipment_ID long, Status string",
    )
    verdict = op.update_equipment_status(cmds)
    assert reasons(verdict) == {1: None, 2: "unknown status", 3: None, 4: None, 5: None}
    kit = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "Equipment_ID long, Status string")
    after = apply_equipment_status(verdict, kit)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "Not Working"), (2, "b"), (3, None)]


def bid_chain(spark, n):
    """Each bid waits for the one before it, in turn for its rider and its key."""
    commands = [(k, (k + 1) // 2 + 1, 1, k // 2 + 1) for k in range(n)]
    cmds = spark.createDataFrame(commands, "seq long, Delivery_ID long, Order_ID long, Rider_ID long")
    return commands, cmds.withColumn("AddressID", F.lit(1))


def test_a_chain_of_bids_is_contracted(spark, monkeypatch):
    names, real = [], turns.stored
    monkeypatch.setattr(turns, "stored", lambda df, name: names.append(name) or real(df, name))
    deliveries = spark.createDataFrame([], "Delivery_ID long, Rider_ID long, Delivery_Status int")
    commands, cmds = bid_chain(spark, 64)
    verdict = op.assign_delivery(cmds, deliveries, ids(spark, "Order_ID", [1]), ids(spark, "Rider_ID", range(99)))
    assert reasons(verdict) == one_by_one(commands, set(), set(), {1}, set(range(99)))
    assert names.count("links") <= 8


def test_bids_that_nobody_contests_are_not_stored(spark, monkeypatch):
    held, real = [], turns.stored
    monkeypatch.setattr(turns, "stored", lambda df, name: held.append(real(df, name)) or held[-1])
    deliveries = spark.createDataFrame([], "Delivery_ID long, Rider_ID long, Delivery_Status int")
    commands = [(k, k, 1, k % 30) for k in range(60)]
    cmds = spark.createDataFrame(commands, "seq long, Delivery_ID long, Order_ID long, Rider_ID long").withColumn("AddressID", F.lit(1))
    verdict = op.assign_delivery(cmds, deliveries, ids(spark, "Order_ID", [1]), ids(spark, "Rider_ID", range(99)))
    assert reasons(verdict) == one_by_one(commands, set(), set(), {1}, set(range(99)))
    assert [df.count() for df in held] == [0]
