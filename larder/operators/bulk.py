"""Appending rows to many tables with all their rules and effects."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame

from larder.operators.ledger import (
    apply_batch_receipts,
    deduct_ingredients,
    order_final_total,
    rollup_order_total,
)
from larder.operators.rules import judge_deliveries, stamp_dispatch_time, validate_salary
from larder.operators.verdict import Verdict, reject_taken_keys
from larder.session import stored
from larder.sources.catalog import TABLES


def bulk_append(
    state: Mapping[str, DataFrame],
    rows: Mapping[str, DataFrame],
    now: Column | dt.datetime | str | None = None,
    seq: str = "seq",
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Append ``rows`` (each with ``seq``) to ``state``; returns state and rejected rows.

    Tables are taken in their declared order, parents first.  Salary and rider
    rules and keys may refuse a row; what is accepted moves the stock and sets
    dispatch times and order totals.
    """
    after, refused = dict(state), {}
    for name, spec in TABLES.items():
        if name not in rows:
            continue
        new = rows[name]
        if name == "Employees":
            new = validate_salary(new).decided
        elif name == "Deliveries":
            new = stamp_dispatch_time(judge_deliveries(after[name], new, seq).decided, now)
        elif name == "Orders":
            new = order_final_total(new)
        # Read several times below, so decided and stored once.
        verdict = Verdict(stored(reject_taken_keys(new, after[name], spec.key, seq), "decided"))
        accepted = verdict.accepted.select(after[name].columns)
        refused[name] = verdict.rejected
        after[name] = after[name].unionByName(accepted)
        if name == "Batches":
            after["Ingredients"] = apply_batch_receipts(after["Ingredients"], accepted)
        elif name == "Order_Details":
            after["Ingredients"] = deduct_ingredients(
                after["Ingredients"], after["Recipes"], accepted
            )
            after["Orders"] = rollup_order_total(after["Orders"], after[name], accepted)
    return after, refused
