"""Keyed writes, integrity audits, the ledger and validated commands."""

from larder.operators.bulk import bulk_append
from larder.operators.commands import (
    add_order_line,
    add_recipe_ingredient,
    apply_order_lines,
    assign_delivery,
    complete_delivery,
    hire_employee,
    place_order,
    place_purchase_order,
    process_payment,
    receive_batch,
    update_equipment_status,
)
from larder.operators.feasibility import check_feasibility, feasibility_verdict
from larder.operators.integrity import audit_keys, fk_violations, pk_violations, type_violations
from larder.operators.keyed import (
    append_keyed,
    append_to_key_table,
    assign_ids,
    missing_keys,
    next_id,
    update_by_key,
    upsert,
)
from larder.operators.ledger import (
    apply_batch_receipts,
    apply_movements,
    deduct_ingredients,
    order_final_total,
    rollup_order_total,
)
from larder.operators.rules import stamp_dispatch_time, validate_rider, validate_salary
from larder.operators.verdict import Verdict

__all__ = [
    "Verdict",
    "add_order_line",
    "add_recipe_ingredient",
    "append_keyed",
    "append_to_key_table",
    "apply_batch_receipts",
    "apply_movements",
    "apply_order_lines",
    "assign_delivery",
    "assign_ids",
    "audit_keys",
    "bulk_append",
    "check_feasibility",
    "complete_delivery",
    "deduct_ingredients",
    "feasibility_verdict",
    "fk_violations",
    "hire_employee",
    "missing_keys",
    "next_id",
    "order_final_total",
    "pk_violations",
    "place_order",
    "place_purchase_order",
    "process_payment",
    "receive_batch",
    "rollup_order_total",
    "stamp_dispatch_time",
    "type_violations",
    "update_by_key",
    "update_equipment_status",
    "upsert",
    "validate_rider",
    "validate_salary",
]
