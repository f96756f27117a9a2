"""The ledger and the validations as Structured Streaming jobs."""

from larder.streaming.dispatch import COMPLETION, DISPATCH
from larder.streaming.jobs import (
    DECISION,
    RIDER_STATE,
    current_rows,
    current_totals,
    stock_now,
    stream_dispatch,
    stream_order_totals,
    stream_stock_ledger,
    stream_upsert,
    stream_validated_append,
    total_sums,
)
from larder.streaming.keyed import stream_dispatch_keyed, stream_validated_append_keyed

__all__ = [
    "COMPLETION",
    "DECISION",
    "DISPATCH",
    "RIDER_STATE",
    "current_rows",
    "current_totals",
    "stock_now",
    "stream_dispatch",
    "stream_dispatch_keyed",
    "stream_order_totals",
    "stream_stock_ledger",
    "stream_upsert",
    "stream_validated_append",
    "stream_validated_append_keyed",
    "total_sums",
]
