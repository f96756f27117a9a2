"""Declared tables, readers and writers."""

from larder.sources.batchlog import BatchLog
from larder.sources.catalog import TABLES, Table
from larder.sources.keytable import KeyTable
from larder.sources.readers import append, largest_key, load, load_all, load_quarantined, load_text, reject_counts
from larder.sources.tiered import TieredLog

__all__ = [
    "TABLES",
    "BatchLog",
    "KeyTable",
    "Table",
    "TieredLog",
    "append",
    "largest_key",
    "load",
    "load_all",
    "load_quarantined",
    "load_text",
    "reject_counts",
]
