"""Inventory, order, payment, delivery and staffing operators for Spark.

Every operator takes and returns DataFrames and leaves the physical plan to
Catalyst and adaptive execution.  The sub-packages:

``sources``    declared tables, typed readers, per-batch stream output
``functions``  column expressions
``operators``  keyed writes, integrity audits, ledger, command validation
``plans``      reporting views and lookups, and reading them by name
``streaming``  the ledger and the validations as Structured Streaming jobs
``suite``      the operators bound to the benchmark tables
"""
