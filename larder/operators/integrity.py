"""The declared constraints as data-quality jobs."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import stored
from larder.sources.catalog import TABLES


def pk_violations(df: DataFrame, pk: str) -> DataFrame:
    """Keys that occur more than once or are NULL, with their count ``n``."""
    counts = df.groupBy(F.col(pk).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") > 1) | F.col("key").isNull())


def fk_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of ``child`` whose reference is set but has no parent."""
    known = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(known, fk, "left_anti").select(child.columns)


def _breaks(column: str, held: T.DataType, declared: str) -> Column | None:
    """Whether a value does not fit its declared type; None if its own type says it does."""
    value = F.col(column)
    text = value.cast("string")
    if declared.startswith("VARCHAR"):
        return F.char_length(text) > int(re.search(r"\d+", declared)[0])
    if declared == "INT":
        if isinstance(held, T.IntegralType):
            return None
        if isinstance(held, T.NumericType):
            return (value != F.floor(value)) | value.try_cast("bigint").isNull()
        return text.try_cast("bigint").isNull()
    if declared == "DATE" and isinstance(held, T.DateType):
        return None
    exact = isinstance(held, (T.DecimalType, T.IntegralType))
    return (value if exact else text).try_cast(declared.lower()).isNull()


def type_violations(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Values that do not fit ``spec`` (column to declared type), in one scan.

    One row per offending value: ``column``, ``value`` and ``rule``.
    """
    types = {f.name.lower(): f.dataType for f in df.schema}
    tests = {c: _breaks(c, types[c.lower()], declared) for c, declared in spec.items()}
    tests = {c: F.col(c).isNotNull() & test for c, test in tests.items() if test is not None}
    if not tests:
        return df.sparkSession.createDataFrame([], "column string, value string, rule string")
    found = [
        F.when(
            test,
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("string").alias("value"),
                F.lit(spec[c]).alias("rule"),
            ),
        )
        for c, test in tests.items()
    ]
    # Most rows are dropped first; the array is as long as the table is wide.
    suspects = df.where(reduce(Column.__or__, tests.values()))
    return suspects.select(F.inline(F.array(*found))).where(F.col("rule").isNotNull())


def audit_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Key violations of all given tables, keys as text."""
    parts = [
        pk_violations(df, TABLES[name].key).select(
            F.lit(name).alias("table"), F.col("key").cast("string").alias("key"), "n"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _as_key(column: str, held: T.DataType, key: T.DataType) -> Column:
    """A reference as text that equals its parent's key as text if the two are equal."""
    whole = isinstance(held, T.IntegralType) and isinstance(key, T.IntegralType)
    if held == key or whole:
        return F.col(column).cast("string")
    if isinstance(held, T.NumericType) and isinstance(key, T.NumericType):
        return F.col(column).cast("decimal(38,10)").cast("string")
    return F.col(column).cast("string")


def audit_references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Dangling references of all given tables: table, column, row key and value, as text.

    One pass: each table is read once, and a row gives its own key and its
    references, as (parent, value).  All that is needed is stored, narrow as
    it is.  Keys and references of one value meet in one hash aggregation,
    which combines before the shuffle; what is referred to and no key leads
    back to the rows.
    """
    referred = {parent for name in tables for parent in TABLES[name].refs.values() if parent in tables}
    types = {name: {f.name: f.dataType for f in df.schema} for name, df in tables.items()}
    parts = []
    for name, df in tables.items():
        spec, entries = TABLES[name], []

        def entry(parent: str, value: Column, column: str | None, shown: Column, key: str = spec.key) -> Column:
            return F.struct(
                F.lit(parent).alias("parent"),
                value.alias("match"),
                F.lit(column).cast("string").alias("column"),
                F.col(key).cast("string").alias("key"),
                shown.cast("string").alias("value"),
            )

        # A key is written once for each form that references to it take.
        forms = {}
        for child in tables:
            for fk, parent in TABLES[child].refs.items():
                if parent == name:
                    own = types[name][spec.key]
                    forms[str(_as_key(spec.key, own, types[child][fk]))] = _as_key(spec.key, own, types[child][fk])
        if name in referred:
            entries += [entry(name, form, None, F.lit(None)) for form in forms.values()]
        for fk, parent in spec.refs.items():
            if parent in tables:
                known = types[parent][TABLES[parent].key]
                entries.append(entry(parent, _as_key(fk, types[name][fk], known), fk, F.col(fk)))
        if entries:
            parts.append(df.select(F.lit(name).alias("table"), F.inline(F.array(*entries))).where(F.col("match").isNotNull()))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, column string, key string, value string")
    facts = stored(reduce(DataFrame.unionByName, parts), "references")
    values = facts.groupBy("parent", "match").agg(F.bool_or(F.col("column").isNull()).alias("known"))
    dangling = values.where("NOT known").select(F.struct("parent", "match").alias("_at"))
    # Joined so that a parent that a third of the rows refer to is split.
    at = F.struct("parent", "match").eqNullSafe(F.col("_at"))
    return facts.where(F.col("column").isNotNull()).join(dangling, at, "left_semi").select("table", "column", "key", "value")
