"""Reading declared tables with their types, and appending to them."""

from __future__ import annotations

import csv
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources.catalog import TABLES

#: The partition column of rows that were appended under the name of a run.
APPENDED_BY = "appended_by"
_CORRUPT = "_corrupt_line"


def load(
    spark: SparkSession,
    path: str,
    name: str,
    fmt: str = "parquet",
    columns: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Table ``name`` read from ``path`` with its declared columns and types.

    ``columns`` says how to get a declared column from a file that names its
    columns differently; declared columns it leaves out are then NULL.

    Columnar files carry their own types, so the declared ones are applied as
    casts, which vanish where the types agree and leave pruning and filter
    pushdown to the scan.  Text files get the declared schema, and a value
    that does not fit it is an error rather than a silent NULL.
    """
    schema = TABLES[name].schema
    if unknown := set(columns or ()) - set(schema.names):
        raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
    if fmt == "csv":
        return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    if fmt == "json":
        return spark.read.json(path, schema=schema, mode="FAILFAST")
    raw = spark.read.format(fmt).load(path)
    if columns is None:
        columns = {f.name: F.col(f.name) for f in schema}
    absent = F.lit(None)
    return raw.select(
        [columns.get(f.name, absent).cast(f.dataType).alias(f.name) for f in schema]
    )


def load_all(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All declared tables, each from the folder of its name below ``root``."""
    return {name: load(spark, f"{root}/{name}", name, fmt) for name in TABLES}


def load_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The same columns from CSV, uninterpreted, as input to the type audit."""
    names = TABLES[name].columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def load_quarantined(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Table ``name`` from lines of CSV (with a header) or JSON: the rows that fit, and the lines that don't.

    The second result has ``raw``, the line, and ``reason``: the first
    declared column whose value does not fit, with that value, or that the
    line as a whole can't be read.  `reject_counts` adds them up.  Both are
    filters over one parsed scan.  Blank lines are skipped; a quoted value can't
    hold a line break.
    """
    spec = TABLES[name]
    lines = spark.read.text(path).where(F.trim("value") != "")
    columns = list(spec.schema.names)
    if fmt == "csv":
        header = lines.first()
        columns = next(csv.reader([header.value])) if header else columns
        if sorted(columns) != sorted(spec.schema.names):
            raise ValueError(f"{name} has other columns than {', '.join(columns)}")
        lines = lines.where(F.col("value") != (header.value if header else ""))
    parse = {"csv": F.from_csv, "json": F.from_json}[fmt]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    typed = T.StructType([*(T.StructField(c, spec.schema[c].dataType) for c in columns), T.StructField(_CORRUPT, T.StringType())])
    plain = T.StructType([T.StructField(f.name, T.StringType()) for f in typed])
    ddl = (lambda schema: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)) if fmt == "csv" else (lambda schema: schema)
    parsed = lines.select(
        F.col("value").alias("raw"), parse("value", ddl(typed), options).alias("row"), parse("value", ddl(plain), options).alias("text")
    )
    broken = F.col("row").isNull() | F.col(f"row.{_CORRUPT}").isNotNull()
    good = parsed.where(~broken).select([F.col(f"row.{c}").alias(c) for c in spec.schema.names])
    unfit = [
        F.when(
            F.col(f"row.{c}").isNull() & F.col(f"text.{c}").isNotNull(),
            F.concat(F.lit(f"{c} is no {spec.columns[c]}: "), F.col(f"text.{c}")),
        )
        for c in columns
        if not isinstance(spec.schema[c].dataType, T.StringType)
    ]
    whole = F.when(F.col("text").isNull() | F.col(f"text.{_CORRUPT}").isNotNull(), F.lit("line cannot be read"))
    reason = F.coalesce(whole, *unfit, F.lit("line cannot be read"))
    return good, parsed.where(broken).select("raw", reason.alias("reason"))


def reject_counts(rejected: DataFrame) -> DataFrame:
    """How many lines were rejected for each column and rule, as the type audit names them."""
    parts = F.regexp_extract("reason", r"^(\w+) is no ([^:]+): ", 1), F.regexp_extract("reason", r"^(\w+) is no ([^:]+): ", 2)
    named = rejected.select(*(F.nullif(p, F.lit("")).alias(n) for p, n in zip(parts, ("column", "rule"), strict=True)))
    return named.groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n"))


def largest_key(spark: SparkSession, path: str, column: str, fmt: str = "parquet") -> DataFrame:
    """One row with ``largest``, the highest value of a column, or NULL for an empty table.

    Parquet and ORC files hold it in their footers, and only those are read;
    other formats are scanned.  The plan is made here, under settings that
    hold for it alone.
    """
    pushed = {"parquet": "spark.sql.parquet.aggregatePushdown", "orc": "spark.sql.orc.aggregatePushdown"}
    wanted = {"spark.sql.sources.useV1SourceList": ""} | ({pushed[fmt]: "true"} if fmt in pushed else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        found = spark.read.format(fmt).load(path).agg(F.max(column).alias("largest"))
        found._jdf.queryExecution().executedPlan()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return found


def append(df: DataFrame, path: str, fmt: str = "parquet", batch: str | None = None) -> None:
    """Append rows to a stored table.

    With ``batch``, the name of the job's run, the rows are a partition of
    their own: a run that is repeated replaces what it wrote before and leaves
    all other rows alone.  Tables are appended to either with or without.
    """
    if batch is None:
        df.write.format(fmt).mode("append").save(path)
        return
    rows = df.withColumn(APPENDED_BY, F.lit(batch))
    # The partition is replaced when the job commits, not before.
    rows.write.format(fmt).partitionBy(APPENDED_BY).mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
