"""The declared tables, derived from the benchmark's star schema.

All rows of the underlying tables take part.  Order lines and batches have no
key of their own; theirs is made of order and line number and repeats, which
the key audit is there to find.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions import STAMP_FORMAT
from larder.session import fresh_dir
from larder.sources.catalog import TABLES

TAX = Decimal("0.05")
LINES_PER_ORDER = 8  # above the largest line number
RECIPE_LINES = 4  # recipe lines of each product
MICRO_BATCHES = 4  # of a stream, at least
SLICE_ROWS = 1_000_000  # of a micro-batch, about
# Statuses that stand for the one-letter codes of the orders table.
PO_STATUS = {"F": "Delivered", "O": "Pending", "P": "Shipped"}

_SCHEMAS: dict[str, StructType] = {}


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(12,2)")


def day(column: str) -> Column:
    return F.col(column).cast("date")


def text(column: str) -> Column:
    return F.date_format(column, STAMP_FORMAT)


def slice_of(order: Column, edges: list) -> Column:
    """How many of the ascending ``edges`` lie below, by halves; a missing key is in the first slice."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order > F.lit(edges[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(edges))


class Bound(Mapping):
    """The tables at ``sf_dir`` under their declared names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._feeds: dict[str, str] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return getattr(self, name.lower())

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def source(self, name: str) -> DataFrame:
        """A benchmark table; its schema is read from the files once per process."""
        path = f"{self.dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def stream(self, name: str, order: str) -> DataFrame:
        """The rows of a table as a stream of several files, one per micro-batch, in ``order``.

        There are more of them in a larger table.
        """
        return (
            self.spark.readStream.schema(self.source(name).schema)
            .option("maxFilesPerTrigger", 1)
            .parquet(self._feed(name, order))
        )

    def _feed(self, name: str, order: str) -> str:
        """The table in slices of its order, a file each, written by one pass over it.

        A stream takes files by their time, so the slices get times of their own.
        """
        if name not in self._feeds:
            rows = self.source(name)
            slices = max(MICRO_BATCHES, rows.count() // SLICE_ROWS)
            shares = [i / slices for i in range(1, slices)]
            edges = rows.agg(F.percentile_approx(F.col(order), shares)).first()[0] or []
            path = fresh_dir(self.spark, f"feed-{name}")
            rows.repartitionById(len(edges) + 1, slice_of(F.col(order), edges)).write.parquet(path)
            self._in_turn(path)
            self._feeds[name] = path
        return self._feeds[name]

    def _in_turn(self, path: str) -> None:
        """Give the files a time of their own, in the slices' order; a file's number is that of its slice."""
        made = self.spark._jvm.org.apache.hadoop.fs.Path
        files = made(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        held = [s.getPath() for s in files.listStatus(made(path)) if s.getPath().getName().startswith("part-")]
        for i, file in enumerate(sorted(held, key=lambda f: (int(f.getName().split("-")[1]), f.getName()))):
            files.setTimes(file, 1_000_000_000_000 + 10_000 * i, -1)

    def size(self, name: str) -> Column:
        """The number of rows, as a scalar subquery."""
        return self.source(name).agg(F.count(F.lit(1))).scalar()

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.source("supplier").select(
            F.col("s_suppkey").alias("SupplierID"),
            F.col("s_name").alias("Name"),
            F.lit("sales").alias("Contact_person"),
            F.lit("0300").alias("Phone"),
            F.lit("sales@example.com").alias("Email_address"),
        )

    @cached_property
    def ingredient_categories(self) -> DataFrame:
        return self.source("nation").select(
            F.col("n_nationkey").alias("CategoryID"),
            F.col("n_name").alias("CategoryName"),
            F.lit("").alias("Description"),
        )

    @cached_property
    def ingredients(self) -> DataFrame:
        level = 1000 + (F.col("s_suppkey") % 5) * 1000
        return self.source("supplier").select(
            F.col("s_suppkey").alias("IngredientID"),
            F.col("s_name").alias("Name"),
            F.col("s_nationkey").alias("CategoryID"),
            F.lit("kg").alias("unit_of_measure"),
            level.cast("string").alias("Reorder_level"),
            money("s_acctbal").alias("Current_stock"),
        )

    @cached_property
    def purchase_order(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.source("orders").select(
            F.col("o_orderkey").alias("PO_ID"),
            (F.col("o_custkey") % self.size("supplier")).alias("SupplierID"),
            day("o_orderdate").alias("Order_date"),
            F.date_add(day("o_orderdate"), 7).alias("Exp_deleivey_date"),
            money("o_totalprice").alias("Total_Amount"),
            F.coalesce(*[F.when(status == k, v) for k, v in PO_STATUS.items()]).alias("Status"),
        )

    def batches_of(self, lineitem: DataFrame) -> DataFrame:
        quantity = F.col("l_quantity").cast("int")
        return lineitem.where(F.col("l_linestatus") == "F").select(
            (F.col("l_orderkey") * LINES_PER_ORDER + F.col("l_linenumber")).alias("BatchID"),
            F.col("l_suppkey").alias("IngredientID"),
            F.col("l_orderkey").alias("PO_ID"),
            day("l_shipdate").alias("Receive_date"),
            F.date_add(day("l_shipdate"), 180).alias("Expiry_date"),
            quantity.alias("Quantity_Received"),
            quantity.alias("Remaining_Quantity"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        return self.batches_of(self.source("lineitem"))

    @cached_property
    def product_categories(self) -> DataFrame:
        return (
            self.source("part")
            .select(
                F.col("p_type").alias("CategoryID"),
                F.col("p_type").alias("Category_Name"),
                F.lit("").alias("Description"),
            )
            .distinct()
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.source("part").select(
            F.col("p_partkey").alias("ProductID"),
            F.col("p_name").alias("Name"),
            F.col("p_type").alias("CategoryID"),
            F.col("p_brand").alias("Description"),
            F.col("p_retailprice").cast("decimal(8,2)").alias("Base_Price"),
            F.when(F.col("p_size") % 10 == 0, 0).otherwise(1).alias("is_active"),
        )

    @cached_property
    def recipes(self) -> DataFrame:
        line = F.explode(F.sequence(F.lit(0), F.lit(RECIPE_LINES - 1))).alias("j")
        part, j = F.col("p_partkey"), F.col("j")
        need = (F.col("p_size") + j).cast("decimal(8,2)") * F.lit(TAX)
        return (
            self.source("part")
            .select("p_partkey", "p_size", line)
            .select(
                (part * RECIPE_LINES + j).alias("RecipeID"),
                part.alias("ProductID"),
                ((part * 7 + j * 3) % self.size("supplier")).alias("IngredientID"),
                need.cast("decimal(8,2)").alias("quantity_required"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.source("customer").select(
            F.col("c_custkey").alias("CustomerID"),
            F.col("c_name").alias("First_Name"),
            F.col("c_mktsegment").alias("Last_Name"),
            F.lit("0300").alias("Phone"),
            F.lit("mail@example.com").alias("Email"),
            F.lit("2026-01-01").cast("date").alias("Registration_Date"),
        )

    @cached_property
    def customer_addresses(self) -> DataFrame:
        return (
            self.source("customer")
            .join(self.source("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("AddressID"),
                F.col("c_custkey").alias("CustomerID"),
                F.col("c_name").alias("Address_Line"),
                F.col("n_name").alias("City"),
                F.lit("Home").alias("Address_Type"),
                F.lit(1).alias("Is_Default"),
            )
        )

    @cached_property
    def orders(self) -> DataFrame:
        low = F.col("o_orderpriority") == "5-LOW"
        discount = F.when(low, F.lit(Decimal("10.00"))).otherwise(F.lit(Decimal("0.00")))
        amounts = self.source("orders").select(
            F.col("o_orderkey").alias("Order_ID"),
            F.col("o_custkey").alias("CustomerID"),
            day("o_orderdate").alias("Order_Date"),
            money("o_totalprice").alias("Total_Amount"),
            money(money("o_totalprice") * F.lit(TAX)).alias("Tax_Amount"),
            money(discount).alias("Discount_Amount"),
        )
        final = F.col("Total_Amount") + F.col("Tax_Amount") - F.col("Discount_Amount")
        return amounts.withColumn("Final_Total", money(final))

    def order_details_of(self, lineitem: DataFrame) -> DataFrame:
        quantity, total = F.col("l_quantity").cast("int"), money("l_extendedprice")
        return lineitem.select(
            (F.col("l_orderkey") * LINES_PER_ORDER + F.col("l_linenumber")).alias(
                "Order_Detail_ID"
            ),
            F.col("l_orderkey").alias("Order_ID"),
            F.col("l_partkey").alias("ProductID"),
            quantity.alias("Quantity"),
            money(total / quantity).alias("Unit_Price"),
            total.alias("Line_Total"),
        )

    @cached_property
    def order_details(self) -> DataFrame:
        return self.order_details_of(self.source("lineitem"))

    @cached_property
    def open_details(self) -> DataFrame:
        """The order lines not shipped yet, as the new ones."""
        return self.order_details_of(self.source("lineitem").where("l_linestatus = 'O'"))

    @cached_property
    def payments(self) -> DataFrame:
        event = F.col("event_id")
        return (
            self.source("events")
            .where(F.col("event_type") == "purchase")
            .select(
                event.alias("Payment_ID"),
                ((event - event % 2) * 2).alias("Order_ID"),
                day("ts").alias("Payment_Date"),
                money(F.col("value") * 1000).alias("Amount_Paid"),
                F.when(event % 3 == 0, 0).otherwise(1).alias("Payment_Status"),
            )
        )

    @cached_property
    def delivery_riders(self) -> DataFrame:
        return self.source("customer").select(
            F.col("c_custkey").alias("Rider_ID"),
            F.col("c_name").alias("First_Name"),
            F.col("c_mktsegment").alias("Last_Name"),
            F.lit("0300").alias("Phone"),
            F.col("c_mktsegment").alias("Vehicle_Type"),
        )

    def deliveries_of(self, events: DataFrame) -> DataFrame:
        done = F.col("event_type") == "click"
        return events.select(
            F.col("event_id").alias("Delivery_ID"),
            F.col("event_id").alias("Order_ID"),
            (F.col("event_id") % self.size("customer")).alias("Rider_ID"),
            F.col("user_id").alias("AddressID"),
            text("ts").alias("Dispatch_Time"),
            F.when(done, text("ts")).alias("Delivery_Time"),
            F.when(done, 1).otherwise(0).alias("Delivery_Status"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        return self.deliveries_of(
            self.source("events").where(F.col("event_type").isin("click", "view"))
        )

    @cached_property
    def employees(self) -> DataFrame:
        return self.source("customer").select(
            F.col("c_custkey").alias("Employee_ID"),
            F.col("c_name").alias("First_Name"),
            F.col("c_mktsegment").alias("Last_Name"),
            F.lit("2020-01-01").cast("date").alias("Hire_Date"),
            F.lit("0300").alias("Phone"),
            money("c_acctbal").alias("Salary"),
        )

    @cached_property
    def kitchen_equipment(self) -> DataFrame:
        return self.source("orders").select(
            F.col("o_orderkey").alias("Equipment_ID"),
            F.col("o_orderpriority").alias("Equipment_Name"),
            F.date_add(day("o_orderdate"), -365).alias("Purchase_Date"),
            day("o_orderdate").alias("Warranty_Expiry"),
            F.col("o_orderstatus").alias("Status"),
        )
