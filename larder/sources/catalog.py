"""The 17 tables: declared columns, primary keys and references."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """One declared table; ``refs`` maps a column to the table it refers to."""

    name: str
    columns: dict[str, str]
    refs: dict[str, str] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return next(iter(self.columns))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, spark_type(c, d)) for c, d in self.columns.items()])


# Declared INT, yet they carry amounts with a fraction (recipe deductions,
# payments of an order total), so they are read as exact decimals.
FRACTIONAL = {"Current_stock": T.DecimalType(20, 2), "Amount_Paid": T.DecimalType(20, 2)}


def spark_type(column: str, declared: str) -> T.DataType:
    """The Spark type that holds a declared column without loss."""
    if column in FRACTIONAL:
        return FRACTIONAL[column]
    if declared == "INT":
        return T.LongType()
    if declared == "DATE":
        return T.DateType()
    if declared.startswith("DECIMAL"):
        precision, scale = map(int, re.findall(r"\d+", declared))
        return T.DecimalType(precision, scale)
    return T.StringType()


# Table names, column names, declared types, keys (the first
# column) and references.
_TABLES = [
    Table("Suppliers", {
        "SupplierID": "INT", "Name": "VARCHAR(30)", "Contact_person": "VARCHAR(30)",
        "Phone": "VARCHAR(30)", "Email_address": "VARCHAR(30)"}),
    Table("Ingredient_Categories", {
        "CategoryID": "INT", "CategoryName": "VARCHAR(50)", "Description": "VARCHAR(50)"}),
    Table("Ingredients", {
        "IngredientID": "INT", "Name": "VARCHAR(30)", "CategoryID": "INT",
        "unit_of_measure": "VARCHAR(30)", "Reorder_level": "VARCHAR(30)",
        "Current_stock": "INT"},
        {"CategoryID": "Ingredient_Categories"}),
    Table("Purchase_Order", {
        "PO_ID": "INT", "SupplierID": "INT", "Order_date": "DATE",
        "Exp_deleivey_date": "DATE", "Total_Amount": "INT", "Status": "VARCHAR(20)"},
        {"SupplierID": "Suppliers"}),
    Table("Batches", {
        "BatchID": "INT", "IngredientID": "INT", "PO_ID": "INT", "Receive_date": "DATE",
        "Expiry_date": "DATE", "Quantity_Received": "INT", "Remaining_Quantity": "INT"},
        {"IngredientID": "Ingredients", "PO_ID": "Purchase_Order"}),
    Table("Product_categories", {
        "CategoryID": "INT", "Category_Name": "VARCHAR(50)", "Description": "VARCHAR(50)"}),
    Table("Products", {
        "ProductID": "INT", "Name": "VARCHAR(30)", "CategoryID": "INT",
        "Description": "VARCHAR(30)", "Base_Price": "DECIMAL(8,2)", "is_active": "INT"},
        {"CategoryID": "Product_categories"}),
    Table("Recipes", {
        "RecipeID": "INT", "ProductID": "INT", "IngredientID": "INT",
        "quantity_required": "DECIMAL(8,2)"},
        {"ProductID": "Products", "IngredientID": "Ingredients"}),
    Table("customers", {
        "CustomerID": "INT", "First_Name": "VARCHAR(30)", "Last_Name": "VARCHAR(30)",
        "Phone": "VARCHAR(30)", "Email": "VARCHAR(30)", "Registration_Date": "DATE"}),
    Table("Customer_Addresses", {
        "AddressID": "INT", "CustomerID": "INT", "Address_Line": "VARCHAR(30)",
        "City": "VARCHAR(30)", "Address_Type": "VARCHAR(30)", "Is_Default": "INT"},
        {"CustomerID": "customers"}),
    Table("Orders", {
        "Order_ID": "INT", "CustomerID": "INT", "Order_Date": "DATE",
        "Total_Amount": "DECIMAL(8,2)", "Tax_Amount": "DECIMAL(8,2)",
        "Discount_Amount": "DECIMAL(8,2)", "Final_Total": "DECIMAL(8,2)"},
        {"CustomerID": "customers"}),
    Table("Order_Details", {
        "Order_Detail_ID": "INT", "Order_ID": "INT", "ProductID": "INT", "Quantity": "INT",
        "Unit_Price": "DECIMAL(8,3)", "Line_Total": "DECIMAL(8,3)"},
        {"Order_ID": "Orders", "ProductID": "Products"}),
    Table("payments", {
        "Payment_ID": "INT", "Order_ID": "INT", "Payment_Date": "DATE",
        "Amount_Paid": "INT", "Payment_Status": "INT"},
        {"Order_ID": "Orders"}),
    Table("Delivery_Riders", {
        "Rider_ID": "INT", "First_Name": "VARCHAR(30)", "Last_Name": "VARCHAR(30)",
        "Phone": "VARCHAR(30)", "Vehicle_Type": "VARCHAR(30)"}),
    Table("Deliveries", {
        "Delivery_ID": "INT", "Order_ID": "INT", "Rider_ID": "INT", "AddressID": "INT",
        "Dispatch_Time": "VARCHAR(60)", "Delivery_Time": "VARCHAR(60)",
        "Delivery_Status": "INT"},
        {"Order_ID": "Orders", "Rider_ID": "Delivery_Riders",
         "AddressID": "Customer_Addresses"}),
    Table("Employees", {
        "Employee_ID": "INT", "First_Name": "VARCHAR(30)", "Last_Name": "VARCHAR(30)",
        "Hire_Date": "DATE", "Phone": "VARCHAR(30)", "Salary": "INT"}),
    Table("Kitchen_Equipment", {
        "Equipment_ID": "INT", "Equipment_Name": "VARCHAR(30)", "Purchase_Date": "DATE",
        "Warranty_Expiry": "DATE", "Status": "VARCHAR(30)"}),
]

TABLES: dict[str, Table] = {t.name: t for t in _TABLES}
