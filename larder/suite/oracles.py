"""The SQL each registered query is checked against, in DuckDB's dialect."""

from __future__ import annotations

# The declared tables over the benchmark's tables, in the order they build on
# each other.
TABLE_SQL = {
    "suppliers": """
        SELECT s_suppkey AS SupplierID, s_name AS Name, 'sales' AS Contact_person FROM supplier""",
    "ingredient_categories": """
        SELECT n_nationkey AS CategoryID, n_name AS CategoryName FROM nation""",
    "ingredients": """
        SELECT s_suppkey AS IngredientID, s_name AS Name, s_nationkey AS CategoryID,
               'kg' AS unit_of_measure,
               CAST(1000 + (s_suppkey % 5) * 1000 AS VARCHAR) AS Reorder_level,
               CAST(s_acctbal AS DECIMAL(12,2)) AS Current_stock
        FROM supplier""",
    "purchase_order": """
        SELECT o_orderkey AS PO_ID, o_custkey % (SELECT count(*) FROM supplier) AS SupplierID,
               CAST(o_orderdate AS DATE) AS Order_date,
               CAST(o_orderdate AS DATE) + 7 AS Exp_deleivey_date,
               CAST(o_totalprice AS DECIMAL(12,2)) AS Total_Amount,
               CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Pending'
                                  WHEN 'P' THEN 'Shipped' END AS Status
        FROM orders""",
    "batches": """
        SELECT l_orderkey * 8 + l_linenumber AS BatchID, l_suppkey AS IngredientID,
               l_orderkey AS PO_ID, CAST(l_quantity AS INTEGER) AS Quantity_Received
        FROM lineitem WHERE l_linestatus = 'F'""",
    "product_categories": """
        SELECT DISTINCT p_type AS CategoryID, p_type AS Category_Name FROM part""",
    "products": """
        SELECT p_partkey AS ProductID, p_name AS Name, p_type AS CategoryID,
               p_brand AS Description, CAST(p_retailprice AS DECIMAL(8,2)) AS Base_Price,
               CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS is_active
        FROM part""",
    "recipes": """
        SELECT p_partkey * 4 + j AS RecipeID, p_partkey AS ProductID,
               (p_partkey * 7 + j * 3) % (SELECT count(*) FROM supplier) AS IngredientID,
               CAST(CAST(p_size + j AS DECIMAL(8,2)) * 0.05 AS DECIMAL(8,2)) AS quantity_required
        FROM (SELECT p_partkey, p_size, unnest([0, 1, 2, 3]) AS j FROM part)""",
    "customers": """
        SELECT c_custkey AS CustomerID, c_name AS First_Name, c_mktsegment AS Last_Name
        FROM customer""",
    "customer_addresses": """
        SELECT c_custkey AS AddressID, c_custkey AS CustomerID, c_name AS Address_Line,
               n_name AS City
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "orders_t": """
        SELECT Order_ID, CustomerID, Order_Date, Total_Amount, Tax_Amount, Discount_Amount,
               CAST(Total_Amount + Tax_Amount - Discount_Amount AS DECIMAL(12,2)) AS Final_Total
        FROM (SELECT o_orderkey AS Order_ID, o_custkey AS CustomerID,
                     CAST(o_orderdate AS DATE) AS Order_Date,
                     CAST(o_totalprice AS DECIMAL(12,2)) AS Total_Amount,
                     CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.05 AS DECIMAL(12,2))
                         AS Tax_Amount,
                     CAST(CASE o_orderpriority WHEN '5-LOW' THEN 10 ELSE 0 END AS DECIMAL(12,2))
                         AS Discount_Amount
              FROM orders)""",
    "order_details": """
        SELECT l_orderkey * 8 + l_linenumber AS Order_Detail_ID, l_orderkey AS Order_ID,
               l_partkey AS ProductID, CAST(l_quantity AS INTEGER) AS Quantity,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS Line_Total, l_linestatus
        FROM lineitem""",
    "payments": """
        SELECT event_id AS Payment_ID, (event_id - event_id % 2) * 2 AS Order_ID,
               CAST(ts AS DATE) AS Payment_Date,
               CAST(value * 1000 AS DECIMAL(12,2)) AS Amount_Paid,
               CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS Payment_Status
        FROM events WHERE event_type = 'purchase'""",
    "delivery_riders": """
        SELECT c_custkey AS Rider_ID, c_name AS First_Name, c_mktsegment AS Last_Name,
               c_mktsegment AS Vehicle_Type
        FROM customer""",
    "deliveries": """
        SELECT event_id AS Delivery_ID, event_id AS Order_ID,
               event_id % (SELECT count(*) FROM customer) AS Rider_ID, user_id AS AddressID,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS Dispatch_Time,
               CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END
                   AS Delivery_Time,
               CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS Delivery_Status
        FROM events WHERE event_type IN ('click', 'view')""",
    "employees": """
        SELECT c_custkey AS Employee_ID, c_name AS First_Name, c_mktsegment AS Last_Name,
               CAST(c_acctbal AS DECIMAL(12,2)) AS Salary
        FROM customer""",
    "kitchen_equipment": """
        SELECT o_orderkey AS Equipment_ID, o_orderpriority AS Equipment_Name,
               CAST(o_orderdate AS DATE) - 365 AS Purchase_Date,
               CAST(o_orderdate AS DATE) AS Warranty_Expiry, o_orderstatus AS Status
        FROM orders""",
    # Views that others read.
    "menu": """
        SELECT ProductID, p.Name AS Product, Category_Name, p.Description, Base_Price
        FROM products p JOIN product_categories c ON p.CategoryID = c.CategoryID
        WHERE is_active = 1""",
    "order_summary": """
        SELECT o.Order_ID, First_Name || ' ' || Last_Name AS Customer, Order_Date, Total_Amount,
               Tax_Amount, Discount_Amount, Final_Total,
               CASE WHEN Payment_Status = 1 THEN 'Paid' ELSE 'Unpaid' END AS PaymentStatus
        FROM orders_t o JOIN customers c ON o.CustomerID = c.CustomerID
        LEFT JOIN payments p ON o.Order_ID = p.Order_ID""",
    "received": """
        SELECT IngredientID, sum(Quantity_Received) AS received FROM batches GROUP BY ALL""",
    "used": """
        SELECT IngredientID, sum(quantity_required * Quantity) AS used
        FROM order_details JOIN recipes USING (ProductID) GROUP BY ALL""",
    "stock_after": """
        SELECT IngredientID,
               CAST(Current_stock + coalesce(received, 0) - coalesce(used, 0) AS DECIMAL(20,2))
                   AS Current_stock
        FROM ingredients LEFT JOIN received USING (IngredientID) LEFT JOIN used USING (IngredientID)""",
    "added": """
        SELECT event_id AS Order_ID, ProductID, Quantity,
               CAST(Base_Price * Quantity AS DECIMAL(20,2)) AS Line_Total
        FROM (SELECT event_id, user_id * 14 AS ProductID,
                     CAST(floor(value) + 1 AS INTEGER) AS Quantity FROM events)
        JOIN menu USING (ProductID)""",
    "pending": """
        SELECT PO_ID, Name AS Supplier, Contact_person, Order_date, Exp_deleivey_date,
               Total_Amount, Status
        FROM purchase_order JOIN suppliers USING (SupplierID) WHERE Status <> 'Delivered'""",
    "feasibility": """
        SELECT d.ProductID, d.Quantity, i.Name AS Ingredient,
               CAST(quantity_required * d.Quantity AS DECIMAL(20,2)) AS RequiredQty,
               Current_stock AS CurrentStock,
               CASE WHEN Current_stock >= quantity_required * d.Quantity THEN 'Yes' ELSE 'No' END
                   AS IsFeasible
        FROM order_details d JOIN recipes USING (ProductID) JOIN ingredients i USING (IngredientID)""",
    "on_road": """
        SELECT Delivery_ID, Order_ID, First_Name || ' ' || Last_Name AS Rider, Vehicle_Type,
               Address_Line, City, Dispatch_Time
        FROM deliveries JOIN delivery_riders USING (Rider_ID)
        JOIN customer_addresses USING (AddressID)
        WHERE Delivery_Status = 0""",
    "changes": """
        SELECT event_id AS seq, event_id - event_id % 2 AS RecipeID, user_id AS ProductID,
               user_id AS IngredientID,
               CAST(CAST(value AS DECIMAL(12,2)) * 0.1 AS DECIMAL(8,2)) AS quantity_required
        FROM events""",
    "recipes_after": """
        SELECT * FROM recipes WHERE RecipeID NOT IN (SELECT RecipeID FROM changes)
        UNION ALL
        SELECT RecipeID, ProductID, IngredientID, quantity_required FROM changes
        QUALIFY row_number() OVER (PARTITION BY RecipeID ORDER BY seq DESC) = 1""",
}


def sql(body: str) -> str:
    """``body`` with the tables above that it reads, directly or not."""
    wanted: list[str] = []
    texts = [body]
    while texts:
        words = set(texts.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in TABLE_SQL:
            if name in words and name not in wanted:
                wanted.append(name)
                texts.append(TABLE_SQL[name])
    parts = [f"{name} AS ({text})" for name, text in TABLE_SQL.items() if name in wanted]
    # Recursive, since some of the queries are.
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def keyed_verdict(cmds: str, reason: str, stored: str, pk: str, columns: str) -> str:
    """Commands with a reason: ``reason`` first, then a taken key."""
    return sql(f"""
        SELECT seq, {columns},
               CASE WHEN why IS NOT NULL THEN why
                    WHEN {pk} IN ({stored})
                      OR row_number() OVER (PARTITION BY {pk}, why IS NULL ORDER BY seq) > 1
                    THEN 'duplicate key' END AS reason
        FROM (SELECT *, {reason} AS why FROM ({cmds}) AS cmd)""")


def tagged_violations(table: str, column: str, rule: str, breaks: str) -> str:
    return f"""
        SELECT '{table}' AS "table", '{column}' AS "column", CAST({column} AS VARCHAR) AS value,
               '{rule}' AS rule
        FROM {table.lower()} WHERE {breaks}"""


def dangling(table: str, source: str, key: str, fk: str, parent: str, pk: str) -> str:
    return f"""
        SELECT '{table}' AS "table", '{fk}' AS "column", CAST({key} AS VARCHAR) AS key,
               CAST({fk} AS VARCHAR) AS value
        FROM {source} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})"""


def repeated(table: str, source: str, key: str) -> str:
    return f"""
        SELECT '{table}' AS "table", CAST({key} AS VARCHAR) AS key, count(*) AS n
        FROM {source} GROUP BY {key} HAVING count(*) > 1 OR {key} IS NULL"""


# Table, its SQL above, key.
KEYS = [
    ("Suppliers", "suppliers", "SupplierID"),
    ("Ingredient_Categories", "ingredient_categories", "CategoryID"),
    ("Ingredients", "ingredients", "IngredientID"),
    ("Purchase_Order", "purchase_order", "PO_ID"),
    ("Batches", "batches", "BatchID"),
    ("Product_categories", "product_categories", "CategoryID"),
    ("Products", "products", "ProductID"),
    ("Recipes", "recipes", "RecipeID"),
    ("customers", "customers", "CustomerID"),
    ("Customer_Addresses", "customer_addresses", "AddressID"),
    ("Orders", "orders_t", "Order_ID"),
    ("Order_Details", "order_details", "Order_Detail_ID"),
    ("payments", "payments", "Payment_ID"),
    ("Delivery_Riders", "delivery_riders", "Rider_ID"),
    ("Deliveries", "deliveries", "Delivery_ID"),
    ("Employees", "employees", "Employee_ID"),
    ("Kitchen_Equipment", "kitchen_equipment", "Equipment_ID"),
]

# Table, its SQL, its key, reference, parent's SQL, parent's key.
REFERENCES = [
    ("Ingredients", "ingredients", "IngredientID", "CategoryID", "ingredient_categories", "CategoryID"),
    ("Purchase_Order", "purchase_order", "PO_ID", "SupplierID", "suppliers", "SupplierID"),
    ("Batches", "batches", "BatchID", "IngredientID", "ingredients", "IngredientID"),
    ("Batches", "batches", "BatchID", "PO_ID", "purchase_order", "PO_ID"),
    ("Products", "products", "ProductID", "CategoryID", "product_categories", "CategoryID"),
    ("Recipes", "recipes", "RecipeID", "ProductID", "products", "ProductID"),
    ("Recipes", "recipes", "RecipeID", "IngredientID", "ingredients", "IngredientID"),
    ("Customer_Addresses", "customer_addresses", "AddressID", "CustomerID", "customers", "CustomerID"),
    ("Orders", "orders_t", "Order_ID", "CustomerID", "customers", "CustomerID"),
    ("Order_Details", "order_details", "Order_Detail_ID", "Order_ID", "orders_t", "Order_ID"),
    ("Order_Details", "order_details", "Order_Detail_ID", "ProductID", "products", "ProductID"),
    ("payments", "payments", "Payment_ID", "Order_ID", "orders_t", "Order_ID"),
    ("Deliveries", "deliveries", "Delivery_ID", "Order_ID", "orders_t", "Order_ID"),
    ("Deliveries", "deliveries", "Delivery_ID", "Rider_ID", "delivery_riders", "Rider_ID"),
    ("Deliveries", "deliveries", "Delivery_ID", "AddressID", "customer_addresses", "AddressID"),
]

AS_OF = "DATE '1998-06-01'"
NOW = "'2026-04-01 10:00:00'"

STOCK_LEVELS = """
    SELECT IngredientID, i.Name AS Ingredient, CategoryName, Current_stock, Reorder_level,
           unit_of_measure,
           CASE WHEN Current_stock < CAST(Reorder_level AS BIGINT) THEN 'LOW' ELSE 'OK' END
               AS StockStatus
    FROM ingredients i JOIN ingredient_categories c ON i.CategoryID = c.CategoryID"""

RECIPE_DETAIL = """
    SELECT ProductID, Product, Category_Name, Base_Price, i.Name AS Ingredient,
           quantity_required, unit_of_measure, Current_stock
    FROM recipes JOIN menu USING (ProductID) JOIN ingredients i USING (IngredientID)"""

TOP_SELLING = """
    SELECT p.Name AS Product, CAST(sum(Quantity) AS BIGINT) AS TotalSold,
           CAST(sum(Line_Total) AS DECIMAL(22,2)) AS TotalRevenue
    FROM order_details d JOIN products p ON d.ProductID = p.ProductID
    GROUP BY p.ProductID, p.Name"""

RIDERS = """
    SELECT r.Rider_ID, First_Name || ' ' || Last_Name AS Rider, Vehicle_Type,
           count(d.Delivery_ID) AS CompletedDeliveries
    FROM delivery_riders r LEFT JOIN deliveries d
      ON r.Rider_ID = d.Rider_ID AND d.Delivery_Status = 1
    GROUP BY r.Rider_ID, First_Name, Last_Name, Vehicle_Type"""

BATCH_VERDICT = keyed_verdict(
    """SELECT event_id AS seq, event_id - event_id % 2 AS BatchID, user_id AS IngredientID,
              event_id * 2 AS PO_ID, CAST(ts AS DATE) AS Receive_date,
              CAST(ts AS DATE) + 180 AS Expiry_date,
              CAST(floor(value) AS INTEGER) AS Quantity_Received,
              CAST(floor(value) AS INTEGER) AS Remaining_Quantity
       FROM events""",
    """CASE WHEN IngredientID NOT IN (SELECT IngredientID FROM ingredients)
            THEN 'ingredient not found'
            WHEN PO_ID NOT IN (SELECT PO_ID FROM purchase_order)
            THEN 'purchase order not found' END""",
    "SELECT BatchID FROM batches",
    "BatchID",
    "BatchID, IngredientID, PO_ID, Receive_date, Expiry_date, Quantity_Received, Remaining_Quantity",
)

EQUIPMENT_COMMANDS = """
    SELECT o_orderkey AS seq, o_orderkey * 2 AS Equipment_ID,
           CASE o_orderstatus WHEN 'F' THEN 'Working' WHEN 'O' THEN 'Under Repair'
                              ELSE 'Broken' END AS Status,
           CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown status' END AS reason
    FROM orders"""

# Declared INT and held as decimals; declared INT and held as text; names of 30 letters.
WHOLE = [("Ingredients", "Current_stock"), ("Purchase_Order", "Total_Amount"), ("payments", "Amount_Paid"), ("Employees", "Salary")]
NUMBERED = [("Product_categories", "CategoryID"), ("Products", "CategoryID")]
NAMED = [("Suppliers", "Name"), ("Ingredients", "Name"), ("Products", "Name"), ("customers", "First_Name"), ("customers", "Last_Name")]

FRACTIONAL_STOCK = """
    SELECT IngredientID,
           CAST(Current_stock + coalesce(received * 0.25, 0) - coalesce(CAST(quarters AS DECIMAL(20,2)), 0)
                AS DECIMAL(20,2)) AS Current_stock
    FROM ingredients LEFT JOIN received USING (IngredientID) LEFT JOIN (
        SELECT IngredientID, sum(quantity_required * CAST(Quantity * 0.25 AS DECIMAL(14,2))) AS quarters
        FROM order_details JOIN recipes USING (ProductID) GROUP BY ALL) USING (IngredientID)"""

ORACLES: dict[str, str] = {
    "typed_scan": """
        SELECT l_orderkey AS BatchID, l_suppkey AS IngredientID, l_orderkey AS PO_ID,
               CAST(l_shipdate AS DATE) AS Receive_date,
               CAST(l_quantity AS BIGINT) AS Quantity_Received
        FROM lineitem""",
    "bulk_append": sql("""
        SELECT 'stock' AS what, IngredientID AS id, Current_stock AS amount FROM stock_after
        UNION ALL
        SELECT 'order', Order_ID,
               CAST(coalesce(total, Total_Amount) AS DECIMAL(20,2))
        FROM orders_t LEFT JOIN (SELECT Order_ID, sum(Line_Total) AS total FROM order_details
                                 GROUP BY Order_ID) USING (Order_ID)"""),
    "bulk_append_rules": sql("""
        SELECT 'Employees' AS what, Employee_ID AS id, CAST(Salary AS DECIMAL(20,2)) AS amount,
               CASE WHEN Salary <= 0 THEN 'salary not positive'
                    WHEN seq > min(CASE WHEN Salary > 0 THEN seq END) OVER (PARTITION BY Employee_ID)
                    THEN 'duplicate key' END AS reason
        FROM (SELECT c_custkey AS seq, c_custkey - c_custkey % 2 AS Employee_ID,
                     CAST(c_acctbal AS DECIMAL(12,2)) AS Salary FROM customer)
        UNION ALL
        SELECT 'Orders', Order_ID - Order_ID % 4, CAST(Total_Amount + Tax_Amount - Discount_Amount AS DECIMAL(20,2)),
               CASE WHEN Order_ID > min(Order_ID) OVER (PARTITION BY Order_ID - Order_ID % 4) THEN 'duplicate key' END
        FROM orders_t"""),
    "table_append": sql("SELECT PO_ID, SupplierID, Total_Amount, Status FROM purchase_order"),
    "named_views": sql(f"""
        SELECT 'vw_CurrentStockLevels' AS view_name, count(*) AS n FROM ({STOCK_LEVELS})
        UNION ALL SELECT 'vw_PendingPurchaseOrders', count(*) FROM pending
        UNION ALL SELECT 'vw_ProductRecipeDetail', count(*) FROM ({RECIPE_DETAIL})
        UNION ALL SELECT 'vw_ActiveProducts', count(*) FROM menu
        UNION ALL SELECT 'vw_OrderSummary', count(*) FROM order_summary
        UNION ALL SELECT 'vw_TopSellingProducts', count(*) FROM ({TOP_SELLING})
        UNION ALL SELECT 'vw_ActiveDeliveries', count(*) FROM on_road
        UNION ALL SELECT 'vw_RiderPerformance', count(*) FROM ({RIDERS})
        UNION ALL SELECT 'vw_EquipmentStatusSummary', count(*) FROM kitchen_equipment
        UNION ALL SELECT 'vw_SalarySummary', 1"""),
    "param_query": sql("""
        SELECT Order_ID, Customer, Order_Date, Final_Total FROM order_summary
        WHERE Final_Total >= 100000 AND PaymentStatus = 'Paid'"""),
    "append_keyed": keyed_verdict(
        """SELECT event_id AS seq, user_id * 40 AS Order_ID, CAST(ts AS DATE) AS Order_Date
           FROM events""",
        "CAST(NULL AS VARCHAR)",
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
        "Order_ID",
        "Order_ID, Order_Date",
    ),
    "upsert_by_key": sql("SELECT * FROM recipes_after"),
    "upsert_without_keys": sql("""
        SELECT * FROM recipes WHERE RecipeID NOT IN (SELECT RecipeID FROM changes WHERE seq % 50 <> 0)
        UNION ALL
        (SELECT RecipeID, ProductID, IngredientID, quantity_required FROM changes WHERE seq % 50 <> 0
        QUALIFY row_number() OVER (PARTITION BY RecipeID ORDER BY seq DESC) = 1)"""),
    "missing_keys": "SELECT event_id AS seq, user_id AS ProductID, 'missing key' AS reason FROM events WHERE event_id % 50 = 0",
    "update_by_key": sql("""
        SELECT Equipment_ID, Equipment_Name, Purchase_Date, Warranty_Expiry,
               coalesce(c.Status, k.Status) AS Status
        FROM kitchen_equipment k LEFT JOIN (
            SELECT user_id * 90 AS Equipment_ID, arg_max(event_type, event_id) AS Status
            FROM events GROUP BY user_id) c USING (Equipment_ID)"""),
    "next_id": sql(
        "SELECT CAST(coalesce(max(Order_Detail_ID), 0) + 1 AS BIGINT) AS NextID FROM order_details"
    ),
    "assign_ids": """
        SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ALL) AS Order_ID,
               l_orderkey, l_partkey, l_suppkey, l_linenumber
        FROM lineitem""".replace(
        "ORDER BY ALL",
        "ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,"
        " l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    ),
    "pk_violations": sql(" UNION ALL ".join(repeated(*k) for k in KEYS)),
    "fk_violations": sql(" UNION ALL ".join(dangling(*r) for r in REFERENCES)),
    "type_violations": sql(
        " UNION ALL ".join(
            [
                # A unit price is that large only where it is the whole line.
                tagged_violations(
                    "Order_Details", "Line_Total", "DECIMAL(8,3)", "Line_Total >= 100000 AND Quantity = 1"
                ).replace("'Line_Total'", "'Unit_Price'"),
                tagged_violations("Order_Details", "Line_Total", "DECIMAL(8,3)", "Line_Total >= 100000"),
                *[tagged_violations(*c, "INT", f"{c[1]} % 1 <> 0") for c in WHOLE],
                *[tagged_violations(*c, "INT", f"TRY_CAST({c[1]} AS BIGINT) IS NULL") for c in NUMBERED],
                *[tagged_violations(*c, "VARCHAR(30)", f"length({c[1]}) > 30") for c in NAMED],
                *[
                    tagged_violations("Orders", c, "DECIMAL(8,2)", f"{c} >= 1000000").replace("FROM orders", "FROM orders_t")
                    for c in ("Total_Amount", "Tax_Amount", "Discount_Amount", "Final_Total")
                ],
                tagged_violations("Products", "Base_Price", "DECIMAL(8,2)", "Base_Price >= 1000000"),
                tagged_violations("Recipes", "quantity_required", "DECIMAL(8,2)", "quantity_required >= 1000000"),
            ]
        )
    ),
    "current_stock_levels": sql(STOCK_LEVELS),
    "pending_purchase_orders": sql("SELECT * FROM pending"),
    "product_recipe_detail": sql(RECIPE_DETAIL),
    "active_products": sql("SELECT * FROM menu"),
    "order_summary": sql("SELECT * FROM order_summary"),
    "top_selling_products": sql(TOP_SELLING),
    "active_deliveries": sql("SELECT * FROM on_road"),
    "rider_performance": sql(RIDERS),
    "equipment_status_summary": sql(f"""
        SELECT Equipment_ID, Equipment_Name, Status, Purchase_Date, Warranty_Expiry,
               CASE WHEN Warranty_Expiry < {AS_OF} THEN 'Expired'
                    WHEN Warranty_Expiry < {AS_OF} + 30 THEN 'Expiring Soon'
                    ELSE 'Valid' END AS WarrantyStatus
        FROM kitchen_equipment"""),
    "salary_summary": sql("""
        SELECT count(*) AS TotalEmployees, CAST(sum(Salary) AS DECIMAL(22,2)) AS TotalMonthlyPayroll,
               CAST(sum(Salary) AS DOUBLE) / count(Salary) AS AverageSalary,
               max(Salary) AS HighestSalary, min(Salary) AS LowestSalary
        FROM employees"""),
    "apply_batch_receipts": sql("""
        SELECT IngredientID, Name, CategoryID, unit_of_measure, Reorder_level,
               CAST(Current_stock + coalesce(received, 0) AS DECIMAL(20,2)) AS Current_stock
        FROM ingredients LEFT JOIN received USING (IngredientID)"""),
    "deduct_ingredients": sql("""
        SELECT IngredientID, Name, CategoryID, unit_of_measure, Reorder_level,
               CAST(Current_stock - coalesce(used, 0) AS DECIMAL(20,2)) AS Current_stock
        FROM ingredients LEFT JOIN used USING (IngredientID)"""),
    "fractional_stock_after": sql(FRACTIONAL_STOCK),
    "stream_fractional_stock": sql(FRACTIONAL_STOCK),
    "order_final_total": sql("""
        SELECT * REPLACE (CAST(Final_Total AS DECIMAL(20,2)) AS Final_Total) FROM orders_t"""),
    "rollup_order_total": sql("""
        SELECT Order_ID, CustomerID, Order_Date,
               CAST(CASE WHEN Order_ID IN (SELECT Order_ID FROM order_details
                                           WHERE l_linestatus = 'O')
                    THEN total ELSE Total_Amount END AS DECIMAL(22,2)) AS Total_Amount,
               Tax_Amount, Discount_Amount, Final_Total
        FROM orders_t LEFT JOIN (SELECT Order_ID, sum(Line_Total) AS total FROM order_details
                                 GROUP BY Order_ID) USING (Order_ID)"""),
    "validate_rider": sql("""
        SELECT seq, seq AS Delivery_ID, Rider_ID, Delivery_Status,
               CASE WHEN Rider_ID IN (SELECT Rider_ID FROM deliveries WHERE Delivery_Status = 0)
                      OR coalesce(bool_or(Delivery_Status = 0) OVER (
                            PARTITION BY Rider_ID ORDER BY seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)
                    THEN 'rider busy' END AS reason
        FROM (SELECT event_id AS seq, user_id * 10 AS Rider_ID,
                     CASE event_type WHEN 'signup' THEN 0 ELSE 1 END AS Delivery_Status
              FROM events WHERE event_type NOT IN ('click', 'view'))"""),
    "stamp_dispatch_time": f"""
        SELECT event_id AS Delivery_ID,
               CASE WHEN event_type IN ('click', 'view') THEN {NOW} ELSE props END AS Dispatch_Time
        FROM events""",
    "validate_salary": sql("""
        SELECT Employee_ID, Salary,
               CASE WHEN Salary <= 0 THEN 'salary not positive' END AS reason
        FROM employees"""),
    "place_purchase_order": keyed_verdict(
        """SELECT event_id AS seq, event_id - event_id % 2 AS PO_ID, user_id AS SupplierID,
                  CAST(ts AS DATE) AS Order_date, CAST(ts AS DATE) + 7 AS Exp_deleivey_date,
                  CAST(value * 100 AS DECIMAL(12,2)) AS Total_Amount, 'Pending' AS Status
           FROM events""",
        """CASE WHEN SupplierID NOT IN (SELECT SupplierID FROM suppliers)
                THEN 'supplier not found' END""",
        "SELECT PO_ID FROM purchase_order WHERE Status = 'Delivered'",
        "PO_ID",
        "PO_ID, SupplierID, Order_date, Exp_deleivey_date, Total_Amount, Status",
    ),
    "receive_batch": BATCH_VERDICT,
    "receive_into_stock_after": f"""
        SELECT s_suppkey AS IngredientID,
               CAST(CAST(s_acctbal AS DECIMAL(12,2)) + coalesce(received, 0) AS DECIMAL(20,2))
                   AS Current_stock
        FROM supplier LEFT JOIN (SELECT IngredientID, sum(Quantity_Received) AS received
                                 FROM ({BATCH_VERDICT}) WHERE reason IS NULL GROUP BY IngredientID)
          ON s_suppkey = IngredientID""",
    "add_recipe_ingredient": keyed_verdict(
        """SELECT event_id AS seq, event_id - event_id % 2 AS RecipeID, user_id * 14 AS ProductID,
                  CAST(floor(value) AS BIGINT) AS IngredientID,
                  CAST(CAST(value AS DECIMAL(12,2)) * 0.1 AS DECIMAL(8,2)) AS quantity_required
           FROM events""",
        """CASE WHEN ProductID NOT IN (SELECT ProductID FROM products) THEN 'product not found'
                WHEN IngredientID NOT IN (SELECT IngredientID FROM ingredients)
                THEN 'ingredient not found' END""",
        "SELECT RecipeID FROM recipes",
        "RecipeID",
        "RecipeID, ProductID, IngredientID, quantity_required",
    ),
    "check_feasibility": sql("SELECT * FROM feasibility"),
    "feasibility_verdict": sql("""
        SELECT ProductID, Quantity, bool_and(IsFeasible = 'Yes') AS CanMake
        FROM feasibility GROUP BY ProductID, Quantity"""),
    "place_order": keyed_verdict(
        """SELECT event_id AS seq, (event_id - event_id % 2) * 2 AS Order_ID,
                  user_id * 11 AS CustomerID, CAST(ts AS DATE) AS Order_Date,
                  CAST(0 AS DECIMAL(8,2)) AS Total_Amount,
                  CAST(value AS DECIMAL(12,2)) AS Tax_Amount,
                  CAST(floor(value) AS DECIMAL(12,2)) AS Discount_Amount,
                  CAST(CAST(value AS DECIMAL(12,2)) - CAST(floor(value) AS DECIMAL(12,2))
                       AS DECIMAL(20,2)) AS Final_Total
           FROM events""",
        """CASE WHEN CustomerID NOT IN (SELECT CustomerID FROM customers)
                THEN 'customer not found' END""",
        "SELECT Order_ID FROM orders_t",
        "Order_ID",
        "Order_ID, CustomerID, Order_Date, Total_Amount, Tax_Amount, Discount_Amount, Final_Total",
    ),
    "add_order_line": sql("""
        SELECT seq,
               CASE WHEN m.ProductID IS NOT NULL THEN
                   (SELECT max(Order_Detail_ID) FROM order_details)
                   + count(m.ProductID) OVER (ORDER BY seq) END AS Order_Detail_ID,
               Order_ID, c.ProductID, Quantity, Base_Price AS Unit_Price,
               CAST(Base_Price * Quantity AS DECIMAL(20,2)) AS Line_Total,
               CASE WHEN m.ProductID IS NULL THEN 'product not on the menu' END AS reason
        FROM (SELECT event_id AS seq, event_id AS Order_ID, user_id * 14 AS ProductID,
                     CAST(floor(value) + 1 AS INTEGER) AS Quantity FROM events) c
        LEFT JOIN menu m ON c.ProductID = m.ProductID"""),
    "order_lines_after": sql("""
        SELECT 'stock' AS what, IngredientID AS id,
               CAST(Current_stock - coalesce(used, 0) AS DECIMAL(20,2)) AS amount
        FROM ingredients LEFT JOIN (
            SELECT IngredientID, sum(quantity_required * Quantity) AS used
            FROM added JOIN recipes USING (ProductID) GROUP BY ALL) USING (IngredientID)
        UNION ALL
        SELECT 'order', Order_ID, CAST(coalesce(total, Total_Amount) AS DECIMAL(20,2))
        FROM orders_t LEFT JOIN (
            SELECT Order_ID, sum(Line_Total) AS total
            FROM (SELECT Order_ID, Line_Total FROM order_details
                  UNION ALL SELECT Order_ID, Line_Total FROM added)
            WHERE Order_ID IN (SELECT Order_ID FROM added) GROUP BY ALL) USING (Order_ID)"""),
    "process_payment": keyed_verdict(
        """SELECT event_id AS seq, event_id AS Payment_ID,
                  (event_id - event_id % 2) * 2 AS Order_ID, CAST(ts AS DATE) AS Payment_Date,
                  CAST(value * 5000 AS DECIMAL(12,2)) AS Amount_Paid, 1 AS Payment_Status
           FROM events""",
        """CASE WHEN Order_ID NOT IN (SELECT Order_ID FROM orders_t) THEN 'order not found'
                WHEN Amount_Paid < (SELECT Final_Total FROM orders_t o
                                    WHERE o.Order_ID = cmd.Order_ID)
                THEN 'underpayment' END""",
        "SELECT Payment_ID FROM payments",
        "Payment_ID",
        "Payment_ID, Order_ID, Payment_Date, Amount_Paid, Payment_Status",
    ),
    "assign_delivery": sql(f"""
        SELECT seq, Delivery_ID, Order_ID, Rider_ID, {NOW} AS Dispatch_Time,
               CASE WHEN why IS NOT NULL THEN why
                    WHEN busy OR seq > min(seq) FILTER (why IS NULL AND NOT busy AND NOT taken)
                                       OVER (PARTITION BY Rider_ID) THEN 'rider busy'
                    WHEN taken THEN 'duplicate key' END AS reason
        FROM (SELECT *,
                     CASE WHEN Order_ID NOT IN (SELECT Order_ID FROM orders_t)
                          THEN 'order not found'
                          WHEN Rider_ID NOT IN (SELECT Rider_ID FROM delivery_riders)
                          THEN 'rider not found' END AS why,
                     Rider_ID IN (SELECT Rider_ID FROM deliveries WHERE Delivery_Status = 0)
                         AS busy,
                     Delivery_ID IN (SELECT Delivery_ID FROM deliveries) AS taken
              FROM (SELECT event_id AS seq, event_id AS Delivery_ID, event_id * 2 AS Order_ID,
                           CAST(floor(value) * 15 AS BIGINT) AS Rider_ID FROM events))"""),
    "complete_delivery": sql(f"""
        SELECT Delivery_ID, Order_ID, Rider_ID, AddressID, Dispatch_Time,
               CASE WHEN done IS NOT NULL THEN {NOW} ELSE Delivery_Time END AS Delivery_Time,
               CASE WHEN done IS NOT NULL THEN 1 ELSE Delivery_Status END AS Delivery_Status
        FROM deliveries LEFT JOIN (SELECT event_id + 1 AS done FROM events
                                   WHERE event_type = 'purchase') ON done = Delivery_ID"""),
    "hire_employee": keyed_verdict(
        f"""SELECT c_custkey AS seq, c_custkey - c_custkey % 2 AS Employee_ID,
                   c_name AS First_Name,
                   CASE c_mktsegment WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END AS Last_Name,
                   {AS_OF} AS Hire_Date, '0300' AS Phone,
                   CAST(c_acctbal AS DECIMAL(12,2)) AS Salary
            FROM customer""",
        """CASE WHEN First_Name = '' THEN 'blank first name'
                WHEN Last_Name = '' THEN 'blank last name'
                WHEN Salary <= 0 THEN 'salary not positive' END""",
        "SELECT s_suppkey FROM supplier",
        "Employee_ID",
        "Employee_ID, First_Name, Last_Name, Hire_Date, Phone, Salary",
    ),
    "update_equipment_status": EQUIPMENT_COMMANDS,
    "equipment_after_update": sql(f"""
        SELECT Equipment_ID, Equipment_Name, Purchase_Date, Warranty_Expiry,
               coalesce(c.Status, k.Status) AS Status
        FROM kitchen_equipment k LEFT JOIN (
            SELECT Equipment_ID, Status FROM ({EQUIPMENT_COMMANDS}) WHERE reason IS NULL) c
            USING (Equipment_ID)"""),
    "customer_lookup": sql("SELECT CustomerID, First_Name || ' ' || Last_Name AS Name FROM customers"),
    "product_lookup": sql("SELECT ProductID, Product AS Name, Base_Price FROM menu"),
    "product_lookup_names": sql("SELECT ProductID, Product AS Name FROM menu"),
    "order_ids_desc": sql("SELECT Order_ID FROM orders_t ORDER BY Order_ID DESC"),
    "supplier_lookup": sql("SELECT SupplierID, Name FROM suppliers ORDER BY SupplierID"),
    "ingredient_lookup": sql("SELECT IngredientID, Name FROM ingredients ORDER BY IngredientID"),
    "rider_lookup": sql("SELECT Rider_ID, First_Name || ' ' || Last_Name AS Name FROM delivery_riders"),
    "active_delivery_ids": sql(
        "SELECT Delivery_ID FROM deliveries WHERE Delivery_Status = 0 ORDER BY Delivery_ID"
    ),
    "equipment_lookup": sql(
        "SELECT Equipment_ID, Equipment_Name FROM kitchen_equipment ORDER BY Equipment_ID"
    ),
    "order_total_point": sql("SELECT Final_Total FROM orders_t WHERE Order_ID = 101"),
    "recent_orders": sql("""
        SELECT * FROM order_summary
        ORDER BY Order_Date DESC, Order_ID DESC, PaymentStatus LIMIT 10"""),
    "label_format": sql("""
        SELECT ProductID || ' — ' || Product AS label,
               ProductID || ' — ' || Product || '  (Rs. ' || Base_Price || ')' AS priced_label
        FROM menu"""),
    "label_parse": sql("""
        SELECT CustomerID || ' — ' || First_Name || ' ' || Last_Name AS label, CustomerID AS id
        FROM customers"""),
    "stream_stock_ledger": sql("SELECT IngredientID, Current_stock FROM stock_after"),
    "stream_order_totals": sql("""
        SELECT Order_ID, CAST(sum(Line_Total) AS DECIMAL(22,2)) AS Total_Amount
        FROM order_details GROUP BY Order_ID"""),
    # Each rider's events one after the other, carrying the open delivery.
    "stream_dispatch": """
        WITH RECURSIVE board AS (
            SELECT event_id AS seq, event_type = 'view' AS starts,
                   user_id * 2 + event_id % 2 AS Delivery_ID, user_id AS Rider_ID,
                   row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
            FROM events WHERE event_type IN ('view', 'click')),
        walk AS (
            SELECT seq, starts, Delivery_ID, Rider_ID, n, TRUE AS free,
                   CASE WHEN starts THEN Delivery_ID END AS open_id
            FROM board WHERE n = 1
            UNION ALL
            SELECT b.seq, b.starts, b.Delivery_ID, b.Rider_ID, b.n, w.open_id IS NULL,
                   CASE WHEN b.starts THEN coalesce(w.open_id, b.Delivery_ID)
                        WHEN b.Delivery_ID = w.open_id THEN NULL
                        ELSE w.open_id END
            FROM walk w JOIN board b ON b.Rider_ID = w.Rider_ID AND b.n = w.n + 1)
        SELECT seq, Delivery_ID, Rider_ID, CASE WHEN NOT free THEN 'rider busy' END AS reason
        FROM walk WHERE starts""",
    "stream_validated_append": keyed_verdict(
        """SELECT c_custkey AS seq, c_custkey - c_custkey % 2 AS Employee_ID,
                  CAST(c_acctbal AS DECIMAL(12,2)) AS Salary
           FROM customer""",
        "CASE WHEN Salary <= 0 THEN 'salary not positive' END",
        "SELECT s_suppkey FROM supplier",
        "Employee_ID",
        "Employee_ID, Salary",
    ),
    "stream_upsert": sql("SELECT * FROM recipes_after"),
}
# The same results in other ways: from keyed state, from buckets, from a run that is repeated.
ORACLES |= {
    "stream_dispatch_keyed": ORACLES["stream_dispatch"],
    "stream_validated_append_keyed": ORACLES["stream_validated_append"],
    "append_to_buckets": ORACLES["append_keyed"],
    "append_twice": ORACLES["table_append"],
    "bulk_append_deliveries": """
        WITH every AS (
            SELECT event_id AS seq, event_id AS Delivery_ID, CASE WHEN event_id % 11 <> 0 THEN user_id END AS Rider_ID,
                CASE event_id % 3 WHEN 2 THEN 'noon' ELSE '2026-04-01 10:00:00' END AS Dispatch_Time,
                CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 END AS Delivery_Status FROM events),
        held AS (SELECT Delivery_ID, Rider_ID, 't' AS Dispatch_Time, CASE WHEN Rider_ID % 7 = 0 THEN 0 ELSE 1 END AS Delivery_Status FROM every WHERE seq % 10 = 0),
        busy AS (SELECT DISTINCT Rider_ID FROM held WHERE Delivery_Status = 0 AND Rider_ID IS NOT NULL),
        fresh AS (SELECT *, seq % 20 = 0 AS taken FROM every WHERE seq % 10 <> 0 OR seq % 20 = 0),
        opened AS (
            SELECT Rider_ID, min(seq) AS since FROM fresh
            WHERE Delivery_Status = 0 AND NOT taken AND Rider_ID NOT IN (SELECT Rider_ID FROM busy) GROUP BY Rider_ID)
        SELECT *, CAST(NULL AS VARCHAR) AS reason FROM held
        UNION ALL
        SELECT Delivery_ID, Rider_ID, Dispatch_Time, Delivery_Status,
            CASE WHEN Rider_ID IN (SELECT Rider_ID FROM busy) OR seq > since THEN 'rider busy' WHEN taken THEN 'duplicate key' END
        FROM fresh LEFT JOIN opened USING (Rider_ID)""",
    "bulk_append_plain": sql(" UNION ALL ".join(
        f"""SELECT '{table}' AS what, CAST({key} AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS reason FROM {source}
            UNION ALL SELECT '{table}', CAST({key} AS VARCHAR), 'duplicate key' FROM {source}
            WHERE {f"length({key})" if table == "Product_categories" else key} % 10 = 0"""
        for table, source, key in KEYS if table not in ("Batches", "Order_Details", "Orders", "Employees", "Deliveries"))),
    "next_id_from_footers": "SELECT CAST(coalesce(max(l_orderkey), 0) + 1 AS BIGINT) AS NextID FROM lineitem",
    "quarantine": sql("""
        SELECT 'kept' AS what, CAST(PO_ID AS VARCHAR) AS detail, CAST(1 AS BIGINT) AS n FROM purchase_order WHERE PO_ID % 50 <> 0
        UNION ALL
        SELECT 'refused', 'Total_Amount INT', count(*) FROM purchase_order WHERE PO_ID % 50 = 0"""),
}
