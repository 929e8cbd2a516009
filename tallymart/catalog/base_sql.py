"""The star tables as retail tables, for the SQL side of the checks."""

KEPT = """
kept AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_shipdate AS DATE) AS line_ship_date,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(12,4)) AS sales,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_discount AS DECIMAL(5,4)) AS discount,
         CAST(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice
              AS DECIMAL(12,4)) AS profit,
         CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS ship_mode,
         o_custkey AS customer_id, c_nationkey AS location_id,
         p_name AS product_name, p_brand AS subcategory_name, p_type AS category_name,
         c_name AS customer_name, c_mktsegment AS segment,
         l_linenumber, l_suppkey, l_extendedprice, l_tax, l_returnflag, l_linestatus
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)
),
numbered AS (
  SELECT *, row_number() OVER (
    ORDER BY order_id, l_linenumber, product_id, l_suppkey, quantity, l_extendedprice, discount,
             l_tax, l_returnflag, l_linestatus, line_ship_date) AS sales_id
  FROM kept
)"""

TABLES = """
t_regions AS (SELECT r_regionkey AS region_id, r_name AS region_name FROM region),
t_locations AS (
  SELECT n_nationkey AS location_id, n_name AS city, n_name AS state,
         'UNKNOWN' AS postal_code, n_regionkey AS region_id FROM nation),
t_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment
  FROM customer),
t_categories AS (
  SELECT CAST(row_number() OVER (ORDER BY category_name) AS INTEGER) AS category_id, category_name
  FROM (SELECT DISTINCT p_type AS category_name FROM part) AS c),
t_sub_categories AS (
  SELECT CAST(row_number() OVER (ORDER BY b.category_name, b.subcategory_name) AS INTEGER)
           AS subcategory_id,
         b.subcategory_name, c.category_id, b.category_name
  FROM (SELECT DISTINCT p_brand AS subcategory_name, p_type AS category_name FROM part) AS b
  JOIN t_categories AS c ON b.category_name = c.category_name),
t_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, s.subcategory_id
  FROM part JOIN t_sub_categories AS s
    ON p_brand = s.subcategory_name AND p_type = s.category_name),
t_orders AS (
  SELECT order_id, order_date, MIN(line_ship_date) AS ship_date, ship_mode, customer_id,
         location_id
  FROM kept GROUP BY order_id, order_date, ship_mode, customer_id, location_id),
t_sales AS (
  SELECT sales_id, order_id, product_id, sales, quantity, discount, profit FROM numbered)"""

FLAT = """
flat AS (
  SELECT k.*, n_name AS city, n_name AS state, r_name AS region_name,
         CAST(year(order_date) AS INTEGER) AS order_year,
         CAST(date_trunc('month', order_date) AS DATE) AS order_month,
         CAST(profit AS DOUBLE) / NULLIF(CAST(sales AS DOUBLE), 0) AS profit_margin
  FROM kept AS k
  JOIN nation ON location_id = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def flat(query: str, *ctes: str) -> str:
    """A query over ``flat``, after further CTEs."""
    return "WITH RECURSIVE " + ",".join([KEPT, FLAT, *[f"\n{c}" for c in ctes]]) + "\n" + query


def tables(query: str, *ctes: str) -> str:
    """A query over the eight ``t_`` tables, after further CTEs."""
    return "WITH " + ",".join([KEPT, TABLES, *[f"\n{c}" for c in ctes]]) + "\n" + query


def money(expression: str, places: int = 2) -> str:
    return f"CAST(ROUND({expression}, {places}) AS DOUBLE)"


def pct(top: str, bottom: str, places: int = 2) -> str:
    return f"ROUND(CAST({top} AS DOUBLE) / NULLIF(CAST({bottom} AS DOUBLE), 0) * 100, {places})"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"
