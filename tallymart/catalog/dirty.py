"""Raw order lines for the cleaning checks, in Spark and in SQL.

Every line item becomes a text row of the raw file; its tax rate decides what is
wrong with it (fixed values below), so each rule has work on the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from tallymart.plans.ordered import OrderedBlocks
from tallymart.session import slice_of, slices_of, stash
from tallymart.sources.raw_csv import standard_name
from tallymart.schema import RAW_COLUMNS
from tallymart.sources.star import StarMart

# Tax in percent -> what is wrong with the row.
ODD, DUPLICATED, NO_POSTAL, BAD_DATE, ZERO, TOO_CHEAP, FRACTION = 1, 3, 4, 5, 6, 7, 8
# Line number modulo 6 of an odd row -> which of its fields is odd.
TEXT_ID, POINT_ID, NO_ID, HALF_STEP, SUFFIXED, TOO_LARGE = 0, 1, 2, 3, 4, 5

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

NAMES = tuple(standard_name(c) for c in RAW_COLUMNS)


def _lines_before(lines: DataFrame) -> DataFrame:
    """How many lines the orders before each order have. Only the orders' sizes are put in order."""
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_size"))
    return OrderedBlocks(sizes, "l_orderkey").running_sums(_end="_size").select(
        "l_orderkey", (F.col("_end") - F.col("_size")).alias("_before"))


def _numbered(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Line items numbered 1..n by all of their columns, ``n``.

    The order begins with the order's key, so a line's number is its place among the lines of
    its order after those of the orders before. The lines stay where the join with their orders
    needs them. Lines of no order count, but join with none.
    """
    before = _lines_before(lines) if before is None else before
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE[1:]))
    placed = lines.where("l_orderkey IS NOT NULL").withColumn("_place", place)
    return placed.join(before, "l_orderkey").withColumn("n", F.col("_before") + F.col("_place"))


def raw_text(m: StarMart) -> DataFrame:
    """The raw rows, already under standard names."""
    lines = m.raw("lineitem").select(*_LINE)
    return _text(m, m.raw("orders"), _numbered(lines))


def raw_slices(m: StarMart) -> Iterator[DataFrame]:
    """The rows of ``raw_text``, some orders at a time, for writers that need no more at once."""
    lines = m.raw("lineitem").select(*_LINE)
    slices = slices_of(m.raw("lineitem"))
    if slices == 1:
        yield raw_text(m)
        return
    before = stash(_lines_before(lines), "lines-before", "zstd")
    for i in range(slices):
        own = slice_of(slices, F.col("l_orderkey").cast("bigint")) == i
        ordered = m.raw("orders").where(slice_of(slices, F.col("o_orderkey").cast("bigint")) == i)
        yield _text(m, ordered, _numbered(lines.where(own), before.where(own)))


def _text(m: StarMart, ordered: DataFrame, numbered: DataFrame) -> DataFrame:
    # Customers meet their orders before the lines do: lines are many more.
    orders = (
        ordered.join(m.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(m.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(m.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")))
    joined = (
        numbered.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(m.raw("part"), F.col("l_partkey") == F.col("p_partkey")))
    tax = F.round(F.col("l_tax") * 100).cast("int")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    padded = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("  "), "c_name", F.lit("\t")))
    discount = F.col("l_discount").cast("decimal(5,4)")
    odd = F.when(tax == ODD, F.col("l_linenumber") % 6)
    number = (2 * F.col("n") + F.col("copy")).cast("string")
    columns = {
        "row_id": F.when(odd == TEXT_ID, F.concat(F.lit("R"), number))
        .when(odd == POINT_ID, F.concat(number, F.lit(".0"))).when(odd == NO_ID, None).otherwise(number),
        "order_id": F.col("o_orderkey").cast("string"),
        "order_date": F.when(tax == BAD_DATE, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")),
        "ship_date": F.date_format("l_shipdate", "MM/dd/yyyy"),
        "ship_mode": F.col("o_orderpriority"),
        "customer_id": F.col("c_custkey").cast("string"),
        "customer_name": F.coalesce(padded, F.col("c_name")),
        "segment": F.col("c_mktsegment"),
        "country": F.lit("World"),
        "city": F.col("n_name"),
        "state": F.col("n_name"),
        "postal_code": F.when(tax == NO_POSTAL, "").otherwise(
            F.lpad(F.col("n_nationkey").cast("string"), 5, "0")),
        "region": F.col("r_name"),
        "product_id": F.col("p_partkey").cast("string"),
        "category": F.col("p_type"),
        "sub_category": F.col("p_brand"),
        "product_name": F.col("p_name"),
        "sales": F.when(odd == TOO_LARGE, "100000000").otherwise(
            price.cast("decimal(12,4)").cast("string")),
        # A row whose id cannot be used is dropped as well: the tables need no order for it.
        "quantity": F.when((tax == ZERO) | odd.isin(TEXT_ID, NO_ID), "0").otherwise(F.concat(
            F.col("l_quantity").cast("int").cast("string"),
            F.when(tax == FRACTION, ".5").otherwise(""))),
        "discount": F.when(odd == HALF_STEP, "1.00004")
        .when(odd == SUFFIXED, F.concat(discount.cast("string"), F.lit("d")))
        .when(tax == TOO_CHEAP, (discount + 1).cast("decimal(5,4)").cast("string"))
        .otherwise(discount.cast("string")),
        "profit": (price - F.col("l_quantity") * F.col("p_retailprice"))
        .cast("decimal(12,4)").cast("string"),
    }
    copies = F.when(tax == DUPLICATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return joined.withColumn("copy", F.explode(copies)).select(
        *[columns[name].alias(name) for name in NAMES])


RAW_SQL = f"""
lines AS (
  SELECT *, CAST(ROUND(l_tax * 100) AS INTEGER) AS tax,
         CASE WHEN CAST(ROUND(l_tax * 100) AS INTEGER) = {ODD} THEN l_linenumber % 6 END AS odd,
         row_number() OVER (ORDER BY {", ".join(_LINE)}) AS n
  FROM lineitem),
raw AS (
  SELECT CASE WHEN odd = {TEXT_ID} THEN 'R' || CAST(2 * n + copy AS VARCHAR)
              WHEN odd = {POINT_ID} THEN CAST(2 * n + copy AS VARCHAR) || '.0'
              WHEN odd = {NO_ID} THEN NULL ELSE CAST(2 * n + copy AS VARCHAR) END AS row_id,
    CAST(o_orderkey AS VARCHAR) AS order_id,
    CASE WHEN tax = {BAD_DATE} THEN strftime(o_orderdate, '%Y-%m-%d')
         ELSE strftime(o_orderdate, '%m/%d/%Y') END AS order_date,
    strftime(l_shipdate, '%m/%d/%Y') AS ship_date, o_orderpriority AS ship_mode,
    CAST(c_custkey AS VARCHAR) AS customer_id,
    CASE WHEN l_returnflag = 'R' THEN '  ' || c_name || chr(9) ELSE c_name END AS customer_name,
    c_mktsegment AS segment, 'World' AS country, n_name AS city, n_name AS state,
    CASE WHEN tax = {NO_POSTAL} THEN NULL
         ELSE lpad(CAST(n_nationkey AS VARCHAR), 5, '0') END AS postal_code,
    r_name AS region, CAST(p_partkey AS VARCHAR) AS product_id, p_type AS category,
    p_brand AS sub_category, p_name AS product_name,
    CASE WHEN odd = {TOO_LARGE} THEN '100000000'
         ELSE CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(12,4)) AS VARCHAR) END AS sales,
    CASE WHEN tax = {ZERO} OR odd IN ({TEXT_ID}, {NO_ID}) THEN '0' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
      || CASE WHEN tax = {FRACTION} THEN '.5' ELSE '' END END AS quantity,
    CASE WHEN odd = {HALF_STEP} THEN '1.00004'
         WHEN odd = {SUFFIXED} THEN CAST(CAST(l_discount AS DECIMAL(5,4)) AS VARCHAR) || 'd'
         ELSE CAST(CAST(l_discount AS DECIMAL(5,4)) + CASE WHEN tax = {TOO_CHEAP} THEN 1 ELSE 0 END
                   AS VARCHAR) END AS discount,
    CAST(CAST(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice
              AS DECIMAL(12,4)) AS VARCHAR) AS profit
  FROM lines
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN (VALUES (0), (1)) AS copies(copy) ON copy = 0 OR tax = {DUPLICATED})"""

_BUSINESS = ", ".join(n for n in NAMES if n != "row_id")

CLEAN_SQL = f"""
stripped AS (SELECT * REPLACE (trim(customer_name, ' ' || chr(9)) AS customer_name) FROM raw),
merged AS (
  SELECT MIN(CAST(TRY_CAST(row_id AS DOUBLE) AS BIGINT)) AS row_id, {_BUSINESS}, COUNT(*) - 1 AS extra_copies
  FROM stripped GROUP BY {_BUSINESS}),
typed AS (
  SELECT * REPLACE (
    CAST(try_strptime(order_date, '%m/%d/%Y') AS DATE) AS order_date,
    CAST(try_strptime(ship_date, '%m/%d/%Y') AS DATE) AS ship_date,
    TRY_CAST(sales AS DECIMAL(12,4)) AS sales, TRY_CAST(profit AS DECIMAL(12,4)) AS profit,
    TRY_CAST(discount AS DECIMAL(5,4)) AS discount,
    CASE WHEN TRY_CAST(quantity AS DOUBLE) % 1 = 0 THEN CAST(TRY_CAST(quantity AS DOUBLE) AS INTEGER)
      END AS quantity,
    COALESCE(postal_code, 'UNKNOWN') AS postal_code),
    TRY_CAST(discount AS DOUBLE) AS discount_written, TRY_CAST(sales AS DOUBLE) AS sales_written
  FROM merged),
tagged AS (
  SELECT *, CASE
      WHEN order_date IS NULL OR ship_date IS NULL OR sales_written IS NULL OR quantity IS NULL
           OR customer_id IS NULL OR product_id IS NULL THEN 'missing critical field'
      WHEN ship_date < order_date THEN 'ship_date < order_date'
      WHEN discount_written IS NULL OR discount_written NOT BETWEEN 0 AND 1
        THEN 'discount outside [0, 1]'
      WHEN quantity <= 0 THEN 'quantity not positive'
      WHEN sales IS NULL THEN 'out of range' END AS broken_rule
  FROM typed),
cleaned AS (SELECT * EXCLUDE (broken_rule, extra_copies, discount_written, sales_written) FROM tagged WHERE broken_rule IS NULL)"""

NORMAL_SQL = """
n_regions AS (
  SELECT CAST(row_number() OVER (ORDER BY MIN(row_id)) AS INTEGER) AS region_id,
         region AS region_name FROM cleaned GROUP BY region),
n_locations AS (
  SELECT CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS location_id,
         city, state, postal_code, region_id
  FROM (SELECT city, state, postal_code, region, MIN(row_id) AS first FROM cleaned GROUP BY ALL)
  JOIN n_regions ON region = region_name),
n_categories AS (
  SELECT CAST(row_number() OVER (ORDER BY MIN(row_id)) AS INTEGER) AS category_id,
         category AS category_name FROM cleaned GROUP BY category),
n_sub_categories AS (
  SELECT CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS subcategory_id,
         sub_category AS subcategory_name, category_id
  FROM (SELECT sub_category, category, MIN(row_id) AS first FROM cleaned GROUP BY ALL)
  JOIN n_categories ON category = category_name),
n_customers AS (
  SELECT customer_id, customer_name, segment FROM cleaned
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY row_id) = 1),
n_products AS (
  SELECT product_id, product_name, subcategory_id
  FROM (SELECT * FROM cleaned
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY row_id) = 1) AS f
  JOIN n_categories ON category = category_name
  JOIN n_sub_categories AS s
    ON sub_category = subcategory_name AND s.category_id = n_categories.category_id),
n_orders AS (
  SELECT order_id, order_date, ship_date, ship_mode, customer_id, location_id
  FROM (SELECT * FROM cleaned
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY row_id) = 1) AS f
  JOIN n_regions ON region = region_name
  JOIN n_locations AS l ON f.city = l.city AND f.state = l.state
    AND f.postal_code = l.postal_code AND l.region_id = n_regions.region_id),
n_sales AS (
  SELECT row_number() OVER (ORDER BY row_id) AS sales_id, order_id, product_id, sales, quantity,
         discount, profit FROM cleaned)"""


def dirty(query: str, *more: str) -> str:
    return "WITH " + ",".join([RAW_SQL, CLEAN_SQL, NORMAL_SQL, *more]) + "\n" + query
