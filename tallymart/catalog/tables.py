"""Cleaning, normalisation, integrity, sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallymart import sinks
from tallymart.catalog.base_sql import tables
from tallymart.catalog.charts import FILTER, PASSES, _filtered
from tallymart.catalog.base_sql import flat
from tallymart.catalog.dirty import NAMES, dirty, raw_slices, raw_text
from tallymart.operators import clean, normalize, quality
from tallymart.operators.mart import Mart
from tallymart.operators.view import filter_view
from tallymart.schema import FOREIGN_KEYS, LOAD_ORDER, PRIMARY_KEYS, RAW_COLUMNS, TABLES, UNIQUE_KEYS
from tallymart.session import new_scratch_path, scratch_scope, stash, stash_in_turn, write_in_turn
from tallymart.sources.raw_csv import load_raw, standardize_column_names
from tallymart.sources.star import StarMart
from tallymart.sources.tables import catalog_tables, first_available, load_by_year, load_tables


def _as_read(text: DataFrame) -> DataFrame:
    """Missing tokens as NULL, as the CSV reader gives them."""
    return text.withColumn("postal_code", F.when(F.col("postal_code") != "", F.col("postal_code")))


def _raw(m: StarMart) -> DataFrame:
    """Raw rows with missing tokens as NULL."""
    return _as_read(raw_text(m))


def _raw_file(m: StarMart) -> str:
    """The raw rows as a CSV file under the original header, a compressed part a task."""
    path = new_scratch_path(m.raw("region").sparkSession, "raw-csv")
    write_in_turn(
        (rows.toDF(*RAW_COLUMNS) for rows in raw_slices(m)), path, "csv",
        header=True, escape='"', encoding="ISO-8859-1", ignoreTrailingWhiteSpace=False,
        ignoreLeadingWhiteSpace=False, compression="gzip")
    return path


def _read_back(m: StarMart) -> DataFrame:
    return load_raw(m.raw("region").sparkSession, _raw_file(m))


def _cleaned(m: StarMart) -> DataFrame:
    return stash(clean.clean(_raw(m)), "cleaned")


def _without_copies(m: StarMart) -> DataFrame:
    """CLN1 and CLN2, a slice of the rows at a time."""
    spark = m.raw("region").sparkSession
    with scratch_scope(spark, keep="merged"):
        stripped = (clean.strip_strings(_as_read(rows)) for rows in raw_slices(m))
        merged = map(clean.drop_duplicates, clean.copies_together(spark, stripped, "stripped"))
        return stash_in_turn(spark, merged, "merged")


def _locations(lines: DataFrame) -> DataFrame:
    return normalize.locations(lines, normalize.regions(lines))


def _sub_categories(lines: DataFrame) -> DataFrame:
    """Both tables of names need no more of the lines than the first row of each pair."""
    pairs = stash(normalize.first_rows(lines, "sub_category", "category"), "pairs")
    return normalize.sub_categories(pairs, normalize.categories(pairs))


def _products(lines: DataFrame) -> DataFrame:
    category_table = normalize.categories(lines)
    return normalize.products(
        lines, normalize.sub_categories(lines, category_table), category_table)


def _orders(lines: DataFrame) -> DataFrame:
    region_table = normalize.regions(lines)
    return normalize.orders(lines, normalize.locations(lines, region_table), region_table)


def _all_lines(m: StarMart) -> Mart:
    """The eight tables with the sales of every line item, dropped ones included."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    kept = m.normalised().tables
    every_line = m.raw("lineitem").select(
        F.lit(None).cast("bigint").alias("sales_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"), price.cast("decimal(12,4)").alias("sales"),
        (F.col("l_quantity") - 25).cast("int").alias("quantity"),
        (F.col("l_discount") - F.col("l_tax")).cast("decimal(5,4)").alias("discount"),
        F.when(F.col("l_returnflag") != "A", price.cast("decimal(12,4)")).alias("profit"))
    late = m.raw("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("d"))
    early = m.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min("l_shipdate").cast("date").alias("shipped"))
    orders = kept["orders"].drop("ship_date", "order_date").join(late, "order_id").join(
        early, "order_id").withColumnsRenamed({"d": "order_date", "shipped": "ship_date"})
    part = m.raw("part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("product_id"))
    return Mart({**kept, "sales": every_line, "orders": orders,
                 "products": kept["products"].join(part, "product_id", "left_semi")})


EVERY_LINE = """every_line AS (
  SELECT CAST(NULL AS BIGINT) AS sales_id, l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(12,4)) AS sales,
         CAST(l_quantity - 25 AS INTEGER) AS quantity,
         CAST(l_discount - l_tax AS DECIMAL(5,4)) AS discount,
         CASE WHEN l_returnflag <> 'A'
           THEN CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(12,4)) END AS profit
  FROM lineitem),
earliest AS (
  SELECT o.* REPLACE (s.shipped AS ship_date)
  FROM t_orders AS o JOIN (
    SELECT l_orderkey, CAST(MIN(l_shipdate) AS DATE) AS shipped FROM lineitem GROUP BY 1) AS s
    ON order_id = l_orderkey),
fewer_products AS (
  SELECT p.* FROM t_products AS p JOIN part ON product_id = p_partkey WHERE p_type <> 'PROMO')"""


def _ri_sql(**renamed: str) -> str:
    parts = []
    for child, key, parent in FOREIGN_KEYS:
        orphans = f"""SELECT DISTINCT {key} AS k FROM {renamed.get(child, "t_" + child)}
            WHERE {key} NOT IN (SELECT {key} FROM {renamed.get(parent, "t_" + parent)})"""
        parts.append(f"""
        SELECT '{child}.{key}' AS foreign_key, (SELECT COUNT(*) FROM ({orphans}) AS o) AS orphans,
               COALESCE((SELECT string_agg(CAST(k AS VARCHAR), ', ' ORDER BY k)
                 FROM ({orphans} ORDER BY k LIMIT 5) AS s), '') AS samples""")
    return tables(" UNION ALL ".join(parts), EVERY_LINE)


_UNIQUE = [*((t, k, 1) for t, k in PRIMARY_KEYS.items()),
           *((t, ", ".join(columns), 0) for t, columns in UNIQUE_KEYS.items())]


def _unique_sql(**renamed: str) -> str:
    return tables(" UNION ALL ".join(f"""
        SELECT '{t}' AS table_name, '{"primary key" if primary else "unique"}' AS kind,
               '{keys}' AS key_columns, COUNT(*) FILTER (WHERE n > 1) AS repeated_keys
        FROM (SELECT COUNT(*) AS n FROM {renamed.get(t, "t_" + t)} GROUP BY {keys}) AS g"""
        for t, keys, primary in _UNIQUE), EVERY_LINE)


def _nulls_sql(**renamed: str) -> str:
    return tables(" UNION ALL ".join(f"""
        SELECT '{t}' AS table_name, '{c}' AS column_name,
               COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {renamed.get(t, "t_" + t)}"""
        for t, schema in TABLES.items() for c in schema.names), EVERY_LINE)


CHECKS_SQL = tables(" UNION ALL ".join(f"""
        SELECT '{t}' AS table_name, '{name}' AS check_name,
               COUNT(*) FILTER (WHERE {bad}) AS violations FROM {source}"""
    for t, name, bad, source in (
        ("orders", "ship_date >= order_date", "ship_date < order_date", "earliest"),
        ("sales", "sales >= 0", "sales < 0", "every_line"),
        ("sales", "quantity > 0", "quantity <= 0", "every_line"),
        ("sales", "0 <= discount <= 1", "discount < 0 OR discount > 1", "every_line"))), EVERY_LINE)

COUNTS_SQL = tables(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM t_{t}" for t in LOAD_ORDER))
PIPE_COUNTS_SQL = dirty(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM n_{t}" for t in LOAD_ORDER))


def _file_roundtrip(m: StarMart, fmt: str) -> Mart:
    spark = m.raw("region").sparkSession
    folder = new_scratch_path(spark, "tables")
    sinks.write_tables(m.normalised(), folder, fmt)
    return load_tables(spark, folder, fmt)


def _catalog_roundtrip(m: StarMart) -> Mart:
    """SNK5, SNK3 and SNK2, then SRC6 choosing SRC5 after a source that fails."""
    spark = m.raw("region").sparkSession
    database = f"tallymart_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{new_scratch_path(spark, 'database')}'")
    sinks.recreate_tables(spark, database, buckets=8)
    sinks.load_all_tables(m.normalised(), database, buckets=8)
    return first_available([
        lambda: load_tables(spark, new_scratch_path(spark, "nothing-here")),
        lambda: catalog_tables(spark, database)])


def _bulk_load(m: StarMart) -> Mart:
    spark = m.raw("region").sparkSession
    folder, database = new_scratch_path(spark, "bulk"), f"tallymart_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{new_scratch_path(spark, 'database')}'")
    sinks.write_tables(m.normalised(), folder, "csv")
    sinks.recreate_tables(spark, database)
    sinks.bulk_load_csv(spark, folder, database)
    return catalog_tables(spark, database)


def _by_year(m: StarMart) -> Mart:
    spark = m.raw("region").sparkSession
    folder = new_scratch_path(spark, "by-year")
    sinks.write_by_year(m.normalised(), folder)
    return load_by_year(spark, folder)


def _profile(mart: Mart) -> DataFrame:
    """Of every column of all eight tables: values that are there, and different ones.

    A column at a time: different values of several columns counted in one pass would lie in
    one table of a task, as many wide rows as the columns together have values.
    """
    parts = []
    for table, schema in TABLES.items():
        for c in schema.names:
            values = mart.tables[table].groupBy(c).agg(F.count(c).alias("copies"))
            parts.append(values.agg(
                F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.count(c).alias("n_distinct")).select(
                F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "n", "n_distinct"))
    return reduce(DataFrame.unionByName, parts)


PROFILE_SQL = tables(" UNION ALL ".join(f"""
        SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT({c}) AS n,
               COUNT(DISTINCT {c}) AS n_distinct FROM t_{t}"""
    for t, schema in TABLES.items() for c in schema.names))


def _exported(m: StarMart) -> DataFrame:
    view = _filtered(m, "order_id", "product_id", "sales", "quantity")
    path = new_scratch_path(view.sparkSession, "export")
    sinks.export_csv(view, path)
    return view.sparkSession.read.options(header=True).csv(path)


def _pipeline(m: StarMart) -> sinks.PipelineResult:
    spark = m.raw("region").sparkSession
    with scratch_scope(spark, keep="pipeline"):
        return sinks.run_pipeline(spark, _raw_file(m), new_scratch_path(spark, "pipeline"), remove_raw=True)


SALES_SQL = tables("""
        SELECT sales_id, CAST(order_id AS VARCHAR) AS order_id,
               CAST(product_id AS VARCHAR) AS product_id, sales, quantity, discount, profit
        FROM t_sales""")
ORDERS_SQL = tables("""
        SELECT CAST(order_id AS VARCHAR) AS order_id, order_date, ship_date, ship_mode,
               CAST(customer_id AS VARCHAR) AS customer_id, location_id
        FROM t_orders""")

ENTRIES = {
    "src1_src3_raw_csv": (_read_back, dirty(f"SELECT {', '.join(NAMES)} FROM raw")),
    "src3_standard_names": (
        lambda m: standardize_column_names(raw_text(m).toDF(*RAW_COLUMNS))
        .groupBy("region", "sub_category").agg(F.count("postal_code").alias("n")), dirty("""
        SELECT region, sub_category, COUNT(*) AS n FROM raw GROUP BY region, sub_category""")),
    "src4_snk1_parquet_sales": (
        lambda m: _file_roundtrip(m, "parquet").tables["sales"], SALES_SQL),
    "src4_snk1_csv_orders": (lambda m: _file_roundtrip(m, "csv").tables["orders"], ORDERS_SQL),
    "src5_src6_snk2_snk3_snk5_sales": (lambda m: _catalog_roundtrip(m).tables["sales"], SALES_SQL),
    "snk4_bulk_load_orders": (lambda m: _bulk_load(m).tables["orders"], ORDERS_SQL),
    "src4_snk1_csv_profile": (lambda m: _profile(_file_roundtrip(m, "csv")), PROFILE_SQL),
    "src4_snk1_by_year_profile": (lambda m: _profile(_by_year(m)), PROFILE_SQL),
    "snk4_bulk_load_profile": (lambda m: _profile(_bulk_load(m)), PROFILE_SQL),
    "flt1_tables_by_year": (
        lambda m: filter_view(_by_year(m).lines(
            "order_id", "sales", "order_date", "order_year", "region_name", "category_name", "segment"), **FILTER),
        flat(f"""
        SELECT CAST(order_id AS VARCHAR) AS order_id, sales, order_date, order_year, region_name, category_name,
               segment
        FROM flat WHERE {PASSES}""")),
    "snk6_row_counts": (lambda m: quality.row_counts(m.normalised()), COUNTS_SQL),
    "snk7_export_filtered": (_exported, flat(f"""
        SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id,
               CAST(sales AS VARCHAR) AS sales, CAST(quantity AS VARCHAR) AS quantity,
               CAST(order_date AS VARCHAR) AS order_date, region_name, category_name, segment
        FROM flat WHERE {PASSES}""")),
    "pipe_row_counts": (lambda m: _pipeline(m).counts, PIPE_COUNTS_SQL),
    "pipe_orders": (lambda m: _pipeline(m).mart.tables["orders"], dirty("SELECT * FROM n_orders")),
    "cln1_strip": (
        lambda m: clean.strip_strings(_raw(m)), dirty(f"SELECT {', '.join(NAMES)} FROM stripped")),
    "cln2_drop_duplicates": (
        _without_copies, dirty("SELECT * FROM merged")),
    "cln3_cln4_cast": (
        lambda m: clean.cast_types(_raw(m)).select(
            "row_id", "order_date", "ship_date", "sales", "quantity", "discount", "profit"),
        dirty("""
        SELECT row_id, CAST(try_strptime(order_date, '%m/%d/%Y') AS DATE) AS order_date,
               CAST(try_strptime(ship_date, '%m/%d/%Y') AS DATE) AS ship_date,
               TRY_CAST(sales AS DECIMAL(12,4)) AS sales,
               CASE WHEN TRY_CAST(quantity AS DOUBLE) % 1 = 0
                 THEN CAST(TRY_CAST(quantity AS DOUBLE) AS INTEGER) END AS quantity,
               TRY_CAST(discount AS DECIMAL(5,4)) AS discount,
               TRY_CAST(profit AS DECIMAL(12,4)) AS profit
        FROM raw""")),
    "cln5_cln9_tag_rows": (
        lambda m: clean.tag_rows(_raw(m)).select("row_id", "postal_code", "broken_rule"),
        dirty("SELECT row_id, postal_code, broken_rule FROM tagged")),
    "cln_clean": (lambda m: clean.clean(_raw(m)), dirty("SELECT * FROM cleaned")),
    "cln10_drop_report": (lambda m: clean.drop_report(clean.tag_rows(_raw(m))), dirty("""
        SELECT broken_rule AS rule, COUNT(*) AS dropped FROM tagged
        WHERE broken_rule IS NOT NULL GROUP BY broken_rule
        UNION ALL SELECT 'duplicate row', CAST(SUM(extra_copies) AS BIGINT) FROM tagged""")),
    "nrm1_regions": (lambda m: normalize.regions(_cleaned(m)), dirty("SELECT * FROM n_regions")),
    "nrm2_locations": (lambda m: _locations(_cleaned(m)), dirty("SELECT * FROM n_locations")),
    "nrm3_customers": (
        lambda m: normalize.customers(clean.clean(_raw(m))), dirty("SELECT * FROM n_customers")),
    "nrm4_categories": (
        lambda m: normalize.categories(_cleaned(m)), dirty("SELECT * FROM n_categories")),
    "nrm5_sub_categories": (
        lambda m: _sub_categories(clean.clean(_raw(m))), dirty("SELECT * FROM n_sub_categories")),
    "nrm6_products": (lambda m: _products(_cleaned(m)), dirty("SELECT * FROM n_products")),
    "nrm7_orders": (lambda m: _orders(_cleaned(m)), dirty("SELECT * FROM n_orders")),
    "nrm8_sales": (lambda m: normalize.sales(_cleaned(m)), dirty("SELECT * FROM n_sales")),
    "nrm9_normalise": (
        lambda m: quality.row_counts(normalize.normalise(clean.clean(_raw(m)))), PIPE_COUNTS_SQL),
    "ri_report": (lambda m: quality.integrity_report(m.normalised()), _ri_sql()),
    "ri_report_with_orphans": (
        lambda m: quality.integrity_report(_all_lines(m)),
        _ri_sql(sales="every_line", orders="earliest", products="fewer_products")),
    "dq1_unique_keys": (lambda m: quality.uniqueness_report(m.normalised()), _unique_sql()),
    "dq1_unique_keys_repeated": (
        lambda m: quality.uniqueness_report(_all_lines(m)),
        _unique_sql(sales="every_line", orders="earliest", products="fewer_products")),
    "dq2_nulls": (
        lambda m: quality.null_report(_all_lines(m)),
        _nulls_sql(sales="every_line", orders="earliest", products="fewer_products")),
    "dq3_checks": (lambda m: quality.check_report(_all_lines(m)), CHECKS_SQL),
}
