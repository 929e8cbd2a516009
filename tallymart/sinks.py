"""Writing the tables, loading the catalog and the whole pipeline."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tallymart.operators import clean as cleaning
from tallymart.operators.mart import Mart
from tallymart.operators.normalize import normalise
from tallymart.operators.quality import validate_integrity
from tallymart.schema import LOAD_ORDER, TABLES
from tallymart.session import remove_folder, scratch_scope, shuffles_removed, stash_in_turn
from tallymart.sources.raw_csv import load_raw
from tallymart.sources.tables import catalog_tables, load_tables

# Sales and orders meet on order_id: bucketing both spares their join a shuffle.
_BUCKET_KEY = {"orders": "order_id", "sales": "order_id"}


def _contract(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])


def write_tables(mart: Mart, folder: str, fmt: str = "parquet") -> dict[str, int]:
    """SNK1: one file set per table. The rows written, by table, are counted on the way."""
    written = {}
    for name in LOAD_ORDER:
        seen = Observation(f"rows of {name}")
        rows = _contract(mart.tables[name], name).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = rows.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.options(header=True, escape='"')
        with shuffles_removed(rows.sparkSession):
            writer.save(f"{folder}/{name}.{fmt}")
        written[name] = seen.get["rows"]
    return written


def write_by_year(mart: Mart, folder: str) -> None:
    """SNK1, with orders and sales in a folder per order year; ``load_by_year`` reads them.

    A sale carries the year of its order, so a filter on order dates skips files of both. It
    is looked up in the written orders: what the orders come from is not run again for it.
    """
    for name in LOAD_ORDER:
        rows = _contract(mart.tables[name], name)
        if name == "orders":
            rows = rows.withColumn("order_year", F.year("order_date"))
        elif name == "sales":
            years = rows.sparkSession.read.schema(T.StructType([
                TABLES["orders"]["order_id"], T.StructField("order_year", T.IntegerType())])).parquet(
                f"{folder}/orders.parquet")
            rows = rows.join(years, "order_id", "left").select(*rows.columns, "order_year")
        if name in ("orders", "sales"):
            # A year goes to several tasks, so that no task has all of a busy one.
            rows = rows.repartition("order_year", F.pmod(F.xxhash64("order_id"), F.lit(16)))
            rows.write.mode("overwrite").partitionBy("order_year").parquet(f"{folder}/{name}.parquet")
        else:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def _qualified(name: str, database: str | None) -> str:
    return f"{database}.{name}" if database else name


def recreate_tables(spark: SparkSession, database: str | None = None,
                    buckets: int | None = None) -> None:
    """SNK5: drop children before parents, create all eight empty by contract."""
    for name in reversed(LOAD_ORDER):
        spark.sql(f"DROP TABLE IF EXISTS {_qualified(name, database)}")
    for name in LOAD_ORDER:
        writer = spark.createDataFrame([], TABLES[name]).write.format("parquet")
        if buckets and name in _BUCKET_KEY:
            writer = writer.bucketBy(buckets, _BUCKET_KEY[name]).sortBy(_BUCKET_KEY[name])
        writer.saveAsTable(_qualified(name, database))


def append_table(df: DataFrame, name: str, database: str | None = None,
                 buckets: int | None = None) -> None:
    """SNK2: add rows to an existing table, in its column order and types."""
    typed = _contract(df, name)
    key = _BUCKET_KEY.get(name)
    if not (buckets and key):
        typed.write.mode("append").format("parquet").saveAsTable(_qualified(name, database))
        return
    # Rows meet their bucket before the write, so each bucket is one file.
    writer = typed.repartition(buckets, key).write.mode("append").format("parquet")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(_qualified(name, database))


def append_jdbc(df: DataFrame, name: str, url: str, properties: dict[str, str],
                batch_size: int = 1000) -> None:
    """SNK2 into a relational database, in batched inserts."""
    df.select(*TABLES[name].names).write.option("batchsize", batch_size).jdbc(
        url, name, mode="append", properties=properties)


def load_all_tables(mart: Mart, database: str | None = None, buckets: int | None = None) -> None:
    """SNK3: parents before children."""
    absent = [name for name in LOAD_ORDER if name not in mart.tables]
    if absent:
        raise KeyError(f"Expected tables not found: {absent}")
    for name in LOAD_ORDER:
        append_table(mart.tables[name], name, database, buckets)


def bulk_load_csv(spark: SparkSession, folder: str, database: str | None = None,
                  buckets: int | None = None) -> None:
    """SNK4: CSV files into the tables. Each table is loaded whole or not at all;
    unlike a database transaction the eight together are not."""
    load_all_tables(load_tables(spark, folder, "csv"), database, buckets)


def export_csv(view: DataFrame, path: str) -> None:
    """SNK7: the current (filtered) view."""
    view.write.mode("overwrite").options(header=True, escape='"').csv(path)


class PipelineResult(NamedTuple):
    mart: Mart
    drops: DataFrame
    counts: DataFrame
    rows_read: int


def run_pipeline(spark: SparkSession, raw_path: str, folder: str, fmt: str = "parquet",
                 database: str | None = None, buckets: int | None = None,
                 quoted_newlines: bool = False, remove_raw: bool = False) -> PipelineResult:
    """PIPE: read, clean, normalise, write, check; load the catalog if one is named.

    Integrity is checked on the written tables, which are then complete and read
    cheaply; a violation raises before the catalog is touched. The result reads the
    written tables too, so nothing before them is run again, and what lay in the scratch
    folder is gone. Rows read, dropped and written are observed while they are written:
    the reports scan nothing. With ``remove_raw`` the raw file is scratch too, and goes as
    soon as its rows are stored.
    """
    seen: list[Observation] = []

    def observed(judged: DataFrame) -> DataFrame:
        if remove_raw and not seen:
            remove_folder(spark, raw_path)
        seen.append(Observation(f"rows read and dropped, slice {len(seen)}"))
        return cleaning.good_rows(cleaning.merge_judged(judged).observe(seen[-1], *cleaning.drop_metrics()))

    with scratch_scope(spark):
        with scratch_scope(spark, keep="good"):
            raw = load_raw(spark, raw_path, quoted_newlines, malformed="tag")
            slices = cleaning.copies_together(spark, [cleaning.judge_rows(raw)], "judged", cleaning.BROKEN)
            lines = stash_in_turn(spark, map(observed, slices), "good")
        counts = write_tables(normalise(lines, check=False, stored=True), folder, fmt)
        written = load_tables(spark, folder, fmt)
        validate_integrity(written)
    if database:
        recreate_tables(spark, database, buckets)
        load_all_tables(written, database, buckets)
        written = catalog_tables(spark, database)
    found = [s.get for s in seen]
    read = sum(f[cleaning.READ] or 0 for f in found)
    dropped = {rule: sum(f[rule] or 0 for f in found) for rule in cleaning.RULES}
    drops = [(rule, n) for rule, n in dropped.items() if n]
    return PipelineResult(
        written, spark.createDataFrame(drops, "rule string, dropped long"),
        spark.createDataFrame(list(counts.items()), "table_name string, row_count long"), read)
