"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the next aggregate would have reused the
    # join's partitioning: one more shuffle beats one task with a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles a method of more than 8,000 bytes: rows of many computed columns
    # would run interpreted. Beyond it Spark generates many small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in _RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("tallymart")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false"))
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="tallymart-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


_SCOPES: list[list[str]] = []
_TABLE_AT: dict[str, str] = {}  # catalog tables whose files lie in the scratch folder


def new_scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession, keep: str | None = None) -> Iterator[None]:
    """Delete what is written to the scratch folder inside, when it is over.

    For work whose results lie elsewhere by then. Paths under the label ``keep`` stay, until a
    scope around this one is over.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in made:
            if keep is not None and path.rpartition("/")[2].startswith(f"{keep}-"):
                if _SCOPES:
                    _SCOPES[-1].append(path)
            else:
                if path in _TABLE_AT:
                    spark.sql(f"DROP TABLE IF EXISTS {_TABLE_AT.pop(path)}")
                remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind; else they stay until the driver collects garbage."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def stash(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Several passes then see the same rows, a lost executor costs no recomputation
    of what came before, and readers prune columns and know the table's size.
    """
    path = new_scratch_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files behind one slice: of rows taken a slice at a time, only one slice's shuffle lies on disk.
SLICE_BYTES = 400_000_000


def file_bytes(table: DataFrame) -> int:
    """The size of the files of a table read as it is."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def slices_of(table: DataFrame) -> int:
    return max(1, -(-file_bytes(table) // SLICE_BYTES))


def slice_of(slices: int, *keys: Column | str) -> Column:
    """Which slice a row belongs to; equal keys share one. Not the hash that shuffles go by."""
    return F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")


def write_in_turn(parts: Iterable[DataFrame], path: str, fmt: str = "parquet", **options: object) -> None:
    """Write one part after the other to a folder; each one's shuffle files go before the next."""
    for part in parts:
        with shuffles_removed(part.sparkSession):
            part.write.mode("append").format(fmt).options(**options).save(path)


def stash_in_turn(spark: SparkSession, parts: Iterable[DataFrame], label: str) -> DataFrame:
    """As ``stash``, of all parts together."""
    path, schema = new_scratch_path(spark, label), []

    def noted() -> Iterator[DataFrame]:
        for part in parts:
            schema[:] = [part.schema]
            yield part

    write_in_turn(noted(), path, compression="zstd")
    return spark.read.schema(schema[0]).parquet(path)


def stash_bucketed(df: DataFrame, label: str, key: str, buckets: int | None = None,
                   sort: str | None = None, compression: str | None = None) -> DataFrame:
    """As ``stash``, stored so that rows of one ``key`` are read together, without a shuffle.

    Every different key of a partition of ``df`` is a file, so there should be few.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{label}_{uuid.uuid4().hex}", new_scratch_path(spark, label)
    _TABLE_AT[path] = name
    writer = df.write.bucketBy(count, key).option("path", path)
    if sort:
        writer = writer.sortBy(sort)
    if compression:
        writer = writer.option("compression", compression)
    with shuffles_removed(spark):
        writer.saveAsTable(name)
    return spark.table(name)
