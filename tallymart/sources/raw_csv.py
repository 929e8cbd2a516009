"""The flat raw order-line file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallymart.schema import MALFORMED, MISSING_TOKENS, RAW_COLUMNS


class SchemaValidationError(ValueError):
    """The raw file lacks expected columns."""


def validate_header(columns: Iterable[str]) -> None:
    """SRC2: all expected names must be there; others may be."""
    missing = sorted(set(RAW_COLUMNS) - set(columns))
    if missing:
        raise SchemaValidationError(f"Raw data is missing expected columns: {missing}")


def standard_name(name: str) -> str:
    """SRC3: ``Sub-Category`` becomes ``sub_category``."""
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def standardize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[standard_name(c) for c in df.columns])


def load_raw(spark: SparkSession, path: str, quoted_newlines: bool = False,
             malformed: str = "error") -> DataFrame:
    """SRC1: every column as text, missing tokens as NULL.

    ``quoted_newlines`` allows line breaks inside quotes; Spark then cannot split
    a file, so leave it off for large files that have none. Of several files all must
    have the header of the first; reading one with another header fails.

    A row with fewer or more fields than the header is malformed: reading it fails, or,
    with ``malformed="tag"``, it comes with its text in one more column,
    ``malformed_record``, which is NULL for all others.
    """
    if malformed not in ("error", "tag"):
        raise ValueError("malformed must be 'error' or 'tag'")
    reader = (
        spark.read.option("header", True).option("encoding", "ISO-8859-1")
        .option("quote", '"').option("escape", '"').option("multiLine", quoted_newlines))
    try:
        header = reader.csv(path).schema
        # Without all columns parsed, the number of fields would not be seen.
        reader = reader.option("enforceSchema", False).option("columnPruning", False)
        if malformed == "tag":
            tagged = T.StructType([*header.fields, T.StructField(MALFORMED, T.StringType())])
            df = reader.schema(tagged).option("columnNameOfCorruptRecord", MALFORMED).csv(path)
        else:
            df = reader.schema(header).option("mode", "FAILFAST").csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Raw data file not found: {path}") from error
        raise
    validate_header(header.names)
    df = standardize_column_names(df)
    return df.select(*[
        F.col(c) if c == MALFORMED
        else F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c)
        for c in df.columns])
