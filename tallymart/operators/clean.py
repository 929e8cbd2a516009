"""Ordered cleaning rules for raw order lines.

Order: strip, drop duplicates, cast, drop rows lacking a critical field, fill
postal codes, business rules. Rows are tagged with the first rule they break, so
the cleaned rows and the report of drops come from one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymart.schema import MALFORMED, MONEY, RATE
from tallymart.session import slice_of, slices_of, stash_in_turn

CRITICAL = ("order_date", "ship_date", "sales", "quantity", "customer_id", "product_id")
RULES = ("duplicate row", "missing critical field", "ship_date < order_date",
         "discount outside [0, 1]", "quantity not positive", "out of range", "malformed row")
COPIES, BROKEN = "extra_copies", "broken_rule"
_SPREAD, _SPREADS = "_spread", 1024

# Plain decimal notation, or an infinity. A cast would also read 0.1d, 2f and 0x1p-3.
_PLAIN = r"^[ \t]*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))[ \t]*$"

# Fixed value: the characters that count as white space at either end of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _stripped(text: Column) -> Column:
    """Trimming looks at every character; most texts begin and end with printable ASCII."""
    begins, ends = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    return F.when(begins.between(33, 126) & ends.between(33, 126), text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def strip_strings(df: DataFrame) -> DataFrame:
    """CLN1: trim white space of every kind, tabs and no-break spaces included."""
    return df.select(*[
        _stripped(F.col(f.name)).alias(f.name)
        if f.dataType.simpleString() == "string" else F.col(f.name)
        for f in df.schema.fields])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """CLN2: one row per set of business values, the one with the lowest row_id.

    ``extra_copies`` says how many rows it stands for besides itself. Copies are
    merged before the shuffle, so a row repeated very often costs nothing.
    """
    business = [c for c in df.columns if c != "row_id"]
    number = F.coalesce(_plain("row_id").try_cast("bigint"), _whole_number("row_id", "bigint"))
    kept = df.groupBy(*business).agg(
        F.min(number).alias("row_id"), (F.count(F.lit(1)) - 1).alias(COPIES))
    return kept.select(*df.columns, COPIES)


def copies_together(spark: SparkSession, parts: Iterable[DataFrame], label: str, *added: str) -> Iterator[DataFrame]:
    """The rows of all parts, written once, then a slice at a time; copies of a row share a slice.

    To merge copies every row is shuffled as wide as it is: of one slice at a time, that lies on
    disk with what it spills. ``added`` columns follow from the others.
    """
    spread = (part.withColumn(_SPREAD, slice_of(_SPREADS, *[
        c for c in part.columns if c not in ("row_id", *added)]).cast("smallint")) for part in parts)
    stored = stash_in_turn(spark, spread, label)
    slices = min(_SPREADS, slices_of(stored))
    edges = [_SPREADS * i // slices for i in range(slices + 1)]
    for low, high in zip(edges, edges[1:]):
        yield stored.where((F.col(_SPREAD) >= low) & (F.col(_SPREAD) < high)).drop(_SPREAD)


def _date(column: str) -> Column:
    # Without a slash it is no date; failing to read one is slow.
    return F.when(F.col(column).contains("/"), F.try_to_date(F.col(column), "M/d/yyyy"))


def _plain(column: str) -> Column:
    return F.when(F.col(column).rlike(_PLAIN), F.col(column))


def _number(column: str) -> Column:
    """The number as written, whatever its size; NULL for anything else."""
    return _plain(column).try_cast("double")


def _whole_number(column: str, kind: str = "int") -> Column:
    number = _number(column)
    return F.when(number % 1 == 0, number.try_cast(kind))


def cast_types(df: DataFrame) -> DataFrame:
    """CLN3, CLN4: what cannot be read as its type becomes NULL."""
    return df.withColumns({
        "order_date": _date("order_date"), "ship_date": _date("ship_date"),
        "sales": _plain("sales").try_cast(MONEY), "profit": _plain("profit").try_cast(MONEY),
        "discount": _plain("discount").try_cast(RATE), "quantity": _whole_number("quantity")})


def fill_postal_code(df: DataFrame) -> DataFrame:
    """CLN6."""
    return df.na.fill({"postal_code": "UNKNOWN"})


def _with_values(df: DataFrame) -> DataFrame:
    """All columns and ``_read``: dates, numbers as written (``<name>_written``) and as typed.

    A generator of one row, as a filter on what follows would else be moved below it, with
    another reading of a text for every place it is judged by.
    """
    plain = df.withColumns({f"_plain_{c}": _plain(c) for c in ("sales", "profit", "discount", "quantity")})
    number = {c: F.col(f"_plain_{c}").try_cast("double") for c in ("sales", "profit", "discount", "quantity")}
    number["quantity"] = F.when(number["quantity"] % 1 == 0, number["quantity"])
    values = {c: _date(c) for c in ("order_date", "ship_date")}
    values |= {f"{c}_written": written for c, written in number.items()}
    values |= {c: F.col(f"_plain_{c}").try_cast(MONEY) for c in ("sales", "profit")}
    values |= {"quantity": number["quantity"].try_cast("int")}
    read = F.struct(*[value.alias(name) for name, value in values.items()])
    return plain.select(*df.columns, F.explode(F.array(read)).alias("_read"))


def _broken_rule() -> Column:
    """CLN5, CLN7, CLN8, CLN9: the first rule a row breaks, NULL for a good row.

    Judged on the numbers as written, before they are rounded to the tables' types.
    A number that its type cannot hold is no missing one: that is a rule of its own.
    """
    parsed = {"order_date": F.col("_read.order_date"), "ship_date": F.col("_read.ship_date"),
              "sales": F.col("_read.sales_written"), "quantity": F.col("_read.quantity_written")}
    missing, too_large = F.lit(False), F.lit(False)
    for column in CRITICAL:
        missing = missing | parsed.get(column, F.col(column)).isNull()
    for column in ("sales", "profit", "quantity"):
        too_large = too_large | (F.col(f"_read.{column}_written").isNotNull()
                                 & F.col(f"_read.{column}").isNull())
    allowed = F.coalesce(F.col("_read.discount_written").between(0, 1), F.lit(False))
    return (
        F.when(missing, RULES[1])
        .when(parsed["ship_date"] < parsed["order_date"], RULES[2])
        .when(~allowed, RULES[3])
        .when(parsed["quantity"] <= 0, RULES[4])
        .when(too_large, RULES[5]))


def judge_rows(raw: DataFrame) -> DataFrame:
    """Stripped rows, copies among them, with their ``broken_rule``.

    A row that came with its text in ``malformed_record`` breaks the rule "malformed row",
    whatever its fields seem to say.
    """
    rule = _broken_rule()
    if MALFORMED in raw.columns:
        rule = F.when(F.col(MALFORMED).isNotNull(), RULES[6]).otherwise(rule)
    return _with_values(strip_strings(raw)).withColumn(BROKEN, rule).drop("_read")


def merge_judged(judged: DataFrame) -> DataFrame:
    """The different rows of ``judge_rows``, with their copies counted, as typed."""
    columns = [c for c in judged.columns if c != BROKEN]
    return fill_postal_code(cast_types(drop_duplicates(judged).select(*columns, COPIES, BROKEN)))


def tag_rows(raw: DataFrame) -> DataFrame:
    """All steps; every distinct row is still there, with its ``broken_rule``."""
    # Copies break the same rule, so it is judged before they are merged: a filter on it
    # then spares the rows it drops the shuffle.
    return merge_judged(judge_rows(raw))


def good_rows(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(BROKEN).isNull()).drop(BROKEN, COPIES, MALFORMED)


def clean(raw: DataFrame) -> DataFrame:
    return good_rows(tag_rows(raw))


def _dropped_as() -> list[tuple[Column, Column]]:
    """(rule, rows) of a tagged row: its extra copies, then itself; malformed rows are all malformed."""
    malformed = F.coalesce(F.col(BROKEN) == RULES[6], F.lit(False))
    one = F.lit(1).cast("bigint")
    return [(F.lit(RULES[0]), F.when(malformed, one - one).otherwise(F.col(COPIES))),
            (F.col(BROKEN), F.when(malformed, one + F.col(COPIES)).otherwise(one))]


def drop_report(tagged: DataFrame) -> DataFrame:
    """CLN10: rows dropped per rule; rules that dropped nothing have no row."""
    drops = F.explode(F.array(*[
        F.struct(rule.alias("rule"), n.alias("n")) for rule, n in _dropped_as()]))
    return (
        tagged.select(drops.alias("d")).where("d.rule IS NOT NULL AND d.n > 0")
        .groupBy("d.rule").agg(F.sum("d.n").alias("dropped")))


def drop_metrics() -> list[Column]:
    """The same counts as columns to observe while tagged rows are written, and the rows read."""
    (_, copies), (rule, own) = _dropped_as()
    found = [F.sum(copies).alias(RULES[0])]
    found += [F.sum(F.when(rule == name, own)).alias(name) for name in RULES[1:]]
    return [*found, F.sum(F.col(COPIES) + 1).alias(READ)]


READ = "rows read"
