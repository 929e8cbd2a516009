"""Descriptive statistics, outlier flags, intervals and the two-group test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallymart.functions.measures import format_fixed, nonzero, real
from tallymart.functions.tdist import t_quantile, t_two_sided_p
from tallymart.plans.counts import ValueCounts, bracketed_quantiles, fences_of, one_row


def descriptive_stats(df: DataFrame, column: str) -> DataFrame:
    """ST1: one row; nulls are left out, the smallest of tied modes is taken.

    The data are read once, into a count per value; the rest works on those
    counts. Skewness is bias-corrected: 0 for a constant, NULL below three values.
    """
    values = ValueCounts(df, column)
    counts = values.table
    [median] = values.quantiles(0.5)
    common = counts.orderBy(F.desc("copies"), "value").select("value").first()
    mode = common[0] if common else None
    mean = counts.agg(F.sum(F.col("value") * F.col("copies")) / nonzero(F.sum("copies"))).first()[0]
    off = F.col("value") - mean if mean is not None else F.lit(None).cast("double")
    moments = counts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("count"),
        F.sum(off * off * F.col("copies")).alias("squares"),
        F.sum(off * off * off * F.col("copies")).alias("cubes"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    n = real("count")
    variance = F.col("squares") / nonzero(n - 1)
    population = (F.col("cubes") / n) / nonzero(F.pow(F.col("squares") / n, 1.5))
    skewness = (
        F.when(n < 3, None).when(F.col("min") == F.col("max"), F.lit(0.0))
        .otherwise(population * F.sqrt(n * (n - 1)) / nonzero(n - 2)))
    return moments.select(
        "count", *[F.lit(v).cast("double").alias(n) for n, v in (("mean", mean), ("median", median), ("mode", mode))],
        F.sqrt(variance).alias("std_dev"), variance.alias("variance"),
        skewness.alias("skewness"), "min", "max")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ST2: Pearson, pairwise complete, long form. NULL where a column is constant.

    One aggregate row holds, for every pair of columns, count, means, centred sums and
    cross product of the rows where both are there (what ``covar_pop`` and ``var_pop`` keep
    and merge between tasks); no row is generated per pair. Matrix and aggregate grow with
    the columns alone.
    """
    named = [f"c{i}" for i in range(len(columns))]
    data = df.select(*[real(c).alias(n) for c, n in zip(columns, named)])
    spreads, crosses = [], []
    for i, a in enumerate(named):
        spreads.append(F.var_pop(a).alias(f"v{i}"))
        for j in range(i + 1, len(named)):
            both = F.when(F.col(a).isNotNull() & F.col(named[j]).isNotNull(), F.col(a))
            other = F.when(F.col(a).isNotNull() & F.col(named[j]).isNotNull(), F.col(named[j]))
            crosses += [F.covar_pop(a, named[j]).alias(f"x{i}_{j}"), F.var_pop(both).alias(f"a{i}_{j}"),
                        F.var_pop(other).alias(f"b{i}_{j}")]
    moments = data.agg(*spreads, *crosses)
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            low, high = min(i, j), max(i, j)
            spread = F.sqrt(f"a{low}_{high}") * F.sqrt(f"b{low}_{high}") if i != j else None
            value = (F.when(F.col(f"v{i}") > 0, F.lit(1.0)) if i == j
                     else F.col(f"x{low}_{high}") / nonzero(spread))
            cells.append(F.struct(F.lit(a).alias("row_column"), F.lit(b).alias("column"),
                                  value.alias("correlation")))
    return moments.select(F.inline(F.array(*cells)))


def quartiles(df: DataFrame, column: str, accuracy: int = 10_000) -> DataFrame:
    """ST3's bounds for large data: q1, median and q3 from a sketch and one exact count."""
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return one_row(df, dict(zip(names, bracketed_quantiles(df, column, list(names.values()), accuracy))))


def outliers_iqr(df: DataFrame, column: str, bracketed: bool = False) -> DataFrame:
    """ST3: adds ``is_outlier``, strictly beyond 1.5 interquartile ranges; NULL is not one.

    ``bracketed`` finds the quartiles without counting every value; the answer is the same.
    """
    if bracketed:
        fences = fences_of(*bracketed_quantiles(df, column, [0.25, 0.75]))
    else:
        fences = ValueCounts(df, column).fences()
    return df.withColumn("is_outlier", fences.outside(real(column)))


def outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """ST4: adds ``is_outlier``; nothing is one where there is no spread."""
    x = real(column)
    moments = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    mean, std = moments.select("mean").scalar(), moments.select("std").scalar()
    z = F.abs((x - mean) / nonzero(std))
    return df.withColumn("is_outlier", F.coalesce(z > threshold, F.lit(False)))


def confidence_interval_mean(df: DataFrame, column: str, confidence: float = 0.95,
                             group_cols: Sequence[str] = ()) -> DataFrame:
    """ST5: t interval of the mean, for the whole table or per group."""
    x = real(column)
    moments = df.groupBy(*group_cols).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_dev"))
    standard_error = F.col("std_dev") / F.sqrt("n")
    critical = F.when(
        F.col("n") > 1, t_quantile(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double")))
    margin = standard_error * critical
    return moments.select(
        *group_cols, "n", "mean", "std_dev",
        (F.col("mean") - margin).alias("lower"), (F.col("mean") + margin).alias("upper"))


def welch_ttest(df: DataFrame, dim: str, a: str, b: str, column: str,
                alpha: float = 0.05) -> DataFrame:
    """ST6: do the means of ``column`` differ between two values of ``dim``?"""
    sides = df.where(F.col(dim).isin(a, b))
    aggregates = []
    for side, label in (("a", a), ("b", b)):
        x = F.when(F.col(dim) == label, real(column))
        aggregates += [F.count(x).alias(f"n_{side}"), F.avg(x).alias(f"mean_{side}"),
                       F.var_samp(x).alias(f"var_{side}")]
    moments = sides.agg(*aggregates)
    part_a, part_b = (F.col(f"var_{s}") / nonzero(f"n_{s}") for s in "ab")
    part_of_freedom = [
        part * part / nonzero(F.col(f"n_{s}") - 1) for part, s in ((part_a, "a"), (part_b, "b"))]
    difference = F.col("mean_a") - F.col("mean_b")
    tested = moments.select(
        F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "n_a", "n_b", "mean_a", "mean_b",
        difference.alias("mean_difference"),
        (difference / nonzero(F.sqrt(part_a + part_b))).alias("t_statistic"),
        ((part_a + part_b) * (part_a + part_b) / nonzero(part_of_freedom[0] + part_of_freedom[1]))
        .alias("degrees_of_freedom"))
    tested = tested.withColumn(
        "p_value", F.nanvl(t_two_sided_p("t_statistic", "degrees_of_freedom"), F.lit(None)))
    tested = tested.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    verdict = F.when(F.col("significant"), " differ").otherwise(" are not shown to differ")
    sentence = F.concat(
        F.lit("Means "), format_fixed("mean_a", 4), F.lit(" and "), format_fixed("mean_b", 4), verdict,
        F.lit(f" at {round((1 - alpha) * 100)}% (p = "), format_fixed("p_value", 4), F.lit(")"))
    return tested.withColumn("interpretation", sentence)
