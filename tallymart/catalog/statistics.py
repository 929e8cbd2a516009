"""Statistics over the sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.catalog.base_sql import flat
from tallymart.catalog.shared import settle
from tallymart.catalog.student_sql import quantiles, two_sided_p
from tallymart.plans import stats

COLUMNS = ("sales", "profit", "discount", "quantity", "profit_margin")


def _describe(column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    values = ("mean", f"AVG({x})"), ("median", f"quantile_cont({x}, 0.5)"), (
        "std_dev", f"stddev_samp({x})"), ("variance", f"var_samp({x})"), (
        "skewness", f"skewness({x})"), ("min", f"MIN({x})"), ("max", f"MAX({x})")
    return flat(f"""
        SELECT COUNT({column}) AS count, ROUND((
                 SELECT {x} FROM flat WHERE {column} IS NOT NULL
                 GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1), 4) AS mode,
               {", ".join(f"ROUND({e}, 4) AS {n}" for n, e in values)}
        FROM flat""")


# Sales of the star data have no value beyond the fences; margins have some on every scale.
BOUNDS = """bounds AS (
  SELECT quantile_cont(profit_margin, 0.25) AS q1, quantile_cont(profit_margin, 0.75) AS q3
  FROM flat)"""

MOMENTS = """moments AS (
  SELECT COUNT(*) AS n, AVG(profit_margin) AS m, var_samp(profit_margin) AS v, {dim} AS g
  FROM flat GROUP BY {dim})"""


def _welch(m):
    return stats.welch_ttest(
        m.lines("region_name", "profit_margin"), "region_name", "AFRICA", "AMERICA",
        "profit_margin")


ENTRIES = {
    **{f"st1_describe_{c}": (
        lambda m, c=c: settle(stats.descriptive_stats(m.lines(c), c), 4), _describe(c))
       for c in COLUMNS},
    "st2_correlation_matrix": (
        lambda m: settle(stats.correlation_matrix(
            m.lines("sales", "quantity", "discount"), ("sales", "quantity", "discount"))),
        flat("\n        UNION ALL ".join(
            f"SELECT '{a}' AS row_column, '{b}' AS \"column\", "
            f"ROUND(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM flat"
            for a in ("sales", "quantity", "discount") for b in ("sales", "quantity", "discount")))),
    "st3_outliers_iqr": (
        lambda m: stats.outliers_iqr(
            m.lines("order_id", "product_id", "sales", "profit_margin"), "profit_margin"), flat("""
        SELECT order_id, product_id, sales, profit_margin,
               COALESCE(profit_margin < q1 - 1.5 * (q3 - q1)
                        OR profit_margin > q3 + 1.5 * (q3 - q1), FALSE) AS is_outlier
        FROM flat, bounds""", BOUNDS)),
    "st3_quartiles_bracketed": (
        lambda m: settle(stats.quartiles(m.lines("sales"), "sales")), flat("""
        SELECT ROUND(quantile_cont(CAST(sales AS DOUBLE), 0.25), 6) AS q1,
               ROUND(quantile_cont(CAST(sales AS DOUBLE), 0.5), 6) AS median,
               ROUND(quantile_cont(CAST(sales AS DOUBLE), 0.75), 6) AS q3 FROM flat""")),
    "st4_outliers_zscore": (
        lambda m: stats.outliers_zscore(
            m.lines("order_id", "product_id", "profit_margin"), "profit_margin"), flat("""
        SELECT order_id, product_id, profit_margin, COALESCE(ABS(profit_margin - mean) / NULLIF(sd, 0) > 3, FALSE)
                 AS is_outlier
        FROM flat, (SELECT AVG(profit_margin) AS mean, stddev_samp(profit_margin) AS sd
                    FROM flat) AS s""")),
    "st5_interval_parts": (
        lambda m: settle(stats.confidence_interval_mean(
            m.lines("segment", "sales"), "sales", group_cols=["segment"])
            .select("segment", "n", "mean", "std_dev",
                    ((F.col("lower") + F.col("upper")) / 2).alias("centre")), 4), flat("""
        SELECT segment, COUNT(*) AS n, ROUND(AVG(CAST(sales AS DOUBLE)), 4) AS mean,
               ROUND(stddev_samp(CAST(sales AS DOUBLE)), 4) AS std_dev,
               ROUND(AVG(CAST(sales AS DOUBLE)), 4) AS centre
        FROM flat GROUP BY segment""")),
    "st5_confidence_interval": (
        lambda m: settle(stats.confidence_interval_mean(m.lines("sales"), "sales"), 4), flat("""
        SELECT n, ROUND(mean, 4) AS mean, ROUND(sd, 4) AS std_dev, ROUND(mean - t * sd / sqrt(n), 4) AS lower,
               ROUND(mean + t * sd / sqrt(n), 4) AS upper
        FROM parts JOIN critical USING (key)""", """parts AS (
  SELECT 1 AS key, COUNT(sales) AS n, COUNT(sales) - 1 AS df, AVG(CAST(sales AS DOUBLE)) AS mean,
         stddev_samp(CAST(sales AS DOUBLE)) AS sd FROM flat)""", quantiles("critical", "parts", 0.975))),
    "st5_interval_by_order_day": (
        lambda m: settle(stats.confidence_interval_mean(
            m.lines("order_date", "sales"), "sales", 0.99, ["order_date"]), 2), flat("""
        SELECT order_date, n, ROUND(mean, 2) AS mean, ROUND(sd, 2) AS std_dev,
               ROUND(mean - t * sd / sqrt(n), 2) AS lower, ROUND(mean + t * sd / sqrt(n), 2) AS upper
        FROM parts LEFT JOIN critical ON n - 1 = key""", """parts AS (
  SELECT order_date, COUNT(sales) AS n, AVG(CAST(sales AS DOUBLE)) AS mean,
         stddev_samp(CAST(sales AS DOUBLE)) AS sd FROM flat GROUP BY order_date)""", """sizes AS (
  SELECT DISTINCT n - 1 AS key, n - 1 AS df FROM parts WHERE n > 1)""",
        quantiles("critical", "sizes", 0.995))),
    "st6_welch_parts": (
        lambda m: settle(_welch(m).select(
            "group_a", "group_b", "n_a", "n_b", "mean_a", "mean_b", "mean_difference",
            "t_statistic", "degrees_of_freedom"), 4), flat("""
        SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, ROUND(a.m, 4) AS mean_a,
               ROUND(b.m, 4) AS mean_b, ROUND(a.m - b.m, 4) AS mean_difference,
               ROUND((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t_statistic,
               ROUND(pow(a.v / a.n + b.v / b.n, 2)
                     / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4)
                 AS degrees_of_freedom
        FROM moments AS a JOIN moments AS b ON a.g = 'AFRICA' AND b.g = 'AMERICA'""",
        MOMENTS.format(dim="region_name"))),
    "st6_welch_ttest": (lambda m: settle(_welch(m), 4), flat(f"""
        SELECT group_a, group_b, n_a, n_b, ROUND(mean_a, 4) AS mean_a, ROUND(mean_b, 4) AS mean_b,
               ROUND(mean_a - mean_b, 4) AS mean_difference, ROUND(t, 4) AS t_statistic,
               ROUND(df, 4) AS degrees_of_freedom, ROUND(p, 4) AS p_value, p < 0.05 AS significant,
               'Means ' || printf('%.4f', mean_a) || ' and ' || printf('%.4f', mean_b) ||
               CASE WHEN p < 0.05 THEN ' differ' ELSE ' are not shown to differ' END ||
               ' at 95% (p = ' || printf('%.4f', p) || ')' AS interpretation
        FROM (SELECT *, {two_sided_p("t", "df")} AS p FROM tested) AS judged""",
        MOMENTS.format(dim="region_name"), """tested AS (
  SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, a.m AS mean_a, b.m AS mean_b,
         (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
         pow(a.v / a.n + b.v / b.n, 2)
           / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df
  FROM moments AS a JOIN moments AS b ON a.g = 'AFRICA' AND b.g = 'AMERICA')""")),
}
