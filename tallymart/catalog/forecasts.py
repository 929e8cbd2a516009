"""Monthly series, decomposition, baselines, regression, backtest, forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.catalog.base_sql import flat
from tallymart.catalog.shared import settle
from tallymart.catalog.student_sql import quantiles
from tallymart.plans import forecast as fc
from tallymart.session import stash

HOLDOUT = 6

# One series per group ``g``; the whole business is the single group 'all'.
def _series(group: str) -> str:
    return f"""series AS (
  SELECT g, order_month, y, n,
         row_number() OVER (PARTITION BY g ORDER BY order_month) - 1 AS t,
         row_number() OVER (PARTITION BY g ORDER BY order_month DESC) - 1 AS age,
         sin(2 * pi() * month(order_month) / 12) AS s, cos(2 * pi() * month(order_month) / 12) AS c
  FROM (SELECT {group} AS g, order_month, CAST(SUM(sales) AS DOUBLE) AS y,
               COUNT(*) OVER (PARTITION BY {group}) AS n
        FROM flat GROUP BY {group}, order_month) AS m)"""


ALL, BY_CATEGORY = _series("'all'"), _series("category_name")


def _fit(name: str, where: str) -> str:
    """Least squares by the 3 x 3 normal equations of the centred features."""
    pairs = ("tt", "ts", "tc", "ss", "sc", "cc", "ty", "sy", "cy")
    return f"""{name}_m AS (
  SELECT g, AVG(t) AS mt, AVG(s) AS ms, AVG(c) AS mc, AVG(y) AS my,
         {", ".join(f"covar_pop({p[0]}, {p[1]}) AS {p}" for p in pairs)}
  FROM series WHERE {where} GROUP BY g),
{name}_d AS (
  SELECT *, tt * (ss * cc - sc * sc) - ts * (ts * cc - sc * tc) + tc * (ts * sc - ss * tc) AS d
  FROM {name}_m),
{name}_b AS (
  SELECT *,
    (ty * (ss * cc - sc * sc) - ts * (sy * cc - sc * cy) + tc * (sy * sc - ss * cy)) / d AS bt,
    (tt * (sy * cc - sc * cy) - ty * (ts * cc - sc * tc) + tc * (ts * cy - sy * tc)) / d AS bs,
    (tt * (ss * cy - sy * sc) - ts * (ts * cy - sy * tc) + ty * (ts * sc - ss * tc)) / d AS bc
  FROM {name}_d),
{name} AS (SELECT g, my - bt * mt - bs * ms - bc * mc AS b0, bt, bs, bc FROM {name}_b)"""


DECOMPOSED = """trended AS (
  SELECT g, order_month, y, CASE WHEN t >= 6 AND age >= 6 THEN
           (AVG(y) OVER (PARTITION BY g ORDER BY order_month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
            + AVG(y) OVER (PARTITION BY g ORDER BY order_month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2
           END AS trend
  FROM series),
effects AS (
  SELECT g, month(order_month) AS moy, AVG(y - trend) AS effect FROM trended GROUP BY 1, 2),
seasons AS (
  SELECT g, moy, effect - AVG(effect) OVER (PARTITION BY g) AS seasonal FROM effects)"""

DECOMPOSE = """
        SELECT {g} order_month, y AS observed, ROUND(trend, 4) AS trend,
               ROUND(seasonal, 4) AS seasonal, ROUND(y - trend - seasonal, 4) AS residual
        FROM trended JOIN seasons ON trended.g = seasons.g AND month(order_month) = moy"""

FLAT_FORECASTS = """baselines AS (
  SELECT g, AVG(y) FILTER (WHERE age < 3) AS moving_average,
         SUM(y * pow(0.7, age) * CASE WHEN t = 0 THEN 1 ELSE 0.3 END) AS exponential_smoothing
  FROM trained GROUP BY g)"""

TRAINED = f"""trained AS (SELECT * EXCLUDE (age), age - {HOLDOUT} AS age FROM series
  WHERE age >= {HOLDOUT})"""

GUESSES = f"""guesses AS (
  SELECT series.g, y, b0 + bt * t + bs * s + bc * c AS linear_regression, moving_average,
         exponential_smoothing
  FROM series JOIN fit ON series.g = fit.g JOIN baselines ON series.g = baselines.g
  WHERE age < {HOLDOUT}),
long AS (
  {" UNION ALL ".join(f"SELECT g, '{m}' AS method, y, {m} AS p FROM guesses" for m in fc.METHODS)})"""

SCORES = """
        SELECT {g} method, ROUND(AVG(ABS(y - p)), 2) AS mae, ROUND(sqrt(AVG(pow(y - p, 2))), 2)
                 AS rmse,
               ROUND(AVG(ABS((y - p) / NULLIF(y, 0))) * 100, 2) AS mape, 'ok' AS status
        FROM long GROUP BY g, method"""

AHEAD = """ahead AS (
  SELECT series.g, CAST(order_month + to_months(CAST(h AS INTEGER)) AS DATE) AS order_month,
         t + h AS t
  FROM series, range(1, 7) AS r(h) WHERE age = 0)"""

POINTS = """
        SELECT {g} order_month,
               ROUND(b0 + bt * t + bs * sin(2 * pi() * month(order_month) / 12)
                     + bc * cos(2 * pi() * month(order_month) / 12), 2) AS forecast
        FROM ahead JOIN fit ON ahead.g = fit.g"""


def _monthly(m, *groups: str):
    return fc.aggregate_monthly(_summed(m, *groups), "sales", groups)


def _summed(m, *groups: str):
    """Sales per month, summed per key before a group's dimension is joined."""
    return m.totals([*groups, "order_month"], "revenue").withColumnRenamed("revenue", "sales")


def _forecast(m, *groups: str):
    return fc.sales_forecast(_summed(m, *groups), group_cols=groups)


def _scored(m):
    train = fc.chronological_split(_monthly(m, "category_name"), HOLDOUT, ["category_name"])
    train = train.where("NOT is_test").drop("is_test", "status")
    return settle(fc.baselines(train, ["category_name"]), 4)


BY = "g AS category_name,"

ENTRIES = {
    "fc1_monthly_sales": (lambda m: _monthly(m), flat("""
        SELECT order_month, CAST(SUM(sales) AS DOUBLE) AS value FROM flat GROUP BY order_month""")),
    "fc1_monthly_sales_by_category": (lambda m: _monthly(m, "category_name"), flat("""
        SELECT category_name, order_month, CAST(SUM(sales) AS DOUBLE) AS value
        FROM flat GROUP BY category_name, order_month""")),
    "fc2_decompose": (
        lambda m: settle(fc.decompose(_monthly(m)), 4),
        flat(DECOMPOSE.format(g=""), ALL, DECOMPOSED)),
    "fc2_decompose_by_category": (
        lambda m: settle(fc.decompose(_monthly(m, "category_name"), ["category_name"]), 4),
        flat(DECOMPOSE.format(g="trended.g AS category_name,"), BY_CATEGORY, DECOMPOSED)),
    "fc3_time_features": (
        lambda m: settle(fc.time_features(_monthly(m)), 9), flat("""
        SELECT order_month, y AS value, CAST(t AS INTEGER) AS time_index,
               ROUND(s, 9) + 0.0 AS month_sin, ROUND(c, 9) + 0.0 AS month_cos FROM series""", ALL)),
    "fc4_chronological_split": (
        lambda m: fc.chronological_split(
            _monthly(m, "category_name"), HOLDOUT, ["category_name"]), flat(f"""
        SELECT g AS category_name, order_month, y AS value, age < {HOLDOUT} AS is_test,
               CASE WHEN n > {HOLDOUT} THEN 'ok' ELSE 'too few months' END AS status
        FROM series""", BY_CATEGORY)),
    "fc5_fc6_baselines": (_scored, flat("""
        SELECT g AS category_name, ROUND(moving_average, 4) AS moving_average,
               ROUND(exponential_smoothing, 4) AS exponential_smoothing FROM baselines""",
        BY_CATEGORY, TRAINED, FLAT_FORECASTS)),
    "fc7_trend_model": (
        lambda m: settle(fc.fit_trend_model(
            fc.time_features(_monthly(m, "category_name"), ["category_name"]),
            ["category_name"]), 2), flat("""
        SELECT g AS category_name, ROUND(b0, 2) AS beta_intercept, ROUND(bt, 2) AS beta_time_index,
               ROUND(bs, 2) AS beta_month_sin, ROUND(bc, 2) AS beta_month_cos FROM fit""",
        BY_CATEGORY, _fit("fit", "TRUE"))),
    "fc8_fc11_backtest": (
        lambda m: settle(fc.backtest(stash(_monthly(m), "monthly"), HOLDOUT).select(
            "method", "mae", "rmse", "mape", "status"), 2),
        flat(SCORES.format(g=""), ALL, TRAINED, FLAT_FORECASTS, _fit("fit", f"age >= {HOLDOUT}"),
             GUESSES)),
    "fc11_backtest_by_category": (
        lambda m: settle(_forecast(m, "category_name")["backtest"], 2),
        flat(SCORES.format(g=BY), BY_CATEGORY, TRAINED, FLAT_FORECASTS,
             _fit("fit", f"age >= {HOLDOUT}"), GUESSES)),
    "fc10_future_months": (
        lambda m: settle(fc.future_months(_monthly(m)), 9), flat("""
        SELECT order_month, CAST(t AS INTEGER) AS time_index,
               ROUND(sin(2 * pi() * month(order_month) / 12), 9) + 0.0 AS month_sin,
               ROUND(cos(2 * pi() * month(order_month) / 12), 9) + 0.0 AS month_cos
        FROM ahead""", ALL, AHEAD)),
    "fc12_forecast_points": (
        lambda m: settle(_forecast(m)["forecast"].select("order_month", "forecast"), 2),
        flat(POINTS.format(g=""), ALL, AHEAD, _fit("fit", "TRUE"))),
    "fc12_forecast_points_by_category": (
        lambda m: settle(_forecast(m, "category_name")["forecast"].select(
            "category_name", "order_month", "forecast"), 2),
        flat(POINTS.format(g="ahead.g AS category_name,"), BY_CATEGORY, AHEAD,
             _fit("fit", "TRUE"))),
    "fc9_residual_spread": (
        lambda m: settle(_residual_spread(m), 2), flat("""
        SELECT COUNT(*) AS n, ROUND(stddev_samp(y - b0 - bt * t - bs * s - bc * c), 2) AS spread
        FROM series JOIN fit ON series.g = fit.g""", ALL, _fit("fit", "TRUE"))),
    "fc12_forecast_interval": (
        lambda m: settle(_forecast(m, "region_name")["forecast"], 2), flat("""
        SELECT region_name, order_month, ROUND(forecast, 2) AS forecast,
               ROUND(forecast - t * spread, 2) AS lower, ROUND(forecast + t * spread, 2) AS upper
        FROM ahead_points JOIN spreads USING (region_name) JOIN critical ON critical.key = region_name""",
        _series("region_name"), AHEAD, _fit("fit", "TRUE"), f"""ahead_points AS ({
            POINTS.format(g="ahead.g AS region_name,").replace("ROUND(", "(").replace(", 2) AS", ") AS")})""",
        """spreads AS (
  SELECT series.g AS region_name, series.g AS key, COUNT(*) - 1 AS df,
         stddev_samp(y - b0 - bt * t - bs * s - bc * c) AS spread
  FROM series JOIN fit ON series.g = fit.g GROUP BY series.g)""", quantiles("critical", "spreads", 0.975))),
}


def _residual_spread(m):
    features = fc.time_features(stash(_monthly(m), "monthly"))
    fitted = fc.predict(features, fc.fit_trend_model(features))
    residual = F.col("value") - F.col("predicted")
    return fitted.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(residual).alias("spread"))
