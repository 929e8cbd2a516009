"""Monthly demand: decomposition, baselines, regression, backtest, forecast.

Sales are summed to one row per month (and group) first. All windows run on
those rows inside one group, so a partition is as long as the calendar. With
``group_cols`` every category, region or product is forecast in one job.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallymart.functions.measures import nonzero, real
from tallymart.functions.tdist import t_quantile
from tallymart.session import stash

# Executors then need no copy of this package to run the solver below.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEASON = 12
FEATURES = ("time_index", "month_sin", "month_cos")
METHODS = ("linear_regression", "moving_average", "exponential_smoothing")
TOO_SHORT = "too few months"


def aggregate_monthly(view: DataFrame, value_col: str = "sales", group_cols: Sequence[str] = (),
                      fill_gaps: bool = False) -> DataFrame:
    """FC1: one total per present month; ``fill_gaps`` adds zero rows for absent ones."""
    monthly = view.groupBy(*group_cols, "order_month").agg(
        real(F.sum(value_col)).alias("value"))
    if not fill_gaps:
        return monthly
    span = monthly.groupBy(*group_cols).agg(
        F.min("order_month").alias("first"), F.max("order_month").alias("last"))
    months = span.select(
        *group_cols, F.explode(F.sequence("first", "last", F.expr("interval 1 month")))
        .alias("order_month"))
    # Summed rather than joined, so that the NULL group finds its months too.
    both = months.withColumn("value", F.lit(0.0)).unionByName(monthly.where("order_month IS NOT NULL"))
    return both.groupBy(*group_cols, "order_month").agg(F.sum("value").alias("value"))


def _in_time(group_cols: Sequence[str]):
    return Window.partitionBy(*group_cols).orderBy("order_month")


def decompose(monthly: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """FC2: observed = trend + seasonal + residual.

    The trend averages the two 12-month means that straddle a month; it is NULL
    in the first and last six months.
    """
    series = _in_time(group_cols)
    halves = [series.rowsBetween(-6, 5), series.rowsBetween(-5, 6)]
    complete = F.lit(True)
    for half in halves:
        complete = complete & (F.count("value").over(half) == SEASON)
    mean_of_halves = sum(F.avg("value").over(half) for half in halves) / 2
    group = Window.partitionBy(*group_cols)
    same_month = Window.partitionBy(*group_cols, F.month("order_month"))
    once = F.row_number().over(same_month.orderBy("order_month")) == 1
    parts = (
        monthly.withColumn("trend", F.when(complete, mean_of_halves))
        .withColumn("month_effect", F.avg(F.col("value") - F.col("trend")).over(same_month))
        .withColumn("counted", F.when(once, F.col("month_effect")))
        .withColumn("seasonal", F.col("month_effect") - F.avg("counted").over(group)))
    return parts.select(
        *group_cols, "order_month", F.col("value").alias("observed"), "trend", "seasonal",
        (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def _season_features(month: Column) -> dict[str, Column]:
    angle = 2 * np.pi * F.month(month) / SEASON
    return {"month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def time_features(monthly: DataFrame, group_cols: Sequence[str] = (), start: int = 0) -> DataFrame:
    """FC3: position in the series and the calendar month on a circle."""
    index = F.row_number().over(_in_time(group_cols)) - 1 + start
    return monthly.withColumns(
        {"time_index": index, **_season_features(F.col("order_month"))})


def chronological_split(monthly: DataFrame, test_size: int = 6,
                        group_cols: Sequence[str] = ()) -> DataFrame:
    """FC4: adds ``is_test`` for the last months and ``status`` per group.

    A group no longer than the holdout is marked, not trained on. Without groups
    that is an error, found by counting the (few) months.
    """
    if test_size < 1:
        raise ValueError("test_size must be at least 1")
    if not group_cols:
        months = monthly.count()
        if test_size >= months:
            raise ValueError(
                f"test_size ({test_size}) must be smaller than the number of months ({months})")
    newest_first = Window.partitionBy(*group_cols).orderBy(F.desc("order_month"))
    months = F.count(F.lit(1)).over(Window.partitionBy(*group_cols))
    return monthly.withColumns({
        "is_test": F.row_number().over(newest_first) <= test_size,
        "status": F.when(months > test_size, "ok").otherwise(TOO_SHORT)})


def _with_age(train: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``age`` is 0 for the newest row; ``is_first`` marks the oldest."""
    newest_first = Window.partitionBy(*group_cols).orderBy(F.desc("order_month"))
    return train.withColumns({
        "age": F.row_number().over(newest_first) - 1,
        "is_first": F.row_number().over(_in_time(group_cols)) == 1})


def baselines(train: DataFrame, group_cols: Sequence[str] = (), window: int = 3,
              alpha: float = 0.3) -> DataFrame:
    """FC5, FC6: the flat forecasts, one row per group.

    Exponential smoothing is the recurrence written out: value i counts with
    alpha (1 - alpha)^age, the seed with (1 - alpha)^age.
    """
    weight = F.pow(F.lit(1.0 - alpha), "age") * F.when(F.col("is_first"), 1.0).otherwise(alpha)
    return _with_age(train, group_cols).groupBy(*group_cols).agg(
        F.avg(F.when(F.col("age") < window, F.col("value"))).alias("moving_average"),
        F.sum(weight * F.col("value")).alias("exponential_smoothing"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_ols(n: pd.Series, sum_y: pd.Series, sum_x: pd.Series, sum_xx: pd.Series,
               sum_xy: pd.Series) -> pd.Series:
    """Intercept and coefficients from sums, least norm where they are not unique."""
    answers = []
    for count, total, x, xx, xy in zip(n, sum_y, sum_x, sum_xx, sum_xy):
        mean_x, mean_y = np.asarray(x, float) / count, total / count
        width = len(mean_x)
        products = np.asarray(xx, float).reshape(width, width) - count * np.outer(mean_x, mean_x)
        moments = np.asarray(xy, float) - count * mean_x * mean_y
        slopes = np.linalg.pinv(products, rcond=1e-12, hermitian=True) @ moments
        answers.append([float(mean_y - slopes @ mean_x), *map(float, slopes)])
    return pd.Series(answers)


def fit_trend_model(train: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """FC7: least squares on the three features, one row of coefficients per group.

    Spark sums the products; only those sums reach the solver.
    """
    x = [F.col(f).cast("double") for f in FEATURES]
    sums = train.groupBy(*group_cols).agg(
        F.count("value").cast("double").alias("n"), F.sum("value").alias("sum_y"),
        F.array(*[F.sum(a) for a in x]).alias("sum_x"),
        F.array(*[F.sum(a * b) for a in x for b in x]).alias("sum_xx"),
        F.array(*[F.sum(a * F.col("value")) for a in x]).alias("sum_xy"))
    solved = sums.where("n > 0").withColumn(
        "beta", _solve_ols("n", "sum_y", "sum_x", "sum_xx", "sum_xy"))
    return solved.select(*group_cols, *[
        F.col("beta")[i].alias(f"beta_{name}") for i, name in enumerate(("intercept", *FEATURES))])


def predict(features: DataFrame, model: DataFrame, group_cols: Sequence[str] = (),
            name: str = "predicted") -> DataFrame:
    """Adds the model's value for each row of features."""
    joined = _per_group(features, model, group_cols)
    value = F.col("beta_intercept")
    for feature in FEATURES:
        value = value + F.col(f"beta_{feature}") * F.col(feature)
    return joined.withColumn(name, value).drop(*[c for c in model.columns if c.startswith("beta_")])


def _per_group(rows: DataFrame, facts: DataFrame, group_cols: Sequence[str],
               how: str = "inner") -> DataFrame:
    """Join one row of facts per group (NULL is a group); without groups, the one row there is."""
    if group_cols:
        keys = {c: f"_group_{i}" for i, c in enumerate(group_cols)}
        same = F.lit(True)
        for column, key in keys.items():
            same = same & F.col(column).eqNullSafe(F.col(key))
        return rows.join(facts.withColumnsRenamed(keys), same, how).drop(*keys.values())
    on = "_the_series"
    return (
        rows.withColumn(on, F.lit(1))
        .join(F.broadcast(facts.limit(1).withColumn(on, F.lit(1))), on, how).drop(on))


def evaluate(pairs: DataFrame, keys: Sequence[str] = (), actual: str = "actual",
             predicted: str = "predicted") -> DataFrame:
    """FC8: mae, rmse and mape; months of zero actual value have no percentage error."""
    error = F.col(actual) - F.col(predicted)
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(error / nonzero(actual))) * 100).alias("mape"))


def interval(forecast: DataFrame, residuals: DataFrame, group_cols: Sequence[str] = (),
             confidence: float = 0.95) -> DataFrame:
    """FC9: ``lower`` and ``upper`` of constant width around ``forecast``.

    With fewer than two residuals both are NULL; the forecast stays.
    """
    spread = residuals.groupBy(*group_cols).agg(
        F.count("residual").alias("n"), F.stddev_samp("residual").alias("spread"))
    critical = t_quantile(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double"))
    margin = spread.where("n > 1").select(
        *group_cols, (F.col("spread") * critical).alias("margin"))
    return _per_group(forecast, margin, group_cols, "left").withColumns({
        "lower": F.col("forecast") - F.col("margin"),
        "upper": F.col("forecast") + F.col("margin")}).drop("margin")


def future_months(monthly: DataFrame, periods: int = 6,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """FC10: the months after the last one; ``time_index`` goes on where it stopped."""
    last = monthly.groupBy(*group_cols).agg(
        F.max("order_month").alias("last"), F.count(F.lit(1)).alias("n"))
    ahead = last.where("last IS NOT NULL").select(
        *group_cols, F.posexplode(F.sequence(
            F.add_months("last", 1), F.add_months("last", periods), F.expr("interval 1 month")))
        .alias("step", "order_month"), "n")
    return ahead.select(
        *group_cols, "order_month", (F.col("n") + F.col("step")).cast("int").alias("time_index"),
        *[c.alias(n) for n, c in _season_features(F.col("order_month")).items()])


def backtest(monthly: DataFrame, test_size: int = 6, ma_window: int = 3, exp_alpha: float = 0.3,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """FC11: the three methods on one holdout; (group, method, mae, rmse, mape, status)."""
    split = chronological_split(time_features(monthly, group_cols), test_size, group_cols)
    train = split.where("status = 'ok' AND NOT is_test")
    test = split.where("status = 'ok' AND is_test")
    guesses = predict(test, fit_trend_model(train, group_cols), group_cols, METHODS[0])
    guesses = _per_group(guesses, baselines(train, group_cols, ma_window, exp_alpha), group_cols)
    long = guesses.unpivot(
        [*group_cols, "value"], list(METHODS), "method", "predicted")
    scores = evaluate(long, [*group_cols, "method"], "value").withColumn("status", F.lit("ok"))
    if not group_cols:
        return scores
    short = split.where(F.col("status") == TOO_SHORT).groupBy(*group_cols).agg(
        F.first("status").alias("status"))
    return scores.unionByName(short, allowMissingColumns=True)


def future_forecast(monthly: DataFrame, periods: int = 6, confidence: float = 0.95,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Refit on the whole history; ``forecast`` with its prediction interval."""
    features = time_features(monthly, group_cols)
    model = fit_trend_model(features, group_cols)
    residuals = predict(features, model, group_cols).withColumn(
        "residual", F.col("value") - F.col("predicted"))
    ahead = predict(future_months(monthly, periods, group_cols), model, group_cols, "forecast")
    return interval(ahead, residuals, group_cols, confidence).select(
        *group_cols, "order_month", "forecast", "lower", "upper")


def sales_forecast(view: DataFrame, periods: int = 6, test_size: int = 6, ma_window: int = 3,
                   exp_alpha: float = 0.3, value_col: str = "sales",
                   group_cols: Sequence[str] = (), fill_gaps: bool = False) -> dict[str, DataFrame]:
    """FC12: monthly series, decomposition, backtest, forecast and model.

    Sales are read once; the months are written and everything else starts there.
    Groups too short for the holdout appear in the backtest with their status only.
    """
    monthly = stash(aggregate_monthly(view, value_col, group_cols, fill_gaps), "monthly")
    scores = backtest(monthly, test_size, ma_window, exp_alpha, group_cols)
    usable = monthly
    if group_cols:
        months = F.count(F.lit(1)).over(Window.partitionBy(*group_cols))
        usable = monthly.withColumn("_months", months).where(
            F.col("_months") > test_size).drop("_months")
    return {
        "monthly": monthly,
        "decomposition": decompose(monthly, group_cols),
        "backtest": scores,
        "forecast": future_forecast(usable, periods, group_cols=group_cols),
        "model": fit_trend_model(time_features(usable, group_cols), group_cols),
    }
