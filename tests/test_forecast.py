import datetime as dt
import math

import pytest

from conftest import rows
from pyspark.sql import functions as F
from tallymart.plans import forecast as fc

LINE = [1000 + 50 * i for i in range(36)]


def test_monthly_sums_present_months_only(view_of):
    view = view_of([
        {"order_date": dt.date(2023, 1, 3), "sales": 100.0},
        {"order_date": dt.date(2023, 1, 30), "sales": 50.0},
        {"order_date": dt.date(2023, 3, 1), "sales": 200.0}])
    got = rows(fc.aggregate_monthly(view).orderBy("order_month"))
    assert got == [(dt.date(2023, 1, 1), 150.0), (dt.date(2023, 3, 1), 200.0)]
    filled = rows(fc.aggregate_monthly(view, fill_gaps=True).orderBy("order_month"))
    assert filled == [got[0], (dt.date(2023, 2, 1), 0.0), got[1]]


def test_decompose_recovers_a_line(monthly_of):
    got = fc.decompose(monthly_of(LINE)).orderBy("order_month").collect()
    assert [r.trend is None for r in got] == [True] * 6 + [False] * 24 + [True] * 6
    for r in got:
        if r.trend is not None:
            assert r.trend == pytest.approx(r.observed)
            assert r.trend + r.seasonal + r.residual == pytest.approx(r.observed)
    assert sum(r.seasonal for r in got[:12]) == pytest.approx(0.0, abs=1e-6)


def test_decompose_finds_the_season_in_the_right_month(monthly_of):
    values = [1000 + 10 * i + (300 if i % 12 == 4 else 0) for i in range(48)]
    got = fc.decompose(monthly_of(values)).groupBy(F.month("order_month").alias("m")).agg(
        F.first("seasonal").alias("s")).orderBy(F.desc("s")).first()
    assert got.m == 5 and got.s == pytest.approx(275.0)


def test_short_series_has_no_trend(monthly_of):
    assert fc.decompose(monthly_of(LINE[:12])).where("trend IS NOT NULL").count() == 0


def test_features(monthly_of):
    got = fc.time_features(monthly_of(LINE[:12])).orderBy("order_month").collect()
    assert [r.time_index for r in got] == list(range(12))
    december, january = got[11], got[0]
    assert math.hypot(december.month_sin - january.month_sin,
                      december.month_cos - january.month_cos) < 0.6
    later = fc.time_features(monthly_of(LINE[:6]), start=24)
    assert sorted(r[0] for r in rows(later, "time_index")) == list(range(24, 30))


def test_split_is_chronological(monthly_of):
    got = fc.chronological_split(monthly_of(LINE[:12]), 3).orderBy("order_month")
    assert [r[0] for r in rows(got, "is_test")] == [False] * 9 + [True] * 3


@pytest.mark.parametrize("size", [6, 7, 0])
def test_split_rejects_bad_sizes(monthly_of, size):
    with pytest.raises(ValueError):
        fc.chronological_split(monthly_of(LINE[:6]), size)


def test_baselines(monthly_of):
    got = fc.baselines(monthly_of([0] * 20 + [100, 200, 300])).first()
    assert got.moving_average == 200.0
    assert fc.baselines(monthly_of([100] * 9)).first().exponential_smoothing == pytest.approx(100.0)
    assert fc.baselines(monthly_of([1, 2, 3])).first().exponential_smoothing == pytest.approx(1.81)


def test_model_recovers_slope_and_extends_it(monthly_of):
    series = monthly_of(LINE)
    model = fc.fit_trend_model(fc.time_features(series))
    assert model.first().beta_time_index == pytest.approx(50.0)
    ahead = fc.predict(fc.future_months(series, 3), model).orderBy("time_index")
    assert [r[0] for r in rows(ahead, "predicted")] == pytest.approx([2800, 2850, 2900], abs=1)


def test_model_with_fewer_months_than_coefficients(monthly_of):
    series = fc.time_features(monthly_of([10, 20]))
    fitted = fc.predict(series, fc.fit_trend_model(series)).orderBy("time_index")
    assert [r[0] for r in rows(fitted, "predicted")] == pytest.approx([10, 20])


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0)], "actual double, predicted double")
    got = fc.evaluate(df).first()
    assert (got.mae, got.mape) == (15.0, pytest.approx(10.0))
    assert got.rmse == pytest.approx(math.sqrt(250))
    zero = spark.createDataFrame([(0.0, 1.0)], "actual double, predicted double")
    assert fc.evaluate(zero).first().mape is None


def test_interval_is_centred_and_widens(spark):
    residuals = spark.createDataFrame([(float(x),) for x in (-3, 1, 2, -1, 1)], "residual double")
    point = spark.createDataFrame([(500.0,)], "forecast double")
    narrow = fc.interval(point, residuals).first()
    wide = fc.interval(point, residuals, confidence=0.99).first()
    assert (narrow.lower + narrow.upper) / 2 == pytest.approx(500.0)
    assert wide.upper - wide.lower > narrow.upper - narrow.lower
    assert narrow.upper - 500 == pytest.approx(2.776445 * 2.0, rel=1e-5)


def test_future_months_follow_the_last(monthly_of):
    got = rows(fc.future_months(monthly_of(LINE[:11]), 3), "order_month", "time_index")
    assert sorted(got) == [(dt.date(2020, 12, 1), 11), (dt.date(2021, 1, 1), 12),
                           (dt.date(2021, 2, 1), 13)]


def sales_view(view_of, group="A", months=30, base=100.0):
    return [{"order_date": dt.date(2020 + m // 12, m % 12 + 1, 10), "region_name": group,
             "sales": base + 3 * m + 7 * ((m * 5 + k) % 4)} for m in range(months) for k in range(5)]


def test_whole_forecast(view_of):
    result = fc.sales_forecast(view_of(sales_view(view_of)))
    assert set(result) == {"monthly", "decomposition", "backtest", "forecast", "model"}
    assert {r[0] for r in rows(result["backtest"], "method")} == set(fc.METHODS)
    ahead = result["forecast"].orderBy("order_month").collect()
    assert len(ahead) == 6 and ahead[0].order_month == dt.date(2022, 7, 1)
    assert all(r.lower < r.forecast < r.upper for r in ahead)
    best = result["backtest"].orderBy("mae").first()
    assert best.method == "linear_regression"


def test_too_short_history_is_an_error_alone_and_a_status_in_groups(view_of):
    short = sales_view(view_of, "B", months=5)
    with pytest.raises(ValueError):
        fc.sales_forecast(view_of(short))
    both = view_of(sales_view(view_of, "A") + short)
    result = fc.sales_forecast(both, group_cols=["region_name"])
    status = set(rows(result["backtest"], "region_name", "status"))
    assert status == {("A", "ok"), ("B", fc.TOO_SHORT)}
    assert {r[0] for r in rows(result["forecast"], "region_name")} == {"A"}


def test_grouped_equals_single(view_of):
    a, b = sales_view(view_of, "A"), sales_view(view_of, "B", 28, 900.0)
    grouped = fc.sales_forecast(view_of(a + b), group_cols=["region_name"])["forecast"]
    alone = fc.sales_forecast(view_of(b))["forecast"]
    mine = [r[0] for r in rows(grouped.where("region_name = 'B'").orderBy("order_month"), "upper")]
    assert mine == pytest.approx([r[0] for r in rows(alone.orderBy("order_month"), "upper")])


def test_one_month_and_the_null_group_keep_their_forecast(spark):
    months = [("A", dt.date(2023, m, 1), 10.0 * m) for m in range(1, 7)]
    months += [(None, dt.date(2023, m, 1), 20.0 * m) for m in (1, 2, 4)]
    months += [("B", dt.date(2023, 1, 1), 5.0)]
    monthly = spark.createDataFrame(months, "region string, order_month date, value double")
    got = rows(fc.future_forecast(monthly, 2, group_cols=["region"]), "region", "forecast", "lower")
    assert sorted(str(r[0]) for r in got) == ["A", "A", "B", "B", "None", "None"]
    assert all(r[1] is not None for r in got)
    assert {r[0] for r in got if r[2] is None} == {"B"}


def test_gaps_of_the_null_group_are_filled(spark):
    view = spark.createDataFrame(
        [(None, dt.date(2023, 1, 1), 3.0), (None, dt.date(2023, 3, 1), 4.0)],
        "region string, order_month date, sales double")
    got = rows(fc.aggregate_monthly(view, "sales", ["region"], fill_gaps=True), "order_month", "value")
    assert [v for _, v in sorted(got)] == [3.0, 0.0, 4.0]
