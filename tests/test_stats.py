import math
import random

import pytest

from conftest import rows
from tallymart.functions import tdist
from tallymart.plans import stats


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


# Published two-sided 95 % points of Student's t.
@pytest.mark.parametrize("df,t", [(1, 12.706205), (9, 2.262157), (29, 2.045230), (1e6, 1.959966)])
def test_t_table(df, t):
    assert tdist.quantile(0.975, df) == pytest.approx(t, abs=1e-5)
    assert tdist.quantile(0.025, df) == pytest.approx(-t, abs=1e-5)
    assert tdist.two_sided_p(t, df) == pytest.approx(0.05, abs=1e-6)


def test_t_centre_and_limits():
    assert tdist.quantile(0.5, 7) == pytest.approx(0.0, abs=1e-9)
    assert tdist.two_sided_p(0.0, 5) == 1.0
    assert tdist.two_sided_p(1e9, 5) < 1e-9
    assert math.isnan(tdist.quantile(0.9, 0))


def test_describe(spark):
    got = stats.descriptive_stats(numbers(spark, [1, 2, 3, 4, 5]), "x").first()
    assert (got["count"], got["mean"], got["median"], got["mode"]) == (5, 3.0, 3.0, 1.0)
    assert got["variance"] == pytest.approx(2.5) and got["skewness"] == pytest.approx(0.0)
    assert (got["min"], got["max"]) == (1.0, 5.0)


def test_describe_leaves_nulls_out_and_corrects_skewness(spark):
    got = stats.descriptive_stats(numbers(spark, [1, 2, 3, None]), "x").first()
    assert (got["count"], got["mean"]) == (3, 2.0)
    got = stats.descriptive_stats(numbers(spark, [1, 2, 3, 10]), "x").first()
    assert got["skewness"] == pytest.approx(1.7636, abs=1e-4)


def test_describe_constant_and_short(spark):
    assert stats.descriptive_stats(numbers(spark, [5, 5, 5]), "x").first()["skewness"] == 0.0
    assert stats.descriptive_stats(numbers(spark, [5, 6]), "x").first()["skewness"] is None
    assert stats.descriptive_stats(numbers(spark, []), "x").first()["count"] == 0


def test_iqr_flags_only_the_far_point(spark):
    got = stats.outliers_iqr(numbers(spark, [10, 11, 12, 13, 14, 500, None]), "x")
    assert rows(got.where("is_outlier"), "x") == [(500.0,)]
    assert got.where("is_outlier IS NULL").count() == 0


def test_zscore(spark):
    got = stats.outliers_zscore(numbers(spark, [10] * 20 + [1000, None]), "x")
    assert rows(got.where("is_outlier"), "x") == [(1000.0,)]
    assert stats.outliers_zscore(numbers(spark, [10] * 20), "x").where("is_outlier").count() == 0


def test_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (4.0, None, 5.0)],
        "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in rows(stats.correlation_matrix(df, ["a", "b", "c"]))}
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(1.0)
    assert got["a", "c"] is None and got["c", "c"] is None


def test_interval_contains_mean_and_widens(spark):
    rng = random.Random(3)
    df = numbers(spark, [rng.gauss(50, 5) for _ in range(30)])
    narrow = stats.confidence_interval_mean(df, "x", 0.90).first()
    wide = stats.confidence_interval_mean(df, "x", 0.99).first()
    assert narrow.lower < narrow.mean < narrow.upper
    assert wide.upper - wide.lower > narrow.upper - narrow.lower
    exact = stats.confidence_interval_mean(df, "x").first()
    assert exact.upper - exact.mean == pytest.approx(
        2.045230 * exact.std_dev / math.sqrt(30), rel=1e-5)


def test_interval_of_one_value_is_null(spark):
    got = stats.confidence_interval_mean(numbers(spark, [4]), "x").first()
    assert got.mean == 4.0 and got.lower is None


def test_welch_both_ways(spark):
    rng = random.Random(5)
    far = [("A", rng.gauss(10, 1)) for _ in range(100)] + [("B", rng.gauss(20, 1)) for _ in range(100)]
    got = stats.welch_ttest(spark.createDataFrame(far, "g string, x double"), "g", "A", "B", "x").first()
    assert got.significant and got.p_value < 1e-6 and got.mean_difference < 0
    assert got.interpretation.endswith(" differ at 95% (p = 0.0000)")
    same = [(g, 1.0 + i % 7) for g in "AB" for i in range(70)]
    got = stats.welch_ttest(spark.createDataFrame(same, "g string, x double"), "g", "A", "B", "x").first()
    assert not got.significant and got.p_value == pytest.approx(1.0)
    assert "are not shown to differ" in got.interpretation


def test_welch_without_enough_rows(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "g string, x double")
    got = stats.welch_ttest(df, "g", "A", "B", "x").first()
    assert got.p_value is None and got.significant is False
