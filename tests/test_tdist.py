from __future__ import annotations

import math

from tallymart.functions import tdist


def test_a_fraction_that_does_not_converge_is_not_a_number():
    assert math.isnan(tdist._beta_fraction(1e15, 1e15, 0.5))
    assert math.isclose(tdist.two_sided_p(2.0, 10.0), 0.0733880347707, rel_tol=1e-9)
    assert math.isclose(tdist.quantile(0.975, 10.0), 2.2281388519649, rel_tol=1e-9)
    assert math.isfinite(tdist.two_sided_p(1.5, 1e9)) and math.isfinite(tdist.quantile(0.975, 1e9))


# Normal quantile of 0.975, and the first terms of the series around it in 1 / df.
def _expanded(df: float) -> float:
    z = 1.959963984540054235
    return (z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2)
            + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * df ** 3))


def test_quantiles_of_large_samples_keep_nine_digits():
    assert math.isclose(tdist.quantile(0.975, 100.0), 1.98397151852355, rel_tol=1e-10)
    for power in range(3, 13):
        for factor in (1.0, 6.0):
            df = factor * 10.0 ** power
            assert math.isclose(tdist.quantile(0.975, df), _expanded(df), rel_tol=1e-9)


def test_both_ways_agree_where_they_meet():
    for t in (0.0, 0.3, 1.0, 2.0, 5.0, 30.0):
        x = 100.0 / (100.0 + t * t)
        fraction = tdist._beta_share(50.0, 0.5, x)
        assert math.isclose(tdist.two_sided_p(t, 100.0), fraction, rel_tol=1e-9)


def test_tails_of_large_samples():
    assert math.isclose(tdist.two_sided_p(6.0, 1e12), math.erfc(6.0 / math.sqrt(2)), rel_tol=1e-9)
    assert tdist.two_sided_p(math.inf, 1e6) == 0.0 and tdist.two_sided_p(0.0, 1e6) == 1.0
    assert 0 <= tdist.two_sided_p(1e9, 100.0) < 1e-100
