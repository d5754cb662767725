import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats


def integral(f, a, b, n=20000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (b - a) / n / 3


@pytest.mark.parametrize("a,b,x", [(2.5, 3.5, 0.3), (2, 40, 0.1), (30, 2, 0.95), (1, 1, 0.42)])
def test_beta(a, b, x):
    c = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    assert float(stats.beta_regularized(a, b, x)) == pytest.approx(integral(lambda t: c * t ** (a - 1) * (1 - t) ** (b - 1), 1e-12, x), abs=1e-6)


@pytest.mark.parametrize("a,x", [(1, 0.5), (2.5, 1.0), (3, 12.0), (40, 35.0)])
def test_gamma(a, x):
    c = 1 / math.gamma(a)
    assert float(stats.gamma_regularized(a, x)) == pytest.approx(integral(lambda t: c * t ** (a - 1) * np.exp(-t), 1e-12, x), abs=1e-6)


@pytest.mark.parametrize("a", [3e4, 9.9e4])
def test_gamma_settles_and_meets_the_expansion(a):
    x = a + np.sqrt(a) * np.array([-6.0, -2.0, -0.5, 0.0, 0.3, 1.0, 4.0, 40.0])
    assert stats.gamma_regularized(a, x) == pytest.approx(stats._gamma_large(np.full_like(x, a), x), abs=2e-9)


@pytest.mark.parametrize("a", [1e6, 1e7, 1e9])
def test_gamma_of_a_large_shape(a):
    assert float(stats.gamma_regularized(a, a)) == pytest.approx(0.5 + 1 / (3 * math.sqrt(2 * math.pi * a)), abs=1e-8)


def test_beta_of_large_shapes_settles():
    assert float(stats.beta_regularized(2e6, 2e6, 0.5)) == pytest.approx(0.5, abs=1e-8)
    assert np.isnan(stats.beta_regularized(np.nan, 1.0, 0.5)) and np.isnan(stats.gamma_regularized(np.nan, 1.0))


def test_tails(spark):
    df = spark.createDataFrame([(2.0, 10.0)], "t double, v double")
    r = df.select(stats.t_two_sided("t", "v").alias("t"), stats.chi2_upper("v", F.lit(3.0)).alias("c"), stats.f_upper("t", F.lit(3.0), "v").alias("f"),
                  stats.kolmogorov_upper(F.lit(0.1), F.lit(100.0)).alias("k")).first()
    # Published table values.
    assert r.t == pytest.approx(0.07339, abs=1e-5) and r.c == pytest.approx(0.018566, abs=1e-6)
    assert r.f == pytest.approx(0.17804, abs=2e-4) and r.k == pytest.approx(0.26999, abs=1e-4)
