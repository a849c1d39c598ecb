import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateauscope.functions import numeric as N
from plateauscope.functions import parsing as X
from plateauscope.operators.evaluate import binomial_tests, chi_square_p9
from plateauscope.operators.montecarlo import uniforms


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_draws_agree_between_spark_and_numpy(spark):
    got = [r.u for r in spark.range(1, 200).select(N.uniform(20260919, F.col("id")).alias("u")).collect()]
    assert np.array_equal(np.array(got), uniforms(20260919, np.arange(1, 200)))
    assert 0.4 < np.mean(got) < 0.6


@pytest.mark.parametrize("p", [0.001, 0.02, 0.3, 0.5, 0.9, 0.999])
def test_normal_inverse_and_distribution(spark, p):
    z = one(spark, N.norm_inv(F.lit(p)))
    assert abs(0.5 * math.erfc(-z / math.sqrt(2)) - p) < 1e-8
    assert abs(one(spark, N.norm_cdf(F.lit(z))) - p) < 1e-6


def test_chi_square_tails(spark):
    assert abs(one(spark, N.chi2_survival_even(F.lit(18.307), 10)) - 0.05) < 1e-4
    assert abs(one(spark, chi_square_p9(F.lit(16.919))) - 0.05) < 1e-4


def test_exact_binomial(spark):
    cases = [(3, 20, 0.05), (12, 20, 0.5), (0, 50, 0.1), (300, 2500, 0.1)]
    df = spark.createDataFrame([(i, k, n, r) for i, (k, n, r) in enumerate(cases)],
                               "id int, k long, n long, rate double")
    got = {r.id: r.p for r in binomial_tests(df, ["id"]).collect()}
    for i, (k, n, r) in enumerate(cases):
        m = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
             + j * math.log(r) + (n - j) * math.log(1 - r) for j in range(n + 1)]
        want = min(1.0, sum(math.exp(x) for x in m if x <= m[k] + 1e-9))
        assert abs(got[i] - want) < 1e-9


@pytest.mark.parametrize("text,value", [
    ("1,234", 1234.0), ("1,5", 1.5), ("0,123", 0.123), ("1.234,56", 1234.56), ("1,234.56", 1234.56),
    ("12 345,6 %", 12345.6), ("1'000", 1000.0), ("-3.5", -3.5), ("1,234,567", 1234567.0), ("n/a", None),
    ("", None), ("abc", None), ("1e5", 1e5), ("-", None)])
def test_number_texts(spark, text, value):
    assert one(spark, X.to_number(F.lit(text))) == value


@pytest.mark.parametrize("header,role", [
    ("Net Profit", "profit"), ("Equity DD %", "drawdown"), ("Result", "result"),
    ("Forward Result", "forward_result"), ("Factor de beneficio", "profit_factor"),
    ("StopLoss", None), ("Profit target", None)])
def test_metric_roles(spark, header, role):
    assert one(spark, X.metric_role(F.lit(header))) == role


def test_step_down_equals_holm(spark):
    import random
    from plateauscope.operators import evaluate as V
    rng = random.Random(12)
    for case in range(6):
        ps = [rng.choice([0.0, 1e-9, 0.001, 0.002, 0.004, 0.01, 0.05, 0.2, rng.random() * 0.01])
              for _ in range(rng.choice([0, 1, 7, 40]))]
        df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
        got = {r.i: r.significant for r in V.holm(df).collect()}
        want, stopped = {}, False
        for place, (p, i) in enumerate(sorted((p, i) for i, p in enumerate(ps))):
            stopped = stopped or p * (len(ps) - place) >= V.ALPHA
            want[i] = not stopped
        assert got == want
