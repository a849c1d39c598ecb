import random

import numpy as np
from pyspark.sql import functions as F

from plateauscope.functions.numeric import order_bucket
from plateauscope.operators import ordering as O


def rows(n=4000, seed=3):
    rng = random.Random(seed)
    pick = lambda: rng.choice([0.0, rng.gauss(0, 1) * 10 ** rng.randint(-6, 6),
                               2.0 ** rng.randint(-9, 9), -2.0 ** rng.randint(-9, 9)])
    return [(i % 3, None if i % 17 == 0 else pick(), i * 40) for i in range(n)]


def test_buckets_keep_the_order(spark):
    values = sorted({r[1] for r in rows() if r[1] is not None}
                    | {np.nextafter(2.0 ** k, 0) for k in range(-8, 9)})
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    b = [r.b for r in df.select("x", order_bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert b == sorted(b)


def test_quantiles_match_brute_force(spark, both_forms):
    data = rows()
    df = spark.createDataFrame(data, "k int, x double, row_idx long")
    out = {r.k: r for r in O.quantiles(df, ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.99},
                                       count="n").collect()}
    up = {r.k: r.m for r in O.quantiles(df, ["k"], "x", {"m": 0.5}, O.UPPER_MEDIAN).collect()}
    fl = {r.k: r.m for r in O.quantiles(df, ["k"], "x", {"m": 0.25}, O.FLOOR_N1).collect()}
    for k in range(3):
        v = sorted(x for g, x, _ in data if g == k and x is not None)
        assert out[k].n == len(v)
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
            assert np.isclose(out[k][name], np.quantile(v, q), rtol=1e-12, atol=1e-12)
        assert up[k] == v[len(v) // 2] and fl[k] == v[int((len(v) - 1) * 0.25)]


def test_ranks_and_positions(spark, both_forms):
    data = rows()
    df = spark.createDataFrame(data, "k int, x double, row_idx long")
    got = {r.row_idx: r for r in O.with_ranks(df, ["k"], "x", "row_idx", "_r", True).collect()}
    for k in range(3):
        v = sorted((x, i) for g, x, i in data if g == k and x is not None)
        for pos, (x, i) in enumerate(v):
            r = got[i]
            assert r["_r_pos"] == pos and r["_r_n"] == len(v)
            assert r["_r_below"] == sum(1 for y, _ in v if y < x)
    assert all(got[i]["_r_n"] is None for _, x, i in data if x is None)


def test_running_totals(spark, both_forms):
    rng = random.Random(1)
    data = [(k, i // 10, i, rng.randint(-9, 9)) for k in range(2) for i in range(200)]
    df = spark.createDataFrame(data, "k int, day int, i int, v int").repartition(4)
    got = {(r.k, r.i): r for r in O.running_totals(df, ["k"], "day", ["i"], {"c": "v"}, "c").collect()}
    for k in range(2):
        c = p = 0
        for _, _, i, v in sorted(d for d in data if d[0] == k):
            c += v
            p = max(p, c)
            assert (got[k, i]["c"], got[k, i]["c_peak"]) == (c, p)


def test_running_falls(spark, both_forms):
    rng = random.Random(2)
    data = [(k, i // n, i, rng.randint(-90, 95)) for k, n in ((0, 1), (1, 40), (2, 400)) for i in range(400)]
    df = spark.createDataFrame(data, "k int, day int, i int, v int").repartition(4)
    v = F.col("v").cast("long")
    values = {"plain": v, "moved": v - 20 * F.col("k"), "falling": v - 200}
    got = {(r.k, r.series): r for r in O.running_falls(
        df, ["k"], "day", ["i"], values, 1000, 3).collect()}
    assert len(got) == 9
    for (k, series), r in got.items():
        eq = peak = fall = share = 0
        for _, _, _, x in sorted(d for d in data if d[0] == k):
            eq += x - {"plain": 0, "moved": 20 * k, "falling": 200}[series]
            peak = max(peak, eq)
            fall, share = max(fall, peak - eq), max(share, 100 * float(peak - eq) / (peak + 1000))
        assert (r.fall, r.drawdown) == (fall, share)


def test_rows_of_a_sweep_travel_once(spark):
    """Not once a study: no exchange lies above the copies but those of combined rows."""
    from conftest import SF
    from plateauscope.plans import relations as R
    df = R._period_metrics(R._lines(spark, SF), [], R._studies(), 600000)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [line for line in plan if "Exchange hashpartitioning" in line and ", day#" in line]
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]
