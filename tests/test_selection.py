"""Selection fragility: samples, cuts and shares held against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateauscope.functions.numeric import uniform
from plateauscope.operators import selection as X
from plateauscope.plans.stages import stage


def expected(rows, a, b, repeats, seed=X.FRAGILITY_SEED, fraction=0.5):
    n = len(rows)
    take = int(max(10, min(n - 1, n * fraction // 1)))
    share = []
    for train, test, s in ((a, b, seed), (b, a, seed ^ X.REVERSE_MASK)):
        under = 0
        for rep in range(1, repeats + 1):
            u = X.draws(np.array([(s + rep * X.REPEAT_STEP) % X.WORD]), rows)[0]
            took = np.lexsort((rows, u))[:take]
            best = took[np.lexsort((rows[took], -train[took]))[0]]
            under += (test[took] < test[best]).sum() / take < 0.5
        share.append(under / repeats)
    return take, share


def test_draws_are_those_of_the_column_expression(spark):
    rows = np.array([0, 1, 7, 65535, 2 ** 31, 2 ** 32 - 2, 123456789])
    streams = np.array([5, 20260919 + 7919, 2 ** 32 - 1])
    got = X.draws(streams, rows)
    df = spark.createDataFrame([(int(s), int(r)) for s in streams for r in rows], "s long, r long")
    want = [x.u for x in df.select(uniform(F.col("s"), F.col("r") + 1).alias("u")).collect()]
    assert (got.ravel() / 4294967296.0).tolist() == want


@pytest.mark.parametrize("block,compared", [(8192, 1024), (64, 1), (64, 30)])
def test_fragility_equals_numpy(spark, monkeypatch, block, compared):
    monkeypatch.setattr(X, "BLOCK_ROWS", block)
    monkeypatch.setattr(X, "COMPARED", compared)
    monkeypatch.setattr(X, "CELLS", 1 << 20 if block > 64 else 500)
    rng = np.random.default_rng(block + compared)
    data, want = [], {}
    for study, n in (("few", 19), ("least", 20), ("some", 333), ("many", 1500)):
        rows = np.sort(rng.choice(10 * n, n, replace=False))
        a = np.round(rng.normal(size=n), 1)  # many ties
        b = np.round(0.3 * a + rng.normal(size=n), 1)
        data += [(study, int(r), float(x), float(y)) for r, x, y in zip(rows, a, b)]
        if n >= 20:
            want[study] = (n, *expected(rows, a, b, 60))
    data += [("some", 10 ** 6, None, 1.0), ("nulls", 1, None, None)]
    df = spark.createDataFrame(data, "study_id string, row_idx long, a double, b double").repartition(3)
    got = {r.study_id: r for r in X.selection_fragility(df, stage, repeats=60).collect()}
    assert got.keys() == want.keys()
    for study, (n, take, share) in want.items():
        r = got[study]
        assert (r.n, r.take, r.repeats) == (n, take, 60)
        assert [r.is_to_oos, r.oos_to_is] == pytest.approx(share)
        assert r.fragility == max(r.is_to_oos, r.oos_to_is)


def test_last_draws_outside_the_first_interval(spark, monkeypatch):
    """Draws far from uniform: the search leaves its interval downwards or upwards."""
    rows = np.arange(400)
    made = X.draws
    for shift in (1, 30):
        monkeypatch.setattr(X, "draws", lambda s, r, k=shift: (
            made(s, r) >> np.uint32(k) if k > 1 else made(s, r) | np.uint32(1 << 31)))
        df = spark.createDataFrame([("s", int(i), float(i % 7), float(i % 5)) for i in rows],
                                   "study_id string, row_idx long, a double, b double")
        sizes = spark.createDataFrame([("s", 400, 200)], "study_id string, n long, take long")
        blocks = X._blocks(df, stage)
        got = {r.k: (r.cut, r.last) for r in X.last_draws(blocks, sizes, 77, 5, stage).collect()}
        streams = X._streams(77, 5)
        for k, s in enumerate(streams):
            u = X.draws(np.array([s]), rows)[0]
            last = np.lexsort((rows, u))[199]
            assert got[k] == (int(u[last]), int(rows[last]))


def test_no_pairs(spark):
    none = spark.createDataFrame([], "study_id string, row_idx long, a double, b double")
    assert X.selection_fragility(none, stage, repeats=5).count() == 0
