import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from plateauscope.operators import montecarlo as M
from plateauscope.operators import trades as T


def brute_fifo(fills):
    """Queue per symbol and side, one fill at a time."""
    queues, out = {}, {}

    def take(key, volume):
        q, cost, got = queues.setdefault(key, []), 0.0, 0.0
        while volume > 1e-12 and q:
            part = min(volume, q[0][1])
            cost, got, volume = cost + part * q[0][0], got + part, volume - part
            q[0][1] -= part
            if q[0][1] <= 1e-12:
                q.pop(0)
        return cost, got

    for seq, sym, side, direction, volume, price in fills:
        other = "sell" if side == "buy" else "buy"
        held = sum(v for _, v in queues.get((sym, other), []))
        if direction == "in":
            queues.setdefault((sym, side), []).append([price, volume])
            continue
        closing = min(volume, held) if direction == "in/out" else volume
        if closing > 1e-12:
            cost, got = take((sym, other), closing)
            out[seq] = (got, cost / got if abs(got - closing) <= 1e-9 and got > 0 else None)
        if direction == "in/out" and volume - closing > 1e-12:
            queues.setdefault((sym, side), []).append([price, volume - closing])
    return out


def check_fifo(spark, fills):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, s, sym, t0 + dt.timedelta(minutes=s), side, d, float(v), float(p))
         for s, sym, side, d, v, p in fills],
        "report_id int, seq long, symbol string, ts timestamp, side string, direction string, "
        "volume double, price double")
    got = {r.seq: r for r in T.match_fifo(df).collect()}
    want = brute_fifo(fills)
    assert set(got) == set(want)
    for seq, (matched, price) in want.items():
        assert abs(got[seq].matched - matched) < 1e-6
        assert (price is None) == (got[seq].open_price is None)
        if price is not None:
            assert abs(got[seq].open_price - price) < 1e-6


def test_fifo_with_two_sides_and_shortfalls(spark, both_forms):
    rng = random.Random(5)
    fills = [(i, rng.choice("AB"), rng.choice(["buy", "sell"]), rng.choice(["in", "out"]),
              rng.randint(1, 9), rng.randint(90, 110)) for i in range(300)]
    check_fifo(spark, fills)


def test_fifo_with_reversals(spark, both_forms):
    rng, fills, pos = random.Random(8), [], 0
    for i in range(120):
        v, side = rng.randint(1, 6), rng.choice(["buy", "sell"])
        sign = 1 if side == "buy" else -1
        kind = "in" if pos * sign >= 0 else "out" if v <= abs(pos) else "in/out"
        pos += sign * v
        fills.append((i, "A", side, kind, v, rng.randint(90, 110)))
    check_fifo(spark, fills)


def test_fifo_keeps_what_several_joins_read(spark):
    from plateauscope.plans.stages import stage
    rng, kept = random.Random(6), []
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, s, rng.choice("AB"), t0 + dt.timedelta(minutes=s), rng.choice(["buy", "sell"]),
          rng.choice(["in", "out"]), float(rng.randint(1, 9)), float(rng.randint(90, 110))) for s in range(200)],
        "report_id int, seq long, symbol string, ts timestamp, side string, direction string, "
        "volume double, price double")

    def keep(frame, label):
        kept.append(label)
        return stage(frame, label)

    got = T.match_fifo(df, keep)
    assert kept == ["legs", "queues", "closes"]
    assert got.dtypes == T.match_fifo(df).dtypes
    rows = lambda x: sorted(((r.seq, r.symbol, r.position_side, round(r.matched, 6), r.open_ts,
                              r.open_price and round(r.open_price, 6)) for r in x.collect()), key=str)
    assert str(rows(got)) == str(rows(T.match_fifo(df)))


def deals(spark, rows):
    return spark.createDataFrame(
        [(1, i + 1, d, n, 1.0, 100000 + sum(x for _, x in rows[:i + 1])) for i, (d, n) in enumerate(rows)],
        "report_id int, seq long, day date, net_cents long, volume double, balance_cents long")


def test_weekdays_are_filled_and_weekends_kept(spark):
    d = deals(spark, [(dt.date(2024, 1, 5), 100), (dt.date(2024, 1, 5), -30), (dt.date(2024, 1, 10), 5)])
    s = T.daily_series(d).orderBy("day_idx").collect()
    assert [str(r.day) for r in s] == ["2024-01-05", "2024-01-08", "2024-01-09", "2024-01-10"]
    assert [r.pnl_cents for r in s] == [70, 0, 0, 5]


def test_next_value_across_blocks(spark, both_forms):
    df = spark.createDataFrame([(1, i * 40000, float(i)) for i in range(50)], "report_id int, seq long, volume double")
    got = {r.seq: r.next_volume for r in T.next_in_order(df, ["report_id"], "seq", ["volume"]).collect()}
    assert got == {i * 40000: (float(i + 1) if i < 49 else None) for i in range(50)}


def arrays(spark, days):
    rows = [(1, i, 1000 * i + k, float(x)) for i, day in enumerate(days) for k, x in enumerate(day)]
    trades = spark.createDataFrame(rows, "report_id int, day_idx long, seq long, inc double")
    cal = spark.createDataFrame([(1, i) for i in range(len(days))], "report_id int, day_idx long")
    return M.day_summaries(trades, cal)


def test_identical_days_give_exact_totals(spark):
    blocks = spark.createDataFrame([(1, 3.0)], "report_id int, block double")
    for method in ("two_stage", "bayes"):
        p = M.predictive_paths(arrays(spark, [[5.0]] * 40), blocks, 20, sims=50, method=method).collect()
        assert len(p) == 50 and {(r.total, r.fall) for r in p} == {(100.0, 0.0)}


def test_fall_inside_a_day_counts(spark):
    p = M.order_paths(arrays(spark, [[10.0, -30.0, 25.0]] * 12), sims=20)[0].collect()
    assert {r.fall for r in p} == {30.0}


def test_day_summaries_compose_like_the_trades(spark):
    rng = random.Random(2)
    days = [[rng.randint(-9, 9) for _ in range(rng.randint(0, 5))] for _ in range(60)]
    real = M.order_paths(arrays(spark, days), sims=1)[0].filter("sim < 0").first()
    cum = peak = fall = streak = longest = 0
    for x in (v for d in days for v in d):
        cum += x
        peak, fall = max(peak, cum), max(fall, peak - cum)
        streak = streak + 1 if x < 0 else 0 if x > 0 else streak
        longest = max(longest, streak)
    fall = max(fall, 0)
    assert (real.total, real.fall, real.longest) == (cum, fall, longest)
    assert np.isfinite(real.total)


def moves(df):
    """The exchanges of a plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in plan if "Exchange hashpartitioning" in line]


def test_deals_are_moved_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "TASK_TRADES", 2)
    d = deals(spark, [(dt.date(2024, 1, 5), 100), (dt.date(2024, 1, 5), -30), (dt.date(2024, 1, 10), 5),
                      (dt.date(2024, 1, 12), 7), (dt.date(2024, 1, 12), -1), (dt.date(2024, 1, 12), 3)])
    T.daily_series(d).write.parquet(str(tmp_path / "daily"))
    daily = spark.read.parquet(str(tmp_path / "daily"))
    trades = T.day_trades(d, daily=daily)
    assert moves(trades) == []
    assert sorted(r.inc for r in trades.collect()) == [-30.0, -1.0, 3.0, 5.0, 7.0, 100.0]
    found = M.day_summaries(trades, daily)
    assert len([line for line in moves(found) if "REPARTITION_BY_NUM" in line and ", 3)" in line]) == 1
    r = found.collect()[0]
    assert list(r.total) == [70.0, 0.0, 0.0, 5.0, 0.0, 9.0] and list(r.fall) == [30.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_unreadable_day_drops_the_report(spark):
    d = deals(spark, [(dt.date(2024, 1, 5), 100), (None, 5)]).unionByName(
        deals(spark, [(dt.date(2024, 1, 8), 3)]).withColumn("report_id", F.lit(2)))
    assert [(r.report_id, r.pnl_cents) for r in T.daily_series(d).collect()] == [(2, 3)]
    assert [r.report_id for r in T.day_trades(d).collect()] == [2]
