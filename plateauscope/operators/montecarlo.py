"""Resampling of trading days: bootstrap, predictive forecasts and order luck.

Trades are reduced to one summary per day first (total, extreme prefixes, fall inside
the day, losing streaks). Day summaries compose exactly, so a simulated path needs
days, not trades; a report carries at most one entry per calendar day, however many
trades it holds. Spark spreads (report, block of simulations) tasks; inside a task
NumPy advances all paths of the block one day at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import DRAW_STEP, floor_quantile
from .trades import REPORT, block_length

# The task functions below travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Seeds and sizes of the simulations.
BOOTSTRAP_SEED = 20260924
FORECAST_SEED = 20261014
ORDER_SEED = 20261015
CALIBRATION_MASK = 0x5BD1E995
HORIZONS = (126, 252)
LOSS_HORIZONS = (63, 126, 252)
MIN_ORDER_TRADES = 30
SIM_BLOCK = 250
GRID_POINTS = 120
TASK_TRADES = 100_000  # trades that a task puts in order

DAY_FIELDS = ("total", "hi", "lo", "fall", "count", "lead", "tail", "longest", "won")


def uniforms(seed: int, n: np.ndarray) -> np.ndarray:
    """The seeded draws of ``functions.numeric.uniform`` for an array of counters."""
    word = np.uint64(0xFFFFFFFF)
    s = (np.uint64(seed) + n.astype(np.uint64) * np.uint64(DRAW_STEP)) & word
    t = ((s ^ (s >> np.uint64(15))) * (s | np.uint64(1))) & word
    t = ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & word)) & word) ^ t
    return ((t ^ (t >> np.uint64(14))) & word) / 4294967296.0


def _by_day(df: DataFrame, trades: int) -> DataFrame:
    """Rows with those of their day, in as many tasks as the number of trades asks for.

    Narrow rows are small as files and several times that in memory, so the size of files does not decide.
    """
    return df.repartition(max(1, trades // TASK_TRADES), *REPORT, "day_idx")


def day_summaries(trades: DataFrame, daily: DataFrame) -> DataFrame:
    """One array row per report with the summary of every day of its calendar.

    ``trades``: report_id, day_idx, seq, inc. The windows run inside one day; trades are moved and put in
    order once.
    """
    w = Window.partitionBy(*REPORT, "day_idx").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, 0)
    t = _by_day(trades, trades.count()).withColumn("_c", F.sum("inc").over(w))
    t = t.withColumn("_p", F.greatest(F.lit(0.0), F.max("_c").over(w)))
    t = t.withColumn("_wins", F.sum((F.col("inc") > 0).cast("int")).over(w))
    runs = t.groupBy(*REPORT, "day_idx", "_wins").agg(
        F.count_if(F.col("inc") < 0).alias("_losses"), F.sum("inc").alias("total"), F.max("_p").alias("hi"),
        F.min("_c").alias("lo"), F.max(F.col("_p") - F.col("_c")).alias("fall"),
        F.count(F.lit(1)).alias("count"))
    per = runs.groupBy(*REPORT, "day_idx").agg(
        F.sum("total").alias("total"), F.max("hi").alias("hi"),
        F.least(F.lit(0.0), F.min("lo")).alias("lo"), F.max("fall").alias("fall"),
        F.sum("count").alias("count"), F.max("_losses").alias("longest"),
        (F.max("_wins") > 0).alias("won"), F.max_by("_losses", "_wins").alias("tail"),
        F.coalesce(F.max(F.when(F.col("_wins") == 0, F.col("_losses"))), F.lit(0)).alias("lead"))
    full = daily.select(*REPORT, "day_idx").join(per, [*REPORT, "day_idx"], "left")
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in DAY_FIELDS]
    packed = full.select(*REPORT, F.struct("day_idx", *zero).alias("d"))
    days = packed.groupBy(*REPORT).agg(F.sort_array(F.collect_list("d")).alias("d"))
    return days.select(*REPORT, *[F.col("d")[c].alias(c) for c in DAY_FIELDS])


def _tasks(days: DataFrame, sims: int, *extra) -> DataFrame:
    blocks = -(-sims // SIM_BLOCK)
    t = days.select(*days.columns, *extra, F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block_no"))
    return t.repartition(*REPORT, "block_no")


def _starts(u: np.ndarray, n: int) -> np.ndarray:
    return np.minimum((u * n).astype(np.int64), n - 1)


def _walk(idx: np.ndarray, days: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Total and maximum fall of each row of day indices (paths x days)."""
    paths = idx.shape[0]
    cum, peak, fall = np.zeros(paths), np.zeros(paths), np.zeros(paths)
    for t in range(idx.shape[1]):
        d = idx[:, t]
        fall = np.maximum(np.maximum(fall, days["fall"][d]), peak - (cum + days["lo"][d]))
        peak = np.maximum(peak, cum + days["hi"][d])
        cum = cum + days["total"][d]
    return cum, fall


def _stationary(seed: int, rows: np.ndarray, n: int, length: int, p: float, lane: int) -> np.ndarray:
    """Circular block indices (rows x length): geometric blocks of mean 1/p."""
    out = np.empty((len(rows), length), dtype=np.int64)
    base = rows.astype(np.uint64) * np.uint64(2 * length) + np.uint64(lane * 1000003)
    for t in range(length):
        jump = _starts(uniforms(seed, base + np.uint64(2 * t + 1)), n)
        if t == 0:
            out[:, 0] = jump
        else:
            cut = uniforms(seed, base + np.uint64(2 * t + 2)) < p
            out[:, t] = np.where(cut, jump, (out[:, t - 1] + 1) % n)
    return out


def _urn(seed: int, rows: np.ndarray, n: int, length: int, p: float) -> np.ndarray:
    """Block indices whose starts follow Dirichlet(1) weights, drawn as a Polya urn."""
    out = np.empty((len(rows), length), dtype=np.int64)
    drawn = np.zeros((len(rows), length), dtype=np.int64)
    k = np.zeros(len(rows), dtype=np.int64)
    base = rows.astype(np.uint64) * np.uint64(2 * length)
    who = np.arange(len(rows))
    for t in range(length):
        u = uniforms(seed, base + np.uint64(2 * t + 1)) * (n + k)
        j = u.astype(np.int64)
        old = np.clip(j - n, 0, length - 1)
        start = np.where(j < n, np.minimum(j, n - 1), drawn[who, old])
        fresh = np.ones(len(rows), bool) if t == 0 else (
            uniforms(seed, base + np.uint64(2 * t + 2)) < p)
        drawn[who[fresh], k[fresh]] = start[fresh]
        k = k + fresh
        out[:, t] = start if t == 0 else np.where(fresh, start, (out[:, t - 1] + 1) % n)
    return out


def _day_arrays(row) -> dict[str, np.ndarray]:
    return {c: np.asarray(getattr(row, c), dtype=float) for c in DAY_FIELDS}


def _block_rows(row, sims: int) -> np.ndarray:
    first = int(row.block_no) * SIM_BLOCK
    return np.arange(first, min(first + SIM_BLOCK, sims))


def stationary_bootstrap(days: DataFrame, sims: int = 10000, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Plug-in bootstrap paths of the daily results: total, fall, sums at the loss horizons."""
    names = [f"sum_{h}" for h in LOSS_HORIZONS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x = np.asarray(row.total, dtype=float)
                n = len(x)
                if n < 5:
                    continue
                rows = _block_rows(row, sims)
                p = 1.0 / max(2, round(np.sqrt(n)))
                steps = x[_stationary(seed, rows, n, n, p, 0)]
                eq = np.cumsum(steps, axis=1)
                peak = np.maximum(np.maximum.accumulate(eq, axis=1), 0)
                out = {"report_id": row.report_id, "sim": rows, "n": n, "total": eq[:, -1],
                       "fall": (peak - eq).max(axis=1)}
                for name, h in zip(names, LOSS_HORIZONS):
                    out[name] = eq[:, min(n, h) - 1]
                yield pd.DataFrame(out)

    schema = "report_id int, sim long, n long, total double, fall double, " + ", ".join(
        f"{c} double" for c in names)
    return _tasks(days.select(*REPORT, "total"), sims).mapInPandas(run, schema)


def bootstrap_summary(paths: DataFrame) -> DataFrame:
    """Quantiles of total and fall, and the loss probability at each horizon."""
    g = paths.groupBy(*REPORT).agg(
        F.sort_array(F.collect_list("total")).alias("_t"),
        F.sort_array(F.collect_list("fall")).alias("_f"), F.max("n").alias("n"),
        F.count(F.lit(1)).alias("sims"), F.avg("total").alias("mean_total"),
        *[F.avg((F.col(f"sum_{h}") < 0).cast("int")).alias(f"loss_{h}") for h in LOSS_HORIZONS])
    q = lambda a, p: floor_quantile(F.col(a), p)
    return g.select(*REPORT, "sims", "n", "mean_total", q("_t", .05).alias("total_p05"),
                    q("_t", .5).alias("total_p50"), q("_t", .95).alias("total_p95"),
                    q("_f", .05).alias("fall_p05"), q("_f", .5).alias("fall_p50"),
                    q("_f", .95).alias("fall_p95"), *[f"loss_{h}" for h in LOSS_HORIZONS])


def mean_interval(summary: DataFrame) -> DataFrame:
    """90 % interval of the daily mean from the bootstrap of the total."""
    return summary.select(*REPORT, "n", *[
        (F.col(f"total_{p}") / F.col("n")).alias(f"mean_{p}") for p in ("p05", "p50", "p95")])


def predictive_paths(days: DataFrame, blocks: DataFrame, horizon: int, sims: int = 10000,
                     seed: int = FORECAST_SEED, method: str = "two_stage",
                     log: bool = False) -> DataFrame:
    """Predictive paths over ``horizon`` days: (report_id, sim, total, fall).

    ``two_stage`` draws a world of n days and then the future from that world;
    ``bayes`` draws block starts from an urn. Horizons beyond the sample give no rows.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                d = _day_arrays(row)
                n = len(d["total"])
                if n < 2 or horizon > n:
                    continue
                p = 1.0 / max(1.0, row.block)
                rows = _block_rows(row, sims)
                if method == "two_stage":
                    world = _stationary(seed, rows, n, n, p, 0)
                    future = _stationary(seed ^ CALIBRATION_MASK, rows, n, horizon, p, 1)
                    idx = np.take_along_axis(world, future, axis=1)
                else:
                    idx = _urn(seed, rows, n, horizon, p)
                cum, fall = _walk(idx, d)
                if log:
                    cum, fall = np.exp(cum) - 1, 1 - np.exp(-fall)
                yield pd.DataFrame({"report_id": row.report_id, "sim": rows, "total": cum,
                                    "fall": fall})

    t = days.select(*REPORT, *DAY_FIELDS).join(blocks.select(*REPORT, "block"), REPORT)
    return _tasks(t, sims).mapInPandas(run, "report_id int, sim long, total double, fall double")


def predictive_summary(paths: DataFrame, levels: tuple[float, ...] = ()) -> DataFrame:
    g = paths.groupBy(*REPORT).agg(
        F.sort_array(F.collect_list("total")).alias("_t"),
        F.sort_array(F.collect_list("fall")).alias("_f"), F.count(F.lit(1)).alias("sims"),
        F.avg((F.col("total") < 0).cast("int")).alias("prob_loss"),
        *[F.avg((F.col("fall") >= lv).cast("int")).alias(f"prob_fall_{i}")
          for i, lv in enumerate(levels)])
    q = lambda a, p: floor_quantile(F.col(a), p)
    return g.select(*REPORT, "sims", q("_t", .05).alias("total_p05"), q("_t", .5)
                    .alias("total_p50"), q("_t", .95).alias("total_p95"),
                    q("_f", .5).alias("fall_p50"), q("_f", .95).alias("fall_p95"), "prob_loss",
                    *[f"prob_fall_{i}" for i in range(len(levels))])


def calibration(days: DataFrame, blocks: DataFrame, horizon: int, outer: int = 200,
                inner: int = 500, seed: int = FORECAST_SEED, log: bool = False) -> DataFrame:
    """Position of a pseudo-future inside its own predictive sample, per outer replicate.

    Each task holds one outer replicate: a resampled history, a future drawn from the
    original days, and the urn forecast made from that history.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                d = _day_arrays(row)
                n = len(d["total"])
                if n < 2 or horizon > n:
                    continue
                p = 1.0 / max(1.0, row.block)
                rep = np.array([int(row.rep)])
                past = _stationary(seed ^ CALIBRATION_MASK, rep, n, n, p, 0)[0]
                future = _stationary(seed ^ CALIBRATION_MASK, rep, n, horizon, p, 1)
                yt, yf = _walk(future, d)
                seen = {k: v[past] for k, v in d.items()}
                idx = _urn(seed + 7919 * (int(row.rep) + 1), np.arange(inner), n, horizon, p)
                ct, cf = _walk(idx, seen)
                v = uniforms(seed, np.array([2 * int(row.rep) + 1, 2 * int(row.rep) + 2]))
                pit = lambda x, y, w: float(((x < y).sum() + w * (x == y).sum()) / len(x))
                yield pd.DataFrame({"report_id": [row.report_id], "rep": [int(row.rep)],
                                    "pit_total": [pit(ct, yt[0], v[0])],
                                    "pit_fall": [pit(cf, yf[0], v[1])]})

    t = days.select(*REPORT, *DAY_FIELDS).join(blocks.select(*REPORT, "block"), REPORT)
    t = t.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    return t.repartition(*REPORT, "rep").mapInPandas(
        run, "report_id int, rep int, pit_total double, pit_fall double")


def calibrated_forecast(days: DataFrame, blocks: DataFrame, horizon: int, sims: int = 10000,
                        outer: int = 200, inner: int = 500, seed: int = FORECAST_SEED,
                        log: bool = False, fall_limit: float | None = None) -> DataFrame:
    """Urn forecast whose quantiles are moved to where past forecasts really fell."""
    main = predictive_paths(days, blocks, horizon, sims, seed, "bayes", log).groupBy(*REPORT).agg(
        F.sort_array(F.collect_list("total")).alias("_t"),
        F.sort_array(F.collect_list("fall")).alias("_f"))
    pits = calibration(days, blocks, horizon, outer, inner, seed, log).groupBy(*REPORT).agg(
        F.sort_array(F.collect_list("pit_total")).alias("_gt"),
        F.sort_array(F.collect_list("pit_fall")).alias("_gf"))
    j = main.join(pits, REPORT)

    def moved(samples: str, pit: str, p: float):
        at = floor_quantile(F.col(pit), p)
        n = F.size(samples)
        return F.get(samples, F.least(n - 1, F.greatest(F.lit(0), F.floor(at * n).cast("int"))))

    share = lambda arr, keep: F.size(F.filter(arr, keep)) / F.size(arr)
    upto = lambda pit, u: share(F.col(pit), lambda x: x <= u)
    out = [moved("_t", "_gt", p).alias(f"total_p{int(100 * p):02d}") for p in (.05, .5, .95)]
    out += [moved("_f", "_gf", p).alias(f"fall_p{int(100 * p)}") for p in (.5, .95)]
    loss = upto("_gt", share(F.col("_t"), lambda x: x < 0))
    if fall_limit is not None:
        out.append((1 - upto("_gf", share(F.col("_f"), lambda x: x < fall_limit)))
                   .alias("prob_fall"))
    return j.select(*REPORT, F.lit(horizon).alias("horizon"), *out, loss.alias("prob_loss"))


def forecast_table(days: DataFrame, daily: DataFrame, allowed: DataFrame | None = None,
                   horizons: tuple[int, ...] = HORIZONS, **options) -> DataFrame:
    """Calibrated forecast at every horizon for the reports that may be forecast."""
    if allowed is not None:
        days = days.join(allowed.select(*REPORT), REPORT, "left_semi")
    blocks = block_length(daily)
    out = None
    for h in horizons:
        f = calibrated_forecast(days, blocks, h, seed=FORECAST_SEED + h, **options)
        out = f if out is None else out.unionByName(f)
    return out


def randomised_pit(sample: DataFrame, observed: DataFrame, keys: list[str], v: float) -> DataFrame:
    """Place of an observation in a sample, ties split at ``v`` (a fixed draw)."""
    j = sample.join(observed, keys)
    below = F.count_if(F.col("x") < F.col("y"))
    equal = F.count_if(F.col("x") == F.col("y"))
    return j.groupBy(*keys).agg(((below + v * equal) / F.count(F.lit(1))).alias("pit"))


def _order_walk(row, sims: int, seed: int, points: int):
    """One block of orders: its paths, and where every path meets the points of the trade grid.

    Days compose: a prefix of a path is its total, its number of trades, its fall and its losing
    streak so far, so running sums over the days of all paths of the block place every grid point.
    """
    d = _day_arrays(row)
    keep = np.flatnonzero(d["count"] > 0)
    n, trades = len(keep), int(d["count"].sum())
    if trades < MIN_ORDER_TRADES or n < 2:
        return None
    rows = _block_rows(row, sims)
    u = uniforms(seed, rows[:, None].astype(np.uint64) * np.uint64(n)
                 + np.arange(1, n + 1, dtype=np.uint64)[None, :])
    perm = keep[np.argsort(u, axis=1, kind="stable")]
    if int(row.block_no) == 0:
        perm, rows = np.vstack([keep[None, :], perm]), np.concatenate([[-1], rows])
    cum, fall = _walk(perm, d)
    streak, longest = np.zeros(len(rows)), np.zeros(len(rows))
    for t in range(n):
        k = perm[:, t]
        longest = np.maximum(np.maximum(longest, streak + d["lead"][k]), d["longest"][k])
        streak = np.where(d["won"][k] > 0, d["tail"][k], streak + d["tail"][k])
    m = min(points, trades)
    grid = np.floor((np.arange(m) + 1) * trades / m + 0.5).astype(np.int64) - 1
    count = d["count"][perm].astype(np.int64)
    ends = np.cumsum(count, axis=1)
    # All paths in one search: each has its own stretch of numbers.
    shift = np.arange(len(rows))[:, None] * (trades + 1)
    at = np.searchsorted((ends + shift).ravel(), (grid[None, :] + shift).ravel(), side="right")
    total = d["total"][perm]
    before = (np.cumsum(total, axis=1) - total).ravel()[at]
    first = (ends - count).ravel()[at]
    place = np.tile(grid, len(rows)) - first + 1
    return rows, cum, fall, longest, grid + 1, perm.ravel()[at], place, before


def order_paths(days: DataFrame, sims: int = 2000, seed: int = ORDER_SEED, log: bool = False,
                points: int = GRID_POINTS, stage=None) -> tuple[DataFrame, DataFrame]:
    """Paths with the trading days in random order, and their points on the trade grid.

    Simulation -1 is the real order. Returns (per path: total, fall, longest losing streak;
    per path and grid point: the day that holds it, the place in it, equity before). Both come from one
    pass; with ``stage`` it is written, so that it runs once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                found = _order_walk(row, sims, seed, points)
                if found is None:
                    continue
                rows, cum, fall, longest, grid, day, place, before = found
                if log:
                    cum, fall = np.exp(cum) - 1, 1 - np.exp(-fall)
                yield pd.DataFrame({"report_id": row.report_id, "sim": rows, "point": 0,
                                    "total": cum, "fall": fall, "longest": longest})
                yield pd.DataFrame({"report_id": row.report_id, "sim": np.repeat(rows, len(grid)),
                                    "point": np.tile(grid, len(rows)), "day_idx": day, "k": place,
                                    "before": before})

    columns = {"report_id": "int", "sim": "long", "point": "long", "total": "double", "fall": "double",
               "longest": "double", "day_idx": "long", "k": "long", "before": "double"}

    def filled(batches):
        for pdf in run(batches):
            yield pdf.reindex(columns=list(columns)).astype(
                {c: "Int64" for c, t in columns.items() if t == "long"})

    both = _tasks(days, sims).mapInPandas(filled, ", ".join(f"{c} {t}" for c, t in columns.items()))
    if stage is not None:
        both = stage(both, "order_paths")
    return (both.filter("point = 0").select(*REPORT, "sim", "total", "fall", "longest"),
            both.filter("point > 0").select(*REPORT, "sim", "point", "day_idx", "k", "before"))


def order_summary(paths: DataFrame) -> DataFrame:
    """Fall and losing streak of the real order against the random ones."""
    real = paths.filter("sim < 0").select(*REPORT, F.col("fall").alias("real_fall"),
                                          F.col("longest").alias("real_streak"))
    j = paths.filter("sim >= 0").join(real, REPORT)
    g = j.groupBy(*REPORT, "real_fall", "real_streak").agg(
        F.sort_array(F.collect_list("fall")).alias("_f"),
        F.sort_array(F.collect_list("longest")).alias("_l"), F.count(F.lit(1)).alias("sims"),
        F.avg((F.col("fall") > F.col("real_fall")).cast("int")).alias("worse_share"),
        F.avg((F.col("fall") < F.col("real_fall")).cast("int")).alias("_below"),
        F.avg((F.col("fall") == F.col("real_fall")).cast("int")).alias("_same"))
    q = lambda a, p: floor_quantile(F.col(a), p)
    return g.select(*REPORT, "sims", "real_fall", "real_streak", q("_f", .05).alias("fall_p05"),
                    q("_f", .5).alias("fall_p50"), q("_f", .95).alias("fall_p95"),
                    q("_l", .5).alias("streak_p50"), q("_l", .95).alias("streak_p95"),
                    (F.col("_below") + 0.5 * F.col("_same")).alias("fall_percentile"), "worse_share")


def order_points(marks: DataFrame, trades: DataFrame, log: bool = False) -> DataFrame:
    """(report, sim, point, x): the equity of every path at its grid points.

    The equity inside a day comes from an equi-join on (report, day, place in day). Trades and points go
    to their day once.
    """
    size = trades.count()
    w = Window.partitionBy(*REPORT, "day_idx").orderBy("seq")
    inside = _by_day(trades, size).select(*REPORT, "day_idx", F.row_number().over(w).cast("long").alias("k"),
                           F.sum("inc").over(w).alias("_in"))
    x = F.col("before") + F.col("_in")
    return _by_day(marks, size).join(inside, [*REPORT, "day_idx", "k"]).select(
        *REPORT, "sim", "point", (F.exp(x) - 1 if log else x).alias("x"))


def order_bands(at: DataFrame) -> DataFrame:
    """p05 to p95 of the equity at each grid point of :func:`order_points`, and the real curve.

    A group holds one number a path.
    """
    g = at.groupBy(*REPORT, "point").agg(
        F.sort_array(F.collect_list(F.when(F.col("sim") >= 0, F.col("x")))).alias("_s"),
        F.max(F.when(F.col("sim") < 0, F.col("x"))).alias("real"))
    return g.select(*REPORT, "point", *[floor_quantile(F.col("_s"), p).alias(
        f"p{int(100 * p):02d}") for p in (.05, .25, .5, .75, .95)], "real")


def order_curves(at: DataFrame, curves: int = 100) -> DataFrame:
    """(report, sim, curve): the first ``curves`` paths as arrays over the grid, and the real one (-1)."""
    some = at.filter(F.col("sim") < curves)
    return some.groupBy(*REPORT, "sim").agg(
        F.array_sort(F.collect_list(F.struct("point", "x"))).alias("_c")).select(
        *REPORT, "sim", F.col("_c")["point"].alias("points"), F.col("_c")["x"].alias("curve"))
