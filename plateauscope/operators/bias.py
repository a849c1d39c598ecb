"""Selection bias: rank agreement, fragility, chance thresholds, shrinkage, perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import (expected_maximum, max_quantile_z, sorted_quantile, uniform)
from . import plateau as P
from .ordering import attach, medians, quantiles, with_ranks
from .selection import FRAGILITY_SEED, MIN_PAIRS, REVERSE_MASK, selection_fragility  # noqa: F401

# Seeds of the resampling operators.
SHRINK_SEED = 20261014
SHARPE_MIN_TRADES = 30
MIN_UNITS = 30
MIN_BLOCKS = 10


def criterion_pairs(cells: DataFrame) -> DataFrame:
    """(study_id, row_idx, a, b): the user's criterion on both periods, else quality."""
    return cells.filter("known").select(
        "study_id", "row_idx", F.coalesce("criterion_is", "quality_is").alias("a"),
        F.coalesce("criterion_oos", "quality_oos").alias("b"), "quality_is", "quality_oos")


def summary_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, extent, mean, deviation, quartiles and MAD per key."""
    from .ordering import mad
    base = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    q = quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.join(q, keys, "left").join(mad(df, keys, value), keys, "left")


def percentile_ranks(df: DataFrame, keys: list[str], value: str, row: str, out: str) -> DataFrame:
    """Average rank over the count, in (0, 1]; NULL without a value."""
    r = with_ranks(df, keys, value, row, "_p")
    return r.withColumn(out, (F.col("_p_below") + (F.col("_p_ties") + 1) / 2) / F.col("_p_n")
                        ).drop("_p_n", "_p_below", "_p_ties")


def spearman(df: DataFrame, keys: list[str], a: str, b: str, row: str = "row_idx") -> DataFrame:
    """Rank correlation over rows with both values; ranks use each column's own rows."""
    r = percentile_ranks(df, keys, a, row, "_ra")
    r = percentile_ranks(r, keys, b, row, "_rb")
    pairs = r.filter("_ra IS NOT NULL AND _rb IS NOT NULL")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.when(
        F.count(F.lit(1)) >= 3, F.corr("_ra", "_rb")).alias("spearman"))


def decile_degradation(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Medians of both periods per decile of the optimised value (floor boundaries)."""
    ok = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select("study_id", "row_idx", "a", "b")
    r = with_ranks(ok, ["study_id"], "a", "row_idx", "_d", position=True).filter(
        F.col("_d_n") >= 3 * bins)
    # Bin k holds positions floor(k n / bins) .. floor((k+1) n / bins) - 1.
    guess = F.floor(F.col("_d_pos") * bins / F.col("_d_n"))
    start = lambda k: F.floor(k * F.col("_d_n") / bins)
    k = F.when(start(guess + 1) <= F.col("_d_pos"), guess + 1).otherwise(guess)
    r = r.withColumn("decile", (k + 1).cast("int"))
    keys = ["study_id", "decile"]
    med = medians(r, keys, {"is_median": "a", "oos_median": "b"})
    q25 = quantiles(r, keys, "b", {"oos_q25": 0.25}, count="count")
    return med.join(q25, keys)


def sharpe_selection(cells: DataFrame) -> DataFrame:
    """Best Sharpe against the 95 % threshold of the best of as many random passes."""
    m = F.when(F.col("has_forward"), F.when(F.col("known"), F.col("oos"))).otherwise(F.col("is"))
    r = cells.select("study_id", "has_forward", m["sharpe"].alias("s"), m["trades"].alias("t"))
    r = r.filter(F.col("s").isNotNull() & (F.col("t") > SHARPE_MIN_TRADES))
    g = r.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("trials"), F.stddev_samp("s").alias("sigma"),
        F.avg("s").alias("mean"), F.max("s").alias("observed_max"),
        F.max("has_forward").alias("_f")).filter((F.col("trials") >= 30) & (F.col("sigma") > 1e-12))
    return g.select("study_id", F.when(F.col("_f"), "oos").otherwise("is").alias("period"),
                    "trials", "sigma", "mean", "observed_max",
                    (F.col("sigma") * max_quantile_z(F.col("trials"))).alias("chance_max"),
                    expected_maximum(F.lit(0.0), F.col("sigma"), F.col("trials"))
                    .alias("chance_mean"))


def neighbour_noise(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Noise variance from one-step pairs, and the correlation of neighbours' Sharpe."""
    s = cells.select("study_id", "row_idx", F.when(
        F.col("has_forward"), F.col("oos.sharpe")).otherwise(F.col("is.sharpe")).alias("s")).filter(
        "s IS NOT NULL")
    e = edges.filter("dist = 1 AND src < dst").select("study_id", "src", "dst")
    p = (e.join(s.select("study_id", F.col("row_idx").alias("src"), F.col("s").alias("x")),
                ["study_id", "src"])
         .join(s.select("study_id", F.col("row_idx").alias("dst"), F.col("s").alias("y")),
               ["study_id", "dst"]))
    return p.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.avg(F.pow(F.col("x") - F.col("y"), F.lit(2.0))) / 2).alias("noise_variance"),
        F.corr("x", "y").alias("neighbour_correlation"))


# --------------------------------------------------------------------------
# Shrinkage
# --------------------------------------------------------------------------

def per_trade(m: Column) -> Column:
    return F.coalesce(m["expected_payoff"], F.when(m["trades"] > 0, m["profit"] / m["trades"]))


def _effective(m: Column, inv: Column, noise: str) -> Column:
    if noise == "mean":
        return m * m / inv
    return F.lit(1.0) if noise == "flat" else m / inv


def units(cells: DataFrame, edges: DataFrame, noise: str = "harmonic",
          unit: str = "neighbourhood") -> DataFrame:
    """Mean result per trade of each passing row with its neighbours, on both periods."""
    val = cells.select(
        "study_id", "row_idx", F.col("is.trades").alias("ti"), per_trade(F.col("is")).alias("xi"),
        F.when(F.col("known"), F.col("oos.trades")).alias("to"),
        F.when(F.col("known"), per_trade(F.col("oos"))).alias("xo"))
    own = cells.filter(F.col("has_forward") & (F.size("fails_is") == 0)).select(
        "study_id", F.col("row_idx").alias("unit"), "known")
    links = own.select("study_id", "unit", F.col("unit").alias("row_idx"))
    if unit != "config":
        links = links.unionByName(edges.select("study_id", F.col("src").alias("unit"),
                                               F.col("dst").alias("row_idx")).join(
            own.select("study_id", "unit"), ["study_id", "unit"], "left_semi"))
    g = links.join(val, ["study_id", "row_idx"]).groupBy("study_id", "unit").agg(*[a for p in "io" for a in (
        F.avg(F.when(F.col(f"t{p}") > 0, F.col(f"x{p}"))).alias(f"x{p}"),
        F.count(F.when((F.col(f"t{p}") > 0), F.col(f"x{p}"))).alias(f"m{p}"),
        F.sum(F.when((F.col(f"t{p}") > 0) & F.col(f"x{p}").isNotNull(), 1 / F.col(f"t{p}")))
        .alias(f"v{p}"))])
    out = g.join(own, ["study_id", "unit"])
    return out.select(
        "study_id", F.col("unit").alias("row_idx"), "xi",
        F.when(F.col("mi") > 0, _effective(F.col("mi"), F.col("vi"), noise)).alias("ti"),
        F.when(F.col("known"), F.col("xo")).alias("xo"),
        F.when(F.col("known") & (F.col("mo") > 0), _effective(F.col("mo"), F.col("vo"), noise))
        .alias("to"))


STATS = ("n", "sx", "se", "nf", "fx", "fy", "fxx", "fxy", "fyy", "feo")


def sufficient(df: DataFrame, keys: list[str]) -> DataFrame:
    """Additive sums from which the shrinkage model of any set of units is refitted."""
    ok = df.filter(F.col("xi").isNotNull() & (F.col("ti") > 0)
                   & (F.col("xo").isNull() | (F.col("to") > 0)))
    f = F.col("xo").isNotNull()
    s = lambda e: F.sum(F.when(f, e).otherwise(0.0))
    xi, xo = F.col("xi"), F.col("xo")
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("xi").alias("sx"),
        F.sum(1 / F.col("ti")).alias("se"), F.count_if(f).cast("double").alias("nf"),
        s(xi).alias("fx"), s(xo).alias("fy"), s(xi * xi).alias("fxx"), s(xi * xo).alias("fxy"),
        s(xo * xo).alias("fyy"), s(1 / F.col("to")).alias("feo"))


def fit_model(sums: DataFrame, keys: list[str], min_units: int = MIN_UNITS) -> DataFrame:
    """Regression of the forward on the optimised value, clipped, and its variances."""
    m = sums.filter((F.col("n") >= min_units) & (F.col("nf") >= min_units))
    sxx = F.col("fxx") - F.col("fx") * F.col("fx") / F.col("nf")
    sxy = F.col("fxy") - F.col("fx") * F.col("fy") / F.col("nf")
    syy = F.col("fyy") - F.col("fy") * F.col("fy") / F.col("nf")
    m = m.select("*", sxx.alias("_xx"), sxy.alias("_xy"), syy.alias("_yy")).filter("_xx > 0")
    m = m.withColumn("beta", F.col("_xy") / F.col("_xx"))
    m = m.withColumn("b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("beta"))))
    m = m.withColumn("a", (F.col("fy") - F.col("b") * F.col("fx")) / F.col("nf"))
    rss = F.col("_yy") - 2 * F.col("b") * F.col("_xy") + F.col("b") * F.col("b") * F.col("_xx")
    ei = F.col("se") / F.col("n")
    m = m.withColumn("k", rss / F.greatest(F.lit(1.0), F.col("nf") - 2)
                     / (F.col("b") * ei + F.col("feo") / F.col("nf")))
    return m.select(*keys, "beta", "a", "b", "k", (F.col("b") * F.col("k") * ei).alias("v"),
                    (F.col("a") + F.col("b") * F.col("sx") / F.col("n")).alias("family"),
                    F.col("n").cast("long").alias("units"),
                    F.col("nf").cast("long").alias("forward_units"))


def shrink_model(unit_rows: DataFrame) -> DataFrame:
    return fit_model(sufficient(unit_rows, ["study_id"]), ["study_id"])


def posterior(rows: DataFrame) -> DataFrame:
    """Add ``expected`` and ``variance`` to rows with xi, xo, to and the model columns."""
    m = F.col("a") + F.col("b") * F.col("xi")
    w = F.col("v") / (F.col("v") + F.col("k") / F.col("to"))
    own = F.col("xo").isNotNull() & (F.col("v") > 0)
    return (rows.withColumn("expected", F.when(own, m + w * (F.col("xo") - m)).otherwise(m))
            .withColumn("variance", F.when(own, F.col("v") * (1 - w)).otherwise(F.col("v"))))


def expectation(unit_rows: DataFrame, coarse: DataFrame, targets: DataFrame,
                seed: int = SHRINK_SEED, reps: int = 500) -> tuple[DataFrame, DataFrame]:
    """Block bootstrap of the shrinkage model. Returns (model per study, targets).

    Blocks are reduced to sums first; a replicate draws how often each block
    enters, so a repeat costs one row per block and never touches the units.
    """
    u = unit_rows.join(coarse.select("study_id", "row_idx", F.concat_ws(
        ",", F.transform("coarse", lambda x: x.cast("string"))).alias("block")),
        ["study_id", "row_idx"])
    model = shrink_model(u)
    sums = sufficient(u, ["study_id", "block"])
    w = Window.partitionBy("study_id").orderBy("block")
    sums = sums.withColumn("j", F.row_number().over(w) - 1).withColumn(
        "blocks", F.count(F.lit(1)).over(Window.partitionBy("study_id")))
    sums = sums.filter(F.col("blocks") >= MIN_BLOCKS)
    draws = sums.select("study_id", "j", "blocks", F.explode(
        F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    pick = F.floor(uniform(F.lit(seed) + F.col("rep").cast("long") * 7919, F.col("j") + 1)
                   * F.col("blocks"))
    times = draws.select("study_id", "rep", pick.cast("int").alias("j")).groupBy(
        "study_id", "rep", "j").agg(F.count(F.lit(1)).alias("w"))
    boot = times.join(sums, ["study_id", "j"]).groupBy("study_id", "rep").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in STATS])
    fits = fit_model(boot, ["study_id", "rep"])
    betas = fits.groupBy("study_id").agg(
        F.sort_array(F.collect_list("beta")).alias("_s"), F.count(F.lit(1)).alias("reps"))
    blocks = sums.groupBy("study_id").agg(F.count(F.lit(1)).alias("blocks"))
    out = (model.join(blocks, "study_id").join(betas, "study_id", "left").select(
        *model.columns, "blocks", "reps", sorted_quantile(F.col("_s"), 0.025).alias("beta_lo"),
        sorted_quantile(F.col("_s"), 0.975).alias("beta_hi")))
    t = targets.select("study_id", "row_idx").join(unit_rows, ["study_id", "row_idx"])
    base = posterior(t.join(out, "study_id")).withColumn(
        "own", F.col("expected") - F.col("family"))
    again = posterior(t.join(fits, "study_id")).select(
        "study_id", "row_idx", (F.col("expected") - F.col("family")).alias("_o"))
    spread = again.join(base.select("study_id", "row_idx", "own"), ["study_id", "row_idx"]).groupBy(
        "study_id", "row_idx").agg(
        (F.sum(F.pow(F.col("_o") - F.col("own"), F.lit(2.0)))
         / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("_sd2"))
    res = base.join(spread, ["study_id", "row_idx"]).select(
        "study_id", "row_idx", "expected", "own",
        (F.col("own") - 1.96 * F.sqrt(F.col("variance") + F.col("_sd2"))).alias("own_lo"))
    return out, res


def expectation_table(ranked: DataFrame, cells: DataFrame, predicted: DataFrame) -> DataFrame:
    """Expectation of the top three representatives next to what they showed."""
    top = ranked.filter("rank <= 3").select(
        "study_id", "rank", F.col("representative").alias("row_idx"))
    seen = cells.select("study_id", "row_idx", "pass_id", per_trade(F.col("is")).alias("seen_is"),
                        F.when(F.col("known"), per_trade(F.col("oos"))).alias("seen_oos"))
    return top.join(predicted, ["study_id", "row_idx"]).join(seen, ["study_id", "row_idx"])


def rank_by_expectation(members: DataFrame, cells: DataFrame, unit_rows: DataFrame,
                        lower: bool = False, noise: str = "harmonic") -> DataFrame:
    """Plateau order by the posterior of each plateau taken as one unit."""
    m = members.select("study_id", "row_idx", "component").join(
        cells.select("study_id", "row_idx", "is", "oos", "known"), ["study_id", "row_idx"])
    m = m.select("study_id", "component", per_trade(F.col("is")).alias("xi"),
                 F.col("is.trades").alias("ti"),
                 F.when(F.col("known"), per_trade(F.col("oos"))).alias("xo"),
                 F.when(F.col("known"), F.col("oos.trades")).alias("to"))
    agg = m.groupBy("study_id", "component").agg(*[a for p in "io" for a in (
        F.avg(F.when(F.col(f"t{p}") > 0, F.col(f"x{p}"))).alias(f"x{p}"),
        F.count(F.when(F.col(f"t{p}") > 0, F.col(f"x{p}"))).alias(f"m{p}"),
        F.sum(F.when(F.col(f"x{p}").isNotNull() & (F.col(f"t{p}") > 0), 1 / F.col(f"t{p}")))
        .alias(f"v{p}"))])
    u = agg.withColumn("ti", _effective(F.col("mi"), F.col("vi"), noise)).withColumn(
        "to", F.when(F.col("mo") > 0, _effective(F.col("mo"), F.col("vo"), noise)))
    p = posterior(u.join(shrink_model(unit_rows), "study_id"))
    key = F.col("expected") - 1.96 * F.sqrt("variance") if lower else F.col("expected")
    w = Window.partitionBy("study_id").orderBy(F.desc("key"), "component")
    return (p.withColumn("key", key).withColumn("rank", F.row_number().over(w))
            .select("study_id", "component", "expected", "variance", "key", "rank"))
