"""Evaluation of decisions against known truth, on tables of case results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import uniform
from .ordering import attach, medians, quantiles, value_counts, with_ranks

# Criteria and practical bands of the calibration verdicts.
POSITIVE = ("moderate", "good", "strong")
HIGH = ("good", "strong")
BANDS = {"beyond_p95": (0.05, 0.025, 0.07), "beyond_p50": (0.5, 0.44, 0.56),
         "outside": (0.1, 0.06, 0.13)}
DECILE_BAND = (0.07, 0.13)
ALPHA = 0.05
NODE = ["study_id", "row_idx"]


def _pick(df: DataFrame, key: Column, method: str) -> DataFrame:
    return df.groupBy("study_id").agg(F.max_by("row_idx", F.struct(key, -F.col("row_idx")))
                                      .alias("row_idx")).withColumn("method", F.lit(method))


def baseline_selectors(cells: DataFrame, edges: DataFrame, seed: int = 1) -> DataFrame:
    """Row chosen by five simple rules per study: (study_id, method, row_idx)."""
    p = cells.select(*NODE, "known", "passes_joint", F.col("is.profit").alias("a"),
                     F.col("oos.profit").alias("b"))
    known = p.filter("known")
    r = with_ranks(known, ["study_id"], "a", "row_idx", "_ra", position=True)
    r = with_ranks(r, ["study_id"], "b", "row_idx", "_rb", position=True)
    near = edges.filter("dist = 1").select("study_id", F.col("src").alias("row_idx"), "dst").join(
        p.select("study_id", F.col("row_idx").alias("dst"), F.col("a").alias("x")),
        ["study_id", "dst"]).select(*NODE, "x")
    smooth = near.unionByName(p.select(*NODE, F.col("a").alias("x"))).groupBy(*NODE).agg(
        F.avg("x").alias("m"))
    any_pass = p.withColumn("_u", uniform(seed, F.col("row_idx") + 1))
    return (_pick(p, F.col("a"), "best_optimised")
            .unionByName(_pick(known, F.col("b"), "best_forward"))
            .unionByName(_pick(r, F.col("_ra_pos") + F.col("_rb_pos"), "best_rank_sum"))
            .unionByName(_pick(smooth, F.col("m"), "best_neighbour_mean"))
            .unionByName(_pick(any_pass, F.struct(F.col("passes_joint").cast("int"),
                                                  F.col("_u")), "random_passing")))


def regret(choices: DataFrame, truth: DataFrame) -> DataFrame:
    """Normalised regret of each choice: 0 = the best row, 1 = the median row.

    ``truth``: study_id, row_idx, edge. A choice without row is an abstention and costs 1.
    """
    scale = quantiles(truth, ["study_id"], "edge", {"median": 0.5}, "upper_median").join(
        truth.groupBy("study_id").agg(F.max("edge").alias("oracle")), "study_id")
    j = choices.join(truth, NODE, "left").join(scale, "study_id")
    gap = F.col("oracle") - F.col("median")
    return j.select("study_id", "method", "row_idx", "edge", F.when(
        gap > 1e-9, F.when(F.col("row_idx").isNull(), 1.0).otherwise(
            (F.col("oracle") - F.col("edge")) / gap)).alias("regret"))


def regret_table(cases: DataFrame) -> DataFrame:
    """Median regret and abstention per scenario and method, with a total over scenarios."""
    both = cases.select("*", F.explode(F.array(F.col("scenario"), F.lit("all"))).alias("group"))
    keys = ["group", "method"]
    med = quantiles(both, keys, "regret", {"median_regret": 0.5})
    n = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.avg(
        F.col("row_idx").isNull().cast("int")).alias("abstention"))
    return n.join(med, keys, "left")


def regret_pivot(cases: DataFrame, methods: list[str]) -> DataFrame:
    return regret_table(cases).groupBy("group").pivot("method", methods).agg(
        F.first("median_regret"))


def false_positive_table(cases: DataFrame) -> DataFrame:
    """Share of levels per scenario without edge, with a total row and its criterion."""
    share = lambda names: F.avg(F.col("level").isin(*names).cast("int"))
    g = cases.rollup("scenario").agg(
        F.count(F.lit(1)).alias("cases"), share(POSITIVE).alias("positive"),
        share(HIGH).alias("high"), share(("strong",)).alias("strong"))
    return g.select(F.coalesce("scenario", F.lit("total")).alias("scenario"), "cases", "positive",
                    "high", "strong", ((F.col("positive") <= 0.05) & (F.col("high") <= 0.02)
                                       & (F.col("strong") <= 0.01)).alias("meets"))


def power_table(cases: DataFrame, wanted: float = 0.8) -> DataFrame:
    g = cases.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.col("level").isin(*POSITIVE).cast("int")).alias("power"),
        F.avg(F.col("level").isin(*HIGH).cast("int")).alias("high"))
    return g.withColumn("meets", F.col("power") >= wanted)


def level_coherence(cases: DataFrame) -> DataFrame:
    """Mean true edge of the choice per level."""
    return cases.filter("edge IS NOT NULL").groupBy("level").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("edge").alias("mean_edge"))


def interval_calibration(cases: DataFrame) -> DataFrame:
    """Hit rates of the forecast intervals per cell, PIT deciles and Brier score.

    ``cases``: cell, fall, fall_p50, fall_p95, total, total_p05, total_p95, pit, prob_loss.
    """
    dec = F.least(F.lit(9), F.floor(F.col("pit") * 10))
    hit = lambda c: F.count_if(c)
    return cases.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), hit(F.col("fall") > F.col("fall_p95")).alias("beyond_p95"),
        hit(F.col("fall") > F.col("fall_p50")).alias("beyond_p50"),
        hit((F.col("total") < F.col("total_p05")) | (F.col("total") > F.col("total_p95")))
        .alias("outside"),
        F.avg(F.pow(F.col("prob_loss") - (F.col("total") < 0).cast("int"), F.lit(2.0)))
        .alias("brier"),
        *[hit(dec == i).alias(f"d{i}") for i in range(10)])


def log_factorial(n: Column) -> Column:
    """ln(n!): exact up to 20, Stirling's series beyond (error under 1e-13)."""
    x = n.cast("double")
    series = (x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x)
              - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))))
    return F.when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_tests(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact two-sided binomial test per row (keys, k, n, rate): the mass no likelier than k.

    Outcomes more than forty deviations from the mean weigh less than any double, so
    the sum runs over a stretch that grows with the root of n, as rows, not arrays.
    """
    mean, sd = F.col("n") * F.col("rate"), F.sqrt(F.col("n") * F.col("rate") * (1 - F.col("rate")))
    lo = F.greatest(F.lit(0), F.floor(mean - 40 * sd - 40)).cast("long")
    hi = F.least(F.col("n"), F.ceil(mean + 40 * sd + 40)).cast("long")
    n = F.col("n")
    mass = lambda j: (log_factorial(n) - log_factorial(j) - log_factorial(n - j)
                      + j * F.ln("rate") + (n - j) * F.ln(1 - F.col("rate")))
    t = df.select(*keys, "k", "n", "rate", F.explode(F.sequence(lo, hi)).alias("j"))
    t = t.withColumn("_m", mass(F.col("j"))).withColumn("_k", mass(F.col("k")))
    return t.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(F.when(
        F.col("_m") <= F.col("_k") + 1e-9, F.exp("_m")).otherwise(0.0))).alias("p"))


def chi_square_p9(x: Column) -> Column:
    """P(chi-square with 9 degrees of freedom > x), closed form for odd degrees."""
    from ..functions.numeric import norm_cdf
    root = F.sqrt(x)
    term = root
    total = root
    for odd in (3, 5, 7):
        term = term * x / odd
        total = total + term
    return F.when(x <= 0, 1.0).otherwise(
        2 * norm_cdf(-root) + F.sqrt(F.lit(2 / 3.141592653589793)) * F.exp(-x / 2) * total)


def calibration_tests(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Binomial and decile tests of every cell under Holm-Bonferroni.

    A test fails when it is significant after the correction and its rate leaves the
    practical band. The tests are a handful per cell.
    """
    dec = F.array(*[F.col(f"d{i}") for i in range(10)])
    share = F.transform(dec, lambda d: d / F.col("n"))
    chi = F.aggregate(dec, F.lit(0.0), lambda s, d: s + F.pow(
        d - F.col("n") / 10, F.lit(2.0)) / (F.col("n") / 10))
    rates = [F.struct(F.lit(m).alias("test"), F.col(m).alias("k"), F.lit(p).alias("rate"),
                      F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for m, (p, lo, hi) in BANDS.items()]
    b = counts.select("cell", "n", F.inline(F.array(*rates)))
    b = b.join(binomial_tests(b, ["cell", "test"]), ["cell", "test"])
    seen = F.col("k") / F.col("n")
    b = b.select("cell", "test", seen.alias("rate"), "p",
                 (~seen.between(F.col("lo"), F.col("hi"))).alias("off_band"))
    pit = counts.select("cell", F.lit("pit").alias("test"), chi.alias("rate"), F.exists(
        share, lambda s: ~s.between(*DECILE_BAND)).alias("off_band"))
    pit = pit.select("cell", "test", "rate", chi_square_p9(F.col("rate")).alias("p"), "off_band")
    t = b.unionByName(pit)
    t = holm(t, alpha)
    return t.select("cell", "test", "rate", "p", "off_band", "significant",
                    (F.col("significant") & F.col("off_band")).alias("fails"))


def holm(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add ``significant`` by the step-down of Holm over the column ``p`` of all rows.

    A value fails the step where it, times the tests that are not below it, reaches ``alpha``; of
    equal values the first has the largest factor, so values stand for their ties. Rows below the
    smallest failing value are significant. Values are counted with map-side combine and ranked in
    buckets of their size; no window runs over all tests, and one number comes back to the rows.
    """
    at = tests.withColumn("_all", F.lit(0))
    stop = (value_counts(at, ["_all"], "p")
            .filter(F.col("v") * (F.col("n") - F.col("before")) >= alpha)
            .groupBy("_all").agg(F.min("v").alias("_stop")))
    out = attach(at, stop, ["_all"])
    return out.withColumn("significant", F.col("_stop").isNull() | (F.col("p") < F.col("_stop"))).drop(
        "_all", "_stop")


def smallest_apt(tests: DataFrame, cells: DataFrame) -> DataFrame:
    """Smallest sample size from which every longer one has no failing test, per horizon."""
    bad = tests.filter("fails").select("cell").distinct().withColumn("_bad", F.lit(True))
    c = cells.select("cell", "horizon", "days").join(bad, "cell", "left")
    worst = c.groupBy("horizon").agg(F.max(F.when(F.col("_bad"), F.col("days"))).alias("_w"))
    return c.join(worst, "horizon").groupBy("horizon").agg(F.min(F.when(
        F.col("_w").isNull() | (F.col("days") > F.col("_w")), F.col("days"))).alias("smallest_days"))


def shrinkage_accuracy(cases: DataFrame) -> DataFrame:
    """Error of three expectations against the truth per scenario, and of the lower bound."""
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("truth"), F.lit(2.0))))
    bias = lambda c: F.avg(F.col(c) - F.col("truth"))
    g = cases.rollup("scenario").agg(
        F.count(F.lit(1)).alias("cases"), rmse("seen_is").alias("rmse_is"),
        rmse("seen_oos").alias("rmse_oos"), rmse("expected").alias("rmse_expected"),
        bias("seen_oos").alias("bias_oos"), bias("expected").alias("bias_expected"),
        F.avg((F.col("true_own") < F.col("own_lo")).cast("int")).alias("below_bound"),
        F.avg((F.col("own_lo") > 0).cast("int")).alias("detected"))
    return g.withColumn("scenario", F.coalesce("scenario", F.lit("total")))


def alarm_rates(cases: DataFrame) -> DataFrame:
    """Alarms of the unseen check per group and duration."""
    return cases.groupBy("group", "duration").agg(
        F.count(F.lit(1)).alias("cases"), F.avg((F.col("unseen_level") != "normal").cast("int"))
        .alias("alarms"), F.avg((F.col("unseen_level") == "outside").cast("int")).alias("outside"))


def variant_comparison(base: DataFrame, other: DataFrame) -> DataFrame:
    """Changes of level and choice when a rule is replaced, per scenario.

    Both frames: scenario, seed, level, row_idx, edge.
    """
    j = base.alias("a").join(other.alias("b"), ["scenario", "seed"])
    both = F.col("a.edge").isNotNull() & F.col("b.edge").isNotNull()
    moved = both & (F.col("a.edge") != F.col("b.edge"))
    pos = lambda s: F.avg(F.col(f"{s}.level").isin(*POSITIVE).cast("int"))
    return j.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("a.level") != F.col("b.level")).alias("level_changes"),
        F.count_if(moved).alias("choice_changes"),
        F.count_if(moved & (F.col("b.edge") > F.col("a.edge"))).alias("better"),
        F.count_if(moved & (F.col("b.edge") < F.col("a.edge"))).alias("worse"),
        pos("a").alias("positive_base"), pos("b").alias("positive_other"))


def sharpe_variants(tests: DataFrame, trials: DataFrame, noise: DataFrame) -> DataFrame:
    """Sharpe threshold with all passes, with effective trials, and with neighbour noise."""
    from ..functions.numeric import max_quantile_z
    j = tests.join(trials, "study_id", "left").join(noise, "study_id", "left")
    b = F.col("sigma") * max_quantile_z(F.col("effective_trials"))
    c = F.sqrt("noise_variance") * max_quantile_z(F.col("trials"))
    beats = lambda q: F.col("observed_max") > q
    return j.select("study_id", "chance_max", b.alias("chance_max_cells"),
                    c.alias("chance_max_noise"), beats(F.col("chance_max")).alias("beats"),
                    beats(b).alias("beats_cells"), beats(c).alias("beats_noise"))


def table_order_rule(levels: DataFrame, found: DataFrame) -> DataFrame:
    """Studies whose level hangs on the table-order warning alone."""
    fired = found.filter(F.col("code").startswith("ranking_fails")).select("study_id").distinct()
    j = levels.join(fired.withColumn("fired", F.lit(True)), "study_id", "left").fillna(
        False, ["fired"])
    return j.select("study_id", "level", "fired", (F.col("fired") & (F.col("critical") == 0)
                                                   & F.col("level").isin(*POSITIVE))
                    .alias("would_change"))
