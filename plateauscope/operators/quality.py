"""Policy, gates and the quality score of a pass (absolute, never a percentile)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import FLOOR_N1, attach, mad, medians, quantiles

# Default limits, anchor points and axis weights of the score.
DEFAULT_GATES = {"require_profit": True, "min_profit_factor": 1.2, "max_drawdown_pct": 20.0,
                 "min_trades": 100.0}
DEFAULT_ANCHORS = {"profit_factor": (1.0, 1.5), "recovery_factor": (0.0, 3.0),
                   "drawdown": (30.0, 5.0), "sharpe": (0.0, 2.5), "trades": (50.0, 500.0)}
AXES = {"return": (0.30, {"profit_factor": 1.0}),
        "risk": (0.35, {"drawdown": 1.0}),
        "efficiency": (0.25, {"recovery_factor": 0.6, "sharpe": 0.4}),
        "evidence": (0.10, {"trades": 1.0})}
SCORE_FLOOR = 0.02
LENGTH_RATIO_RANGE = (0.05, 20.0)
GATES = ("profit", "profit_factor", "drawdown", "trades")
QUALITY_BINS = ((0.7, "excellent"), (0.55, "good"), (0.4, "acceptable"), (0.25, "weak"))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def policy_frame(studies: DataFrame, **gates) -> DataFrame:
    """One row per study with the same limits; any column may then be replaced."""
    values = {**DEFAULT_GATES, **{k: v for k, v in gates.items() if k != "selection_mode"}}
    out = studies.select("study_id").distinct()
    for name, v in values.items():
        out = out.withColumn(name, F.lit(v))
    return out.withColumn("selection_mode", F.lit(gates.get("selection_mode", "is_then_oos")))


def resolve_policy(policy: DataFrame) -> DataFrame:
    """Derive the score anchors from the limits the user declared."""
    dd, pf, tr = F.col("max_drawdown_pct"), F.col("min_profit_factor"), F.col("min_trades")
    fixed = {k: F.struct(F.lit(z).alias("zero"), F.lit(f).alias("full"))
             for k, (z, f) in DEFAULT_ANCHORS.items()}
    pair = lambda zero, full: F.struct(zero.cast("double").alias("zero"),
                                       full.cast("double").alias("full"))
    return policy.withColumn("anchors", F.struct(
        F.when(pf > 1, pair(F.lit(1.0), F.greatest(F.lit(1.5), pf + 0.3)))
        .otherwise(fixed["profit_factor"]).alias("profit_factor"),
        fixed["recovery_factor"].alias("recovery_factor"),
        F.when(dd > 0, pair(dd * 1.5, F.greatest(F.lit(1.0), dd * 0.25)))
        .otherwise(fixed["drawdown"]).alias("drawdown"),
        fixed["sharpe"].alias("sharpe"),
        F.when(tr > 0, pair(F.greatest(F.lit(5.0), tr * 0.5), tr * 5))
        .otherwise(fixed["trades"]).alias("trades")))


def linear_score(value: Column, zero: Column, full: Column) -> Column:
    return F.when(value.isNotNull() & (zero != full),
                  clamp01((value - zero) / (full - zero)))


def log_score(value: Column, zero: Column, full: Column) -> Column:
    usable = (zero > 0) & (full > zero)
    return (F.when(value.isNull() | (value <= 0), F.lit(0.0))
            .when(usable, clamp01(F.ln(value / zero) / F.ln(full / zero))))


def clamp_ratio(ratio: Column) -> Column:
    lo, hi = LENGTH_RATIO_RANGE
    return F.when(ratio > 0, F.least(F.lit(hi), F.greatest(F.lit(lo), ratio)))


def length_adjust(m: Column, ratio: Column) -> Column:
    """Diagnostic rescaling of drawdown and recovery to a common length."""
    k = F.sqrt(clamp_ratio(ratio))
    return (m.withField("drawdown", F.when(k.isNull(), m["drawdown"]).otherwise(
                F.when(m["drawdown"].isNotNull(), F.least(F.lit(100.0), m["drawdown"] / k))))
            .withField("recovery_factor", F.when(k.isNull(), m["recovery_factor"])
                       .otherwise(m["recovery_factor"] / k)))


def component_scores(m: Column, anchors: Column, ratio: Column | None = None) -> dict[str, Column]:
    scores = {k: linear_score(m[k], anchors[k]["zero"], anchors[k]["full"])
              for k in ("profit_factor", "recovery_factor", "drawdown", "sharpe")}
    r = F.coalesce(clamp_ratio(ratio), F.lit(1.0)) if ratio is not None else F.lit(1.0)
    scores["trades"] = log_score(m["trades"], anchors["trades"]["zero"] * r,
                                 anchors["trades"]["full"] * r)
    return scores


def _log_floor(s: Column) -> Column:
    return F.ln(F.greatest(F.lit(SCORE_FLOOR), s))


def period_quality(m: Column, anchors: Column, ratio: Column | None = None,
                   adjust_risk: bool = False, axes: dict = AXES) -> Column:
    """Two-level weighted geometric mean in [0, 1]; absent parts renormalise.

    Both levels are means of logarithms, so an axis enters as the mean log of
    its metrics and every component score appears once in the expression.
    """
    scores = component_scores(length_adjust(m, ratio) if adjust_risk else m, anchors, ratio)
    zero = F.lit(0.0)
    weight, total = zero, zero
    for axis_weight, metrics in axes.values():
        # Trades always score (0 when absent); the others need their metric.
        there = {k: F.lit(True) if k == "trades" else m[k].isNotNull() for k in metrics}
        some = reduce(lambda a, b: a | b, there.values())
        inner = reduce(lambda a, b: a + b, [
            F.when(there[k], F.lit(w)).otherwise(zero) for k, w in metrics.items()])
        logs = reduce(lambda a, b: a + b, [
            F.when(there[k], w * _log_floor(scores[k])).otherwise(zero)
            for k, w in metrics.items()])
        weight = weight + F.when(some, F.lit(axis_weight)).otherwise(zero)
        total = total + F.when(some, axis_weight * logs / inner).otherwise(zero)
    return (F.when(m.isNull(), F.lit(None).cast("double"))
            .when(m["profit"] <= 0, zero)
            .otherwise(F.exp(total / weight)))


def gate_failures(m: Column, require_profit: Column, min_pf: Column, max_dd: Column,
                  min_trades: Column) -> Column:
    """Names of the failed gates; a missing metric never fails."""
    rules = F.array(
        F.when(require_profit & (m["profit"] <= 0), F.lit("profit")),
        F.when(m["profit_factor"] < min_pf, F.lit("profit_factor")),
        F.when(m["drawdown"] > max_dd, F.lit("drawdown")),
        F.when(m["trades"] < min_trades, F.lit("trades")))
    return F.filter(rules, lambda x: x.isNotNull())


def combine_scores(a: Column, b: Column) -> Column:
    return F.least(a, b)  # ``least`` ignores NULL, as the rule asks


def retention(a: Column, b: Column) -> Column:
    return F.when((a > 0) & b.isNotNull(), b / a)


def quality_label(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit("no data"))
    for floor, name in QUALITY_BINS:
        out = out.when(score >= floor, F.lit(name))
    return out.otherwise("poor")


def period_ratio(passes: DataFrame) -> DataFrame:
    """Forward length over optimised length: upper median of the trade ratios."""
    pairs = passes.filter(
        F.col("oos.trades").isNotNull() & (F.col("is.trades") > 0)
    ).select("study_id", (F.col("oos.trades") / F.col("is.trades")).alias("r"))
    med = quantiles(pairs, ["study_id"], "r", {"ratio": 0.5}, "upper_median", count="pairs")
    return med.select("study_id", F.when(F.col("pairs") >= 10, F.col("ratio"))
                      .alias("period_ratio"))


def payoff_scale(passes: DataFrame) -> DataFrame:
    """Relative anchor of the result per trade: [max(0, p25), p90], 20 values or more."""
    values = passes.select("study_id", F.explode(F.array(
        F.col("is.expected_payoff"),
        F.when(F.col("oos_known"), F.col("oos.expected_payoff")))).alias("x"))
    q = quantiles(values, ["study_id"], "x", {"p25": 0.25, "p90": 0.9}, FLOOR_N1, count="n")
    zero = F.greatest(F.lit(0.0), F.col("p25"))
    return q.filter((F.col("n") >= 20) & (F.col("p90") > zero)).select(
        "study_id", zero.alias("zero"), F.col("p90").alias("full"))


def study_frame(passes: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per study: policy, anchors, period ratio and effective limits."""
    base = passes.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bool_or("oos_known"), F.lit(False)).alias("has_forward"))
    out = (base.join(resolve_policy(policy), "study_id")
           .join(period_ratio(passes), "study_id", "left"))
    mode = (F.when(~F.col("has_forward"), "is_only")
            .when(F.col("selection_mode") == "joint", "joint").otherwise("is_then_oos"))
    ratio_min = F.ceil(F.greatest(F.lit(30.0), F.col("min_trades") * F.col("period_ratio")))
    return out.withColumn("mode", mode).withColumn("min_trades_oos", F.when(
        F.col("has_forward") & F.col("period_ratio").isNotNull(), ratio_min.cast("double"))
        .otherwise(F.col("min_trades").cast("double")))


def score_rows(passes: DataFrame, studies: DataFrame) -> DataFrame:
    """Quality, gates and pass flags of every row under its study's mode."""
    cols = ["study_id", "has_forward", "mode", "anchors", "period_ratio", "require_profit",
            "min_profit_factor", "max_drawdown_pct", "min_trades", "min_trades_oos"]
    r = attach(passes, studies.select(*cols), ["study_id"], "inner", "row_idx")
    known = F.col("has_forward") & F.col("oos_known")
    a, lost = F.col("anchors"), F.col("lost_in_is")
    limits = (F.col("require_profit"), F.col("min_profit_factor"), F.col("max_drawdown_pct"))
    none = F.array().cast("array<string>")
    r = (r.withColumn("known", known)
         .withColumn("quality_is", F.when(lost, 0.0).otherwise(period_quality(F.col("is"), a)))
         .withColumn("quality_oos", F.when(known, period_quality(
             F.col("oos"), a, F.col("period_ratio"))))
         .withColumn("quality_oos_adjusted", F.when(known, period_quality(
             F.col("oos"), a, F.col("period_ratio"), adjust_risk=True)))
         .withColumn("quality_combined", F.when(
             F.col("has_forward"), combine_scores(F.col("quality_is"), F.col("quality_oos")))
             .otherwise(F.col("quality_is")))
         .withColumn("score", F.when(F.col("mode") == "is_then_oos", F.col("quality_is"))
                     .otherwise(F.col("quality_combined")))
         .withColumn("retention", F.when(known, retention(F.col("quality_is"),
                                                          F.col("quality_oos"))))
         .withColumn("fails_is", F.when(lost, F.array(F.lit("profit"))).otherwise(
             F.coalesce(gate_failures(F.col("is"), *limits, F.col("min_trades")), none)))
         .withColumn("fails_oos", F.when(known, gate_failures(
             F.col("oos"), *limits, F.col("min_trades_oos"))).otherwise(none)))
    discover = F.size("fails_is") == 0
    joint = discover & (~F.col("has_forward") | (known & (F.size("fails_oos") == 0)))
    return (r.withColumn("passes_discover", discover).withColumn("passes_joint", joint)
            .withColumn("passes", F.when(F.col("mode") == "is_then_oos", discover)
                        .otherwise(joint))
            .drop("anchors", "require_profit", "min_profit_factor", "max_drawdown_pct",
                  "period_ratio"))


def viable_rows(scored: DataFrame) -> DataFrame:
    """Flag the reference population: passing, else positive, else every row."""
    has = F.col("score").isNotNull()
    pop = scored.groupBy("study_id").agg(
        F.count_if(F.col("passes") & has).alias("_np"),
        F.count_if(F.col("score") > 0).alias("_npos")).select(
        "study_id", F.when(F.col("_np") >= 30, "passing").when(F.col("_npos") >= 30, "positive")
        .otherwise("all").alias("population"))
    out = attach(scored, pop, ["study_id"], "inner", "row_idx")
    return out.withColumn("viable", F.coalesce(
        F.when(F.col("population") == "passing", F.col("passes"))
        .when(F.col("population") == "positive", F.col("score") > 0)
        .otherwise(F.lit(True)), F.lit(False)))


def viable_scale(rows: DataFrame) -> DataFrame:
    """Spread of the viable population per study: IQR and MAD with floors."""
    pop = rows.filter(F.col("viable") & F.col("score").isNotNull()).select("study_id", "score")
    iqr = quantiles(pop, ["study_id"], "score", {"q25": 0.25, "q75": 0.75}, count="population_n")
    return (iqr.join(mad(pop, ["study_id"], "score", "_mad"), "study_id", "left")
            .select("study_id", F.greatest(F.lit(0.02), F.col("q75") - F.col("q25")).alias("iqr"),
                    F.greatest(F.lit(0.01), F.col("_mad")).alias("mad"), "population_n"))


def gate_influence(scored: DataFrame, studies: DataFrame) -> DataFrame:
    """Per gate: rows it fails, rows it alone fails, and the medians it faces."""
    hit = F.array_union("fails_is", "fails_oos")
    rows = scored.withColumn("hit", hit)
    counts = rows.groupBy("study_id").agg(*[a for g in GATES for a in (
        F.count_if(F.array_contains("hit", g)).alias(f"{g}_fail"),
        F.count_if(F.array_contains("hit", g) & (F.size("hit") == 1)).alias(f"{g}_sole"))])
    ok = F.when(F.col("has_forward"), F.col("passes_joint")).otherwise(F.col("passes"))
    known = F.col("known")
    both = lambda f, k: F.when(known, F.when(
        F.col("is")[k].isNotNull() & F.col("oos")[k].isNotNull(),
        f(F.col("is")[k], F.col("oos")[k]))).otherwise(F.col("is")[k])
    med = medians(scored.filter(ok), ["study_id"], {
        "profit_factor_observed": both(F.least, "profit_factor"),
        "drawdown_observed": both(F.greatest, "drawdown"),
        "trades_observed": F.col("is.trades"),
        "trades_observed_oos": F.col("oos.trades")})
    wide = counts.join(med, "study_id", "left").join(studies.select(
        "study_id", "min_profit_factor", "max_drawdown_pct", "min_trades", "min_trades_oos",
        "has_forward"), "study_id")
    null = F.lit(None).cast("double")
    observed = {"profit": null, **{g: F.col(f"{g}_observed") for g in GATES[1:]}}
    limit = {"profit": F.lit(0.0), "profit_factor": F.col("min_profit_factor"),
             "drawdown": F.col("max_drawdown_pct"), "trades": F.col("min_trades")}
    rows = F.array(*[F.struct(
        F.lit(g).alias("gate"), F.col(f"{g}_fail").alias("fails"),
        F.col(f"{g}_sole").alias("sole"), (F.col(f"{g}_sole") == 0).alias("inert"),
        observed[g].alias("observed"), limit[g].cast("double").alias("limit"),
        (F.when(F.col("has_forward"), F.col("trades_observed_oos")) if g == "trades" else null)
        .alias("observed_oos"),
        (F.when(F.col("has_forward"), F.col("min_trades_oos")) if g == "trades" else null)
        .alias("limit_oos")) for g in GATES])
    return wide.select("study_id", F.inline(rows))


def evidence_density(scored: DataFrame, optimised_dims: DataFrame) -> DataFrame:
    """Median trades per optimised parameter, and passes per trade."""
    med = medians(scored, ["study_id"], {"trades_is": F.col("is.trades"),
                                         "trades_oos": F.col("oos.trades")})
    n = scored.groupBy("study_id").agg(F.count(F.lit(1)).alias("total"),
                                       F.max("has_forward").alias("has_forward"))
    j = med.join(n, "study_id").join(optimised_dims, "study_id")
    base = F.when(F.col("has_forward"), F.col("trades_oos")).otherwise(F.col("trades_is"))
    dims = F.nullif(F.col("optimised_dims").cast("double"), F.lit(0.0))
    return j.select(
        "study_id", "optimised_dims", "trades_is",
        F.when(F.col("has_forward"), F.col("trades_oos")).alias("trades_oos"),
        (base / dims).alias("per_param"),
        F.when(base > 0, F.col("total") / base).alias("trials_per_trade"),
        F.when(F.col("has_forward"), "forward").otherwise("in_sample").alias("based_on"))
