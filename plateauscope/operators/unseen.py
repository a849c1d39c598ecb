"""Check of an unseen period against what a plateau had shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import attach, quantiles

# Metric, better side, exponent of the trade count.
METRICS = (("profit_factor", "high", 0.0), ("payoff", "high", 0.0), ("drawdown", "low", 0.35),
           ("recovery_factor", "high", 0.65), ("sharpe", "high", 0.0))
MIN_OBSERVATIONS = 4


def reference_distribution(members: DataFrame, passes: DataFrame) -> DataFrame:
    """Every member on every period: study_id, component, period, trades and five metrics."""
    m = members.select("study_id", "row_idx", "component").join(
        passes.select("study_id", "row_idx", "is", "oos", "oos_known"), ["study_id", "row_idx"])
    per = m.select("study_id", "component", "row_idx", F.explode(F.array(
        F.struct(F.lit("is").alias("period"), F.col("is").alias("m")),
        F.struct(F.lit("oos").alias("period"), F.when(F.col("oos_known"), F.col("oos")).alias("m"))
    )).alias("x")).select("study_id", "component", "row_idx", "x.period", "x.m.*")
    return per.filter("trades > 0").withColumn("payoff", F.col("profit") / F.col("trades")).select(
        "study_id", "component", "row_idx", "period", "trades", *[k for k, _, _ in METRICS])


def repeated_period(m_is: Column, m_oos: Column, trades: Column, profit: Column,
                    pf: Column) -> Column:
    """Which known period the figures repeat: is, oos, both (their sum) or NULL."""
    near = lambda a, b, rel, floor: F.abs(a - b) <= F.greatest(
        F.lit(float(floor)), rel * F.greatest(F.abs(a), F.abs(b)))
    usable = lambda m: (m["trades"] > 0) & m["profit"].isNotNull()
    same = lambda m: usable(m) & near(trades, m["trades"], 0.01, 1) & near(
        profit, m["profit"], 0.01, 1) & (pf.isNull() | m["profit_factor"].isNull()
                                         | near(pf, m["profit_factor"], 0.02, 0.01))
    total = usable(m_is) & usable(m_oos) & near(
        trades, m_is["trades"] + m_oos["trades"], 0.01, 2) & near(
        profit, m_is["profit"] + m_oos["profit"], 0.02, 1)
    return F.when((trades > 0) & profit.isNotNull(), F.when(same(m_is), "is").when(
        same(m_oos), "oos").when(total, "both"))


def band_check(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per study and metric: value, band of its plateau and status.

    ``observed``: study_id, trades, profit, profit_factor, drawdown, recovery_factor, sharpe.
    """
    obs = observed.filter("trades > 0").withColumn("payoff", F.col("profit") / F.col("trades"))
    long = lambda df, *keep: df.select("study_id", *keep, F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.lit(b).alias("better"), F.lit(e).alias("exponent"),
                 F.col(k).cast("double").alias("x")) for k, b, e in METRICS])).alias("_m")).select(
        "study_id", *keep, "_m.*")
    keys = ["study_id", "metric"]
    ref = long(reference, "trades").filter("x IS NOT NULL").withColumn(
        "v", F.col("x") / F.pow("trades", F.col("exponent")))
    o = long(obs.withColumnRenamed("trades", "seen_trades"), "seen_trades")
    o = o.filter("x IS NOT NULL").select(*keys, "better", "exponent", "seen_trades",
                                         F.col("x").alias("value"))
    centre = quantiles(ref, keys, "v", {"centre": 0.5})
    r = attach(ref.select(*keys, "trades", "v"), centre.join(
        o.select(*keys, "seen_trades", "exponent"), keys), keys, "inner")
    widen = F.when(F.col("exponent") == 0, F.greatest(
        F.lit(1.0), F.sqrt(F.col("trades") / F.col("seen_trades")))).otherwise(1.0)
    r = r.withColumn("w", F.col("centre") + (F.col("v") - F.col("centre")) * widen)
    q = quantiles(r, keys, "w", {"q10": 0.1, "median": 0.5, "q90": 0.9}, count="n")
    ext = r.groupBy(*keys).agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    b = o.join(q, keys).join(ext, keys).filter(F.col("n") >= MIN_OBSERVATIONS)
    for c in ("lo", "q10", "median", "q90", "hi"):
        scaled = F.col(c) * F.pow("seen_trades", F.col("exponent"))
        b = b.withColumn(c, F.when(F.col("metric") == "profit_factor",
                                   F.greatest(F.lit(0.0), scaled)).otherwise(scaled))
    high = (F.when(F.col("value") > F.col("hi"), "better")
            .when(F.col("value") >= F.col("q10"), "normal")
            .when(F.col("value") >= F.col("lo"), "tail").otherwise("outside"))
    low = (F.when(F.col("value") < F.col("lo"), "better")
           .when(F.col("value") <= F.col("q90"), "normal")
           .when(F.col("value") <= F.col("hi"), "tail").otherwise("outside"))
    return b.select(*keys, "value", "lo", "q10", "median", "q90", "hi", "n",
                    F.when(F.col("better") == "high", high).otherwise(low).alias("status"))


def unseen_level(checked: DataFrame, reference: DataFrame, observed: DataFrame) -> DataFrame:
    """Level of an unseen period and whether it is too short to say much."""
    g = checked.groupBy("study_id").agg(
        F.count_if(F.col("status") == "outside").alias("outside"),
        F.count_if(F.col("status") == "tail").alias("tail"),
        F.count_if(F.col("status") == "better").alias("better"))
    med = quantiles(reference, ["study_id"], "trades", {"median_trades": 0.5})
    j = g.join(med, "study_id").join(observed.select("study_id", "trades"), "study_id")
    share = F.col("trades") / F.col("median_trades")
    return j.select("study_id", F.when(F.col("outside") > 0, "outside").when(
        F.col("tail") > 0, "tail").otherwise("normal").alias("unseen_level"), "outside", "tail",
        "better", share.alias("trade_share"),
        ((F.col("trades") < 30) | (share < 0.15)).alias("low_power"))
