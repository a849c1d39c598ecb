"""Statistics, selection bias and perturbation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateauscope.functions import numeric as N
from plateauscope.operators import bias as B
from plateauscope.operators import perturbation as E
from plateauscope.operators import plateau as P
from plateauscope.plans.stages import stage

from .base import audit, register
from .sweep_sql import chain, draw_steps

_imul = lambda a, b: (f"((({a}) * (({b}) & 65535) + (((({a}) & 65535) * (({b}) >> 16)) & 65535)"
                      f" * 65536) & 4294967295)")


def draw_sql(seed: str, n: str) -> str:
    """The seeded draw as SQL (scalar subqueries name the intermediate words)."""
    s = f"((({seed})::BIGINT + (({n})::BIGINT % 4294967296) * 1831565813) % 4294967296)"
    t1 = f"(SELECT {_imul('xor(s, s >> 15)', 's | 1')} FROM (SELECT {s} AS s))"
    t2 = f"(SELECT xor((t + {_imul('xor(t, t >> 7)', 't | 61')}) % 4294967296, t) FROM (SELECT {t1} AS t))"
    return f"(SELECT xor(w, w >> 14) / 4294967296.0 FROM (SELECT {t2} AS w))"


def norm_inv_sql(p: str) -> str:
    h = lambda cs, x: "(" + f")*{x}+".join(["(" * (len(cs) - 1) + str(cs[0])]
                                          + [str(c) for c in cs[1:]]) + ")"
    q = f"sqrt(-2*ln({p}))"
    q2 = f"sqrt(-2*ln(1-({p})))"
    r = f"(({p})-0.5)"
    tail = lambda x: f"({h(N.NORM_INV_C, x)})/({h(N.NORM_INV_D + (1.0,), x)})"
    mid = f"({h(N.NORM_INV_A, f'({r}*{r})')})*{r}/({h(N.NORM_INV_B + (1.0,), f'({r}*{r})')})"
    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {tail(q)} "
            f"WHEN {p} > 0.97575 THEN -({tail(q2)}) ELSE {mid} END)")


@register("f1_summary_statistics", "study_id:s n:i lo:d hi:d mean:d sd:d q25:d median:d q75:d mad:d",
          """SELECT study_id, count(*) n, min(score) lo, max(score) hi, avg(score) mean,
  stddev_samp(score) sd, quantile_cont(score,0.25) q25, median(score) median,
  quantile_cont(score,0.75) q75, CASE WHEN count(*)>=2 THEN 1.4826*median(abs(score-md)) ELSE 0 END mad
 FROM scored JOIN (SELECT study_id, median(score) md FROM scored GROUP BY 1) USING (study_id)
 WHERE score IS NOT NULL GROUP BY 1""", chain("scored"))
def f1(spark, sf):
    return B.summary_statistics(audit(spark, sf).scored, ["study_id"], "score")


@register("f2_percentile_ranks", "study_id:s row_idx:i pr:d", """
 SELECT study_id, row_idx, CASE WHEN quality_oos IS NOT NULL THEN
  (rank() OVER (PARTITION BY study_id ORDER BY quality_oos NULLS LAST)
   + (count(*) OVER (PARTITION BY study_id, quality_oos) - 1)/2.0)
  / count(quality_oos) OVER (PARTITION BY study_id) END pr FROM cells""", chain("cells"))
def f2(spark, sf):
    return B.percentile_ranks(audit(spark, sf).cells, ["study_id"], "quality_oos", "row_idx", "pr")


@register("f3_spearman", "study_id:s pairs:i spearman:d", """
 SELECT study_id, count(*) pairs, CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END
  spearman FROM (SELECT study_id,
  rank() OVER (PARTITION BY study_id ORDER BY is_profit)
   + (count(*) OVER (PARTITION BY study_id, is_profit)-1)/2.0 ra,
  rank() OVER (PARTITION BY study_id ORDER BY oos_profit)
   + (count(*) OVER (PARTITION BY study_id, oos_profit)-1)/2.0 rb
  FROM cells WHERE known) GROUP BY 1""", chain("cells"))
def f3(spark, sf):
    return B.spearman(B.criterion_pairs(audit(spark, sf).cells), ["study_id"], "a", "b")


@register("f4_normal_scores", "study_id:s row_idx:i z:d back:d", f"""
 SELECT study_id, row_idx, {norm_inv_sql('p')} z, p back FROM (SELECT study_id, row_idx,
  (rank() OVER (PARTITION BY study_id ORDER BY is_profit)
   + (count(*) OVER (PARTITION BY study_id, is_profit)-1)/2.0)
   / (count(*) OVER (PARTITION BY study_id) + 1.0) p FROM passes)""", chain("passes"))
def f4(spark, sf):
    a = audit(spark, sf)
    r = B.percentile_ranks(a.passes.select("study_id", "row_idx", F.col("is.profit").alias("x")),
                           ["study_id"], "x", "row_idx", "pr")
    n = a.passes.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("pr") * F.col("n") / (F.col("n") + 1.0)
    r = r.join(n, "study_id").withColumn("z", N.norm_inv(p))
    return r.withColumn("back", F.round(N.norm_cdf(F.col("z")), 6)).withColumn("back", F.when(
        F.abs(F.col("back") - p) < 1e-6, p))


@register("f5_chance_maximum", "study_id:s expected_max:d max_quantile:d", f"""
 SELECT study_id, (1-0.5772156649015329)*{norm_inv_sql('(1-1.0/n)')}
  + 0.5772156649015329*{norm_inv_sql('(1-1.0/(n*exp(1.0)))')} expected_max,
  -{norm_inv_sql('(1-exp(ln(0.95)/n))')} max_quantile
 FROM (SELECT study_id, count(*) n FROM passes GROUP BY 1)""", chain("passes"))
def f5(spark, sf):
    n = audit(spark, sf).passes.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("study_id", N.expected_max_z(F.col("n")).alias("expected_max"),
                    N.max_quantile_z(F.col("n")).alias("max_quantile"))


@register("f6_selection_fragility", "study_id:s fragility:d margin:d is_to_oos:d oos_to_is:d "
          "asymmetry:d worst_direction:s n:i take:i repeats:i", f"""
 SELECT *, greatest(is_to_oos, oos_to_is) fragility,
  2*sqrt(greatest(is_to_oos, oos_to_is)*(1-greatest(is_to_oos, oos_to_is))/repeats) margin,
  abs(is_to_oos-oos_to_is) asymmetry,
  CASE WHEN is_to_oos >= oos_to_is THEN 'is_to_oos' ELSE 'oos_to_is' END worst_direction FROM (
 SELECT study_id, max(p) FILTER (d=0) is_to_oos, max(p) FILTER (d=1) oos_to_is, any_value(n) n,
  any_value(take) take, 2000 AS repeats FROM (
  SELECT study_id, d, avg(CASE WHEN w < 0.5 THEN 1.0 ELSE 0 END) p, any_value(n) n,
   any_value(take) take FROM (
   SELECT study_id, d, rep, avg(CASE WHEN test < chosen THEN 1.0 ELSE 0 END) w, any_value(n) n,
    any_value(take) take FROM (
    SELECT *, first_value(test) OVER (PARTITION BY study_id, d, rep ORDER BY train DESC, row_idx)
     chosen FROM (
     SELECT *, row_number() OVER (PARTITION BY study_id, d, rep ORDER BY u, row_idx) k FROM (
      SELECT study_id, d, rep, row_idx, n, greatest(10, least(n-1, n//2)) take,
       CASE d WHEN 0 THEN is_profit ELSE oos_profit END train,
       CASE d WHEN 0 THEN oos_profit ELSE is_profit END test,
       {draw_sql(f"(CASE d WHEN 0 THEN {B.FRAGILITY_SEED} ELSE {B.FRAGILITY_SEED ^ B.REVERSE_MASK} END) + rep*7919", "row_idx+1")} u
      FROM (SELECT *, count(*) OVER (PARTITION BY study_id) n FROM cells WHERE known),
       (VALUES (0),(1)) q(d), range(1, 2001) z(rep) WHERE n >= 20)) WHERE k <= take)
    GROUP BY ALL) GROUP BY ALL) GROUP BY 1)""", chain("cells"))
def f6(spark, sf):
    return B.selection_fragility(B.criterion_pairs(audit(spark, sf).cells), stage)


@register("f7_decile_degradation", "study_id:s decile:i count:i is_median:d oos_median:d oos_q25:d",
          """SELECT study_id, decile, count(*) AS count, median(is_profit) is_median,
  median(oos_profit) oos_median, quantile_cont(oos_profit,0.25) oos_q25 FROM (
  SELECT c.*, d.b+1 decile FROM (SELECT *, row_number() OVER (PARTITION BY study_id
    ORDER BY is_profit, row_idx)-1 pos, count(*) OVER (PARTITION BY study_id) n FROM cells
    WHERE known) c, range(0,10) d(b)
  WHERE n >= 30 AND pos >= floor(d.b*n/10.0) AND pos < floor((d.b+1)*n/10.0)) GROUP BY ALL""",
          chain("cells"))
def f7(spark, sf):
    return B.decile_degradation(B.criterion_pairs(audit(spark, sf).cells))


@register("f8_sharpe_selection", "study_id:s period:s trials:i sigma:d mean:d observed_max:d "
          "chance_max:d chance_mean:d", f"""
 SELECT *, sigma * -{norm_inv_sql('(1-exp(ln(0.95)/trials))')} chance_max,
  sigma * ((1-0.5772156649015329)*{norm_inv_sql('(1-1.0/trials)')}
  + 0.5772156649015329*{norm_inv_sql('(1-1.0/(trials*exp(1.0)))')}) chance_mean FROM (
 SELECT study_id, CASE WHEN bool_or(has_forward) THEN 'oos' ELSE 'is' END period, count(*) trials,
  stddev_samp(s) sigma, avg(s) mean, max(s) observed_max FROM (SELECT study_id, has_forward,
   CASE WHEN has_forward THEN oos_sharpe ELSE is_sharpe END s,
   CASE WHEN has_forward THEN oos_trades ELSE is_trades END t FROM cells)
  WHERE s IS NOT NULL AND t > 30 GROUP BY 1) WHERE trials >= 30 AND sigma > 1e-12""",
          chain("cells"))
def f8(spark, sf):
    return B.sharpe_selection(audit(spark, sf).cells)


@register("f9_neighbour_noise", "study_id:s pairs:i noise_variance:d neighbour_correlation:d", """
 SELECT e.study_id, count(*) pairs, avg(pow(a.s-b.s,2))/2 noise_variance, corr(a.s,b.s)
  neighbour_correlation FROM edges e
 JOIN (SELECT study_id, row_idx, CASE WHEN has_forward THEN oos_sharpe ELSE is_sharpe END s
  FROM cells) a ON a.study_id=e.study_id AND a.row_idx=src
 JOIN (SELECT study_id, row_idx, CASE WHEN has_forward THEN oos_sharpe ELSE is_sharpe END s
  FROM cells) b ON b.study_id=e.study_id AND b.row_idx=dst
 WHERE dist=1 AND src<dst AND a.s IS NOT NULL AND b.s IS NOT NULL GROUP BY 1""", chain("edges"))
def f9(spark, sf):
    a = audit(spark, sf)
    return B.neighbour_noise(a.cells, a.edges)


_units = """units AS MATERIALIZED (
 SELECT u.study_id, u.row_idx, avg(is_expected_payoff) xi, count(*)/sum(1/is_trades) ti,
  CASE WHEN any_value(k) THEN avg(oos_expected_payoff) FILTER (known) END xo,
  CASE WHEN any_value(k) THEN count(*) FILTER (known)/sum(1/oos_trades) FILTER (known) END "to"
 FROM (SELECT c.study_id, c.row_idx, c.known k, c.row_idx mate FROM cells c
    WHERE has_forward AND len(fails_is)=0
   UNION ALL SELECT c.study_id, c.row_idx, c.known, e.dst FROM cells c
    JOIN edges e ON e.study_id=c.study_id AND e.src=c.row_idx
    WHERE has_forward AND len(fails_is)=0) u
 JOIN cells m ON m.study_id=u.study_id AND m.row_idx=u.mate GROUP BY ALL),
model AS MATERIALIZED (
 SELECT *, b*k*ei v, a + b*mx family FROM (
 SELECT *, rss/greatest(1, nf-2)/(b*ei+eo) k FROM (
 SELECT *, syy - 2*b*sxy + b*b*sxx rss, my - b*mfx a FROM (
 SELECT *, sxy/sxx beta, least(1, greatest(0, sxy/sxx)) b FROM (
  SELECT study_id, count(*) units, count(xo) nf, avg(xi) mx, avg(1/ti) ei,
   avg(1/"to") FILTER (xo IS NOT NULL) eo, avg(xi) FILTER (xo IS NOT NULL) mfx, avg(xo) my,
   regr_sxx(xo, xi) sxx, regr_sxy(xo, xi) sxy, regr_syy(xo, xi) syy
  FROM units GROUP BY 1) WHERE units >= 30 AND nf >= 30))))
"""


def _with_units(last: str) -> str:
    return chain(last).rstrip() + ",\n" + _units


@register("f10_units", "study_id:s row_idx:i xi:d ti:d xo:d t_o:d",
          'SELECT *, "to" t_o FROM units',
          _with_units("edges"))
def f10(spark, sf):
    a = audit(spark, sf)
    return B.units(a.cells, a.edges).withColumnRenamed("to", "t_o")


@register("f11_shrinkage_model", "study_id:s beta:d a:d b:d k:d v:d family:d units:i "
          "forward_units:i", "SELECT * REPLACE (k/1e6 AS k, v/1e6 AS v), nf forward_units FROM model", _with_units("edges"))
def f11(spark, sf):
    a = audit(spark, sf)
    m = B.shrink_model(B.units(a.cells, a.edges))
    return m.withColumn("k", F.col("k") / 1e6).withColumn("v", F.col("v") / 1e6)


@register("f12_posterior", "study_id:s row_idx:i expected:d variance:d", """
 SELECT study_id, row_idx, CASE WHEN xo IS NOT NULL AND v > 0
   THEN a+b*xi + v/(v+k/"to")*(xo-a-b*xi) ELSE a+b*xi END expected,
  CASE WHEN xo IS NOT NULL AND v > 0 THEN v*(1-v/(v+k/"to")) ELSE v END / 1e6 variance
 FROM units JOIN model USING (study_id)""", _with_units("edges"))
def f12(spark, sf):
    a = audit(spark, sf)
    u = B.units(a.cells, a.edges)
    p = B.posterior(u.join(B.shrink_model(u), "study_id"))
    return p.withColumn("variance", F.col("variance") / 1e6)


def _expectation(spark, sf):
    a = audit(spark, sf)
    top = a.plateaus.filter("rank <= 3").select(
        "study_id", F.col("representative").alias("row_idx"))
    return B.expectation(stage(B.units(a.cells, a.edges), "units"), a.coarse, top)


@register("f13_block_bootstrap", "study_id:s beta:d beta_lo:d beta_hi:d family:d blocks:i reps:i")
def f13(spark, sf):
    return _expectation(spark, sf)[0]


@register("f14_expectation_table", "study_id:s rank:i row_idx:i expected:d own:d own_lo:d "
          "seen_is:d seen_oos:d")
def f14(spark, sf):
    a = audit(spark, sf)
    return B.expectation_table(a.plateaus, a.cells, _expectation(spark, sf)[1])


@register("e15_rank_by_expectation", "study_id:s component:i expected:d variance:d rank:i", """
 SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY expected DESC, component) AS rank FROM (
 SELECT study_id, component, CASE WHEN xo IS NOT NULL AND v > 0
   THEN a+b*xi + v/(v+k/"to")*(xo-a-b*xi) ELSE a+b*xi END expected,
  CASE WHEN xo IS NOT NULL AND v > 0 THEN v*(1-v/(v+k/"to")) ELSE v END / 1e6 variance
 FROM (SELECT m.study_id, component, avg(is_expected_payoff) xi, count(*)/sum(1/is_trades) ti,
  avg(oos_expected_payoff) FILTER (known) xo,
  count(*) FILTER (known)/sum(1/oos_trades) FILTER (known) "to"
  FROM members m JOIN cells c ON c.study_id=m.study_id AND c.row_idx=m.row_idx GROUP BY ALL)
 JOIN model USING (study_id))""", _with_units("members"))
def e15(spark, sf):
    a = audit(spark, sf)
    r = B.rank_by_expectation(a.members, a.cells, B.units(a.cells, a.edges))
    return r.withColumn("variance", F.col("variance") / 1e6)


RATES = ("study_id:s draws:i with_plateau:i same_region:i same_representative:i plateau_rate:d "
         "region_rate:d representative_rate:d")


def _moved(value: float, i: int, key: str) -> str:
    """A threshold of a draw: one at a time, then all at random."""
    f = (f"CASE draw_id WHEN {2 * i} THEN 0.8 WHEN {2 * i + 1} THEN 1.2 ELSE 1.0 END")
    rnd = draw_sql(str(E.THRESHOLD_SEED), f"(draw_id-14)*7+{i + 1}")
    f = f"(CASE WHEN draw_id < 14 THEN {f} ELSE 0.8 + 0.4*{rnd} END)"
    return f"{f'1-(1-{value})*{f}' if key == 'min_frac_pass' else f'{value}*{f}'} AS {key}"


_T0 = P.Thresholds()
draw_steps("t_", f"""SELECT draw_id, {', '.join(_moved(float(getattr(_T0, k)), i, k) for i, k in enumerate(E.KEYS))}
 FROM range(0, {14 + E.JOINT_DRAWS}) q(draw_id)""", """
 SELECT study_id, draw_id, row_idx, rob.score, support, min_size,
  coalesce(q25 >= core_quality AND robust >= core_robust, false) core, ok
 FROM rob JOIN (SELECT study_id, row_idx, known AND len(fails_oos)=0 AS ok FROM cells) c
  USING (study_id, row_idx), t_draws d
 WHERE passes AND support >= min_support AND q25 >= floor_quality AND frac_pass >= min_frac_pass
  AND robust >= min_robust""")


def _factor(i: int, name: str) -> str:
    rnd = draw_sql(str(E.GATE_SEED), f"(draw_id-6)*3+{i + 1}")
    return (f"CASE WHEN draw_id = {i} THEN 0.8 WHEN draw_id = {3 + i} THEN 1.2 WHEN draw_id < 6 THEN 1.0 "
            f"ELSE 0.8 + 0.4*{rnd} END AS {name}")


def _gate(p: str, trades: str) -> str:
    """Whether a period passes the moved gates; a missing metric never fails."""
    return (f"(NOT coalesce({p}_profit <= 0, false) AND NOT coalesce({p}_profit_factor < 1+(1.2-1)*f_pf, false)"
            f" AND NOT coalesce({p}_drawdown > 20*f_dd, false) AND NOT coalesce({p}_trades < {trades}*f_tr, false))")


draw_steps("g_", f"""SELECT draw_id, {', '.join(_factor(i, n) for i, n in enumerate(('f_pf', 'f_dd', 'f_tr')))}
 FROM range(0, {E.GATE_DRAWS}) q(draw_id)""", f"""
 WITH flags AS (SELECT study_id, row_idx, draw_id, score, {_gate('is', 'mt')} AND (mode = 'is_then_oos'
    OR NOT has_forward OR (known AND {_gate('oos', 'mt_oos')})) AS passing,
   known AND {_gate('oos', 'mt_oos')} ok FROM cells, g_draws),
 cnt AS (SELECT e.study_id, src row_idx, draw_id, count(*) FILTER (passing) pc FROM edges e
  JOIN flags f ON f.study_id=e.study_id AND f.row_idx=e.dst GROUP BY ALL),
 v AS (SELECT f.*, s.support, s.q25, pc*1.0/s.support fp,
   100 * pow(greatest(0,s.score),0.3) * pow(greatest(0,s.q25),0.4) * pow(coalesce(pc*1.0/s.support,0),0.3)
   / (1+greatest(0, coalesce(cliff,0)-1.5)) / (1+greatest(0, coalesce(peak_z,0)-2))
   * least(1, s.support/(CASE WHEN median_support>0 THEN least(8.0, greatest(4.0, median_support))
     ELSE 8.0 END)) rb
  FROM flags f JOIN stab s ON s.study_id=f.study_id AND s.row_idx=f.row_idx
  JOIN radius r ON r.study_id=f.study_id
  JOIN cnt c ON c.study_id=f.study_id AND c.row_idx=f.row_idx AND c.draw_id=f.draw_id WHERE passing)
 SELECT study_id, draw_id, row_idx, score, support, 3 AS min_size,
  coalesce(q25 >= 0.58 AND rb >= 65, false) core, ok
 FROM v WHERE support >= 4 AND q25 >= 0.42 AND fp >= 0.9 AND rb >= 50""")


@register("e25_threshold_stability", RATES, "SELECT * FROM t_tally", chain("t_tally"))
def e25(spark, sf):
    return audit(spark, sf).threshold_stability


@register("e26_gate_stability", RATES, "SELECT * FROM g_tally", chain("g_tally"))
def e26(spark, sf):
    return audit(spark, sf).gate_stability
