"""Unseen period, run history and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateauscope.functions import numeric as N
from plateauscope.operators import bias as B
from plateauscope.operators import evaluate as V
from plateauscope.operators import history as H
from plateauscope.operators import plateau as P
from plateauscope.operators import trades as T
from plateauscope.operators import unseen as U
from plateauscope.operators import verdict
from plateauscope.plans import relations as R

from .base import audit, register
from .evidence import metrics
from .stats import _with_units, draw_sql, norm_inv_sql
from .sweep_sql import chain


def _first(spark, sf):
    a = audit(spark, sf)
    return a.plateaus.filter("rank = 1").select(
        "study_id", "component", F.col("representative").alias("row_idx"))


def _reference(spark, sf):
    a = audit(spark, sf)
    m = a.members.join(_first(spark, sf).select("study_id", "component"), ["study_id", "component"])
    return U.reference_distribution(m, a.passes)


def _observed(spark, sf):
    """Figures of an unseen period: a weaker and shorter copy of the representative."""
    a = audit(spark, sf)
    r = _first(spark, sf).join(a.passes.select("study_id", "row_idx", "is"), P.NODE)
    return r.select(
        "study_id", F.floor(F.col("is.trades") / 2).alias("trades"),
        (F.col("is.profit") * 0.4).alias("profit"), (F.col("is.profit_factor") * 0.9)
        .alias("profit_factor"), (F.col("is.drawdown") * 1.2).alias("drawdown"),
        (F.col("is.recovery_factor") * 0.5).alias("recovery_factor"),
        (F.col("is.sharpe") * 0.95).alias("sharpe"))


_REF = chain("ranked").rstrip() + """,
ref AS MATERIALIZED (SELECT study_id, component, row_idx, period, trades, pf, payoff, dd, rf, sh FROM (
 SELECT m.study_id, m.component, m.row_idx, q.period, CASE q.period WHEN 'is' THEN is_trades ELSE oos_trades END trades,
  CASE q.period WHEN 'is' THEN is_profit_factor ELSE oos_profit_factor END pf,
  CASE q.period WHEN 'is' THEN is_profit/is_trades ELSE oos_profit/oos_trades END payoff,
  CASE q.period WHEN 'is' THEN is_drawdown ELSE oos_drawdown END dd,
  CASE q.period WHEN 'is' THEN is_recovery_factor ELSE oos_recovery_factor END rf,
  CASE q.period WHEN 'is' THEN is_sharpe ELSE oos_sharpe END sh
 FROM members m JOIN ranked r ON r.study_id=m.study_id AND r.component=m.component AND r.rank=1
 JOIN passes p ON p.study_id=m.study_id AND p.row_idx=m.row_idx, (VALUES ('is'),('oos')) q(period)) WHERE trades > 0),
obs AS MATERIALIZED (SELECT r.study_id, floor(is_trades/2) tr, is_profit*0.4 pr, is_profit_factor*0.9 pf, is_drawdown*1.2 dd,
  is_recovery_factor*0.5 rf, is_sharpe*0.95 sh FROM ranked r JOIN passes p ON p.study_id=r.study_id
  AND p.row_idx=r.representative WHERE r.rank=1),
refm AS MATERIALIZED (SELECT study_id, trades, metric, e, better, CASE metric WHEN 'profit_factor' THEN pf WHEN 'payoff' THEN payoff
   WHEN 'drawdown' THEN dd WHEN 'recovery_factor' THEN rf ELSE sh END / pow(trades, e) v FROM ref,
  (VALUES ('profit_factor','high',0.0),('payoff','high',0.0),('drawdown','low',0.35),('recovery_factor','high',0.65),
   ('sharpe','high',0.0)) k(metric, better, e)),
ctr AS MATERIALIZED (SELECT study_id, metric, median(v) c FROM refm WHERE v IS NOT NULL GROUP BY ALL),
wide AS MATERIALIZED (SELECT refm.*, tr, c + (v-c)*CASE WHEN e=0 THEN greatest(1, sqrt(trades/tr)) ELSE 1 END w,
  CASE metric WHEN 'profit_factor' THEN obs.pf WHEN 'payoff' THEN pr/tr WHEN 'drawdown' THEN obs.dd
   WHEN 'recovery_factor' THEN obs.rf ELSE obs.sh END AS value
  FROM refm JOIN ctr USING (study_id, metric) JOIN obs USING (study_id) WHERE v IS NOT NULL),
band AS MATERIALIZED (SELECT *, CASE WHEN better='high' THEN CASE WHEN value > hi THEN 'better' WHEN value >= q10 THEN 'normal'
   WHEN value >= lo THEN 'tail' ELSE 'outside' END ELSE CASE WHEN value < lo THEN 'better' WHEN value <= q90 THEN 'normal'
   WHEN value <= hi THEN 'tail' ELSE 'outside' END END status FROM (
  SELECT study_id, metric, any_value(better) better, any_value(value) AS value, count(*) n,
   greatest(min(w)*pow(any_value(tr), any_value(e)), CASE WHEN metric='profit_factor' THEN 0 ELSE -1e300 END) lo,
   greatest(quantile_cont(w,0.1)*pow(any_value(tr), any_value(e)), CASE WHEN metric='profit_factor' THEN 0 ELSE -1e300 END) q10,
   greatest(quantile_cont(w,0.9)*pow(any_value(tr), any_value(e)), CASE WHEN metric='profit_factor' THEN 0 ELSE -1e300 END) q90,
   greatest(max(w)*pow(any_value(tr), any_value(e)), CASE WHEN metric='profit_factor' THEN 0 ELSE -1e300 END) hi
  FROM wide GROUP BY study_id, metric) WHERE n >= 4)
"""


@register("i1_reference_distribution", "study_id:s row_idx:i period:s trades:d profit_factor:d "
          "payoff:d drawdown:d", "SELECT *, pf profit_factor, dd drawdown FROM ref", _REF)
def i1(spark, sf):
    return _reference(spark, sf)


@register("i2_repeated_period", "study_id:s row_idx:i repeated:s", """
 SELECT study_id, row_idx, CASE row_idx % 4 WHEN 0 THEN 'is' WHEN 1 THEN CASE WHEN oos_trades > 0 THEN 'oos' END
  WHEN 2 THEN CASE WHEN oos_trades > 0 THEN 'both' END END repeated FROM passes
 WHERE oos_trades > 20 AND is_trades > 2*oos_trades + 50""", chain("passes"))
def i2(spark, sf):
    p = R.sweep(spark, sf)
    i, o, k = F.col("is"), F.col("oos"), F.col("row_idx") % 4
    sel = lambda m: F.when(k == 0, i[m]).when(k == 1, o[m]).when(k == 2, i[m] + o[m]).otherwise(
        i[m] * 3 + 1000)
    pf = F.when(k == 0, i["profit_factor"]).when(k == 1, o["profit_factor"])
    p = p.filter((o["trades"] > 20) & (i["trades"] > 2 * o["trades"] + 50))
    return p.select("study_id", "row_idx", U.repeated_period(
        i, o, sel("trades"), sel("profit"), pf).alias("repeated"))


@register("i3_band_check", "study_id:s metric:s value:d lo:d q10:d q90:d hi:d n:i status:s",
          "SELECT * FROM band", _REF)
def i3(spark, sf):
    return U.band_check(_reference(spark, sf), _observed(spark, sf))


@register("i3_unseen_level", "study_id:s unseen_level:s outside:i tail:i better:i low_power:b", """
 SELECT b.*, tr < 30 OR tr/m < 0.15 low_power, CASE WHEN outside > 0 THEN 'outside' WHEN tail > 0 THEN 'tail'
  ELSE 'normal' END unseen_level FROM (SELECT study_id, count(*) FILTER (status='outside') outside,
  count(*) FILTER (status='tail') tail, count(*) FILTER (status='better') better FROM band GROUP BY 1) b
 JOIN obs USING (study_id) JOIN (SELECT study_id, median(trades) m FROM ref GROUP BY 1) USING (study_id)""", _REF)
def i3b(spark, sf):
    r, o = _reference(spark, sf), _observed(spark, sf)
    return U.unseen_level(U.band_check(r, o), r, o)


@register("h29_parameter_comparison", "study_id:s name:s status:s", """
 SELECT r.study_id, name, CASE d.dim WHEN 0 THEN 'same' WHEN 1 THEN CASE WHEN c.p1 % 2 = 0 THEN 'same' ELSE 'different' END
  ELSE 'missing' END status FROM ranked r JOIN cells c ON c.study_id=r.study_id AND c.row_idx=r.representative,
 (VALUES (0,'p0'),(1,'p1'),(2,'p2')) d(dim, name) WHERE r.rank=1""", chain("ranked"))
def h29(spark, sf):
    a = audit(spark, sf)
    p = _first(spark, sf).join(a.passes.select(*P.NODE, "params"), P.NODE).select(
        "study_id", F.explode("params").alias("p")).select("study_id", "p.name", "p.txt", "p.num")
    config = p.select("study_id", "name", F.col("txt").alias("text"))
    seen = F.when(F.col("name") == "p0", F.concat(F.col("num").cast("string"), F.lit("00"))).otherwise(
        F.when(F.col("num") % 2 == 0, F.concat(F.lit(" "), F.col("txt"))).otherwise("77"))
    report = p.filter("name <> 'p2'").select("study_id", "name", seen.alias("text"))
    return T.compare_parameters(report, config)


# ------------------------------------------------------------------ history
_RUNS = """WITH runs AS MATERIALIZED (SELECT 'u'||(user_id % 4) AS owner, event_type fp, CAST(CAST(ts AS DATE) AS VARCHAR) AS "at",
  CAST(count(*) % 3 AS VARCHAR) sig, CAST(count(*) FILTER (value > 50) % 2 AS VARCHAR) gates, count(*) n,
  CASE WHEN count(*) % 5 = 0 THEN count(*) END unseen, count(*) % 2 = 0 has_forward,
  ['insufficient','weak','moderate','good','strong'][count(*) % 5 + 1] AS level, count(*) size,
  sum(CAST(round(value*100) AS BIGINT)) cents FROM events GROUP BY ALL)
"""


def runs(spark, sf):
    e = R.table(spark, sf, "events")
    n = F.count(F.lit(1))
    g = e.groupBy(F.concat(F.lit("u"), F.col("user_id") % 4).alias("owner"),
                  F.col("event_type").alias("fp"), F.to_date("ts").cast("string").alias("at"))
    r = g.agg(n.alias("n"), F.count_if(F.col("value") > 50).alias("g"),
              F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    lv = F.get(F.array(*[F.lit(x) for x in H.LEVELS]), (F.col("n") % 5).cast("int"))
    return r.select("owner", "fp", "at", (F.col("n") % 3).cast("string").alias("sig"),
                    (F.col("g") % 2).cast("string").alias("gates"), "n",
                    F.when(F.col("n") % 5 == 0, F.col("n")).alias("unseen"),
                    (F.col("n") % 2 == 0).alias("has_forward"), lv.alias("level"),
                    F.col("n").alias("size"), "cents")


@register("j1_strategy_fingerprint", "study_id:s fp:s",
          "SELECT DISTINCT study_id, sha256('p0|p1|p2') fp FROM passes", chain("passes"))
def j1(spark, sf):
    return H.strategy_fingerprint(R.sweep(spark, sf))


@register("j1_data_signature", "study_id:s length:i", "SELECT DISTINCT study_id, 64 AS length FROM passes",
          chain("passes"))
def j1b(spark, sf):
    return H.data_signature(R.sweep(spark, sf)).select("study_id", F.length("sig").alias("length"))


@register("j2_run_summary", "study_id:s total:i level:s pass_id:s size:i spans:i")
def j2(spark, sf):
    a = audit(spark, sf)
    from .evidence import simple_metrics
    m = simple_metrics(spark, sf)
    s = H.run_summary(a.studies, a.plateaus, a.passes, P.parameter_span(a.members, a.passes),
                      verdict.evidence_level(verdict.findings(m), m),
                      H.strategy_fingerprint(a.passes), H.data_signature(a.passes))
    return s.withColumn("spans", F.size("span"))


@register("j3_retained_runs", "owner:s fp:s at:s unseen:i", _RUNS + """
 SELECT owner, fp, "at", unseen FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY "at" DESC, fp DESC) k FROM (
  SELECT owner, fp, "at", nx, last_value(unseen IGNORE NULLS) OVER (PARTITION BY owner, fp, grp ORDER BY "at"
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) unseen FROM (
   SELECT *, sum(CASE WHEN pv THEN 0 ELSE 1 END) OVER (PARTITION BY owner, fp ORDER BY "at") grp FROM (
    SELECT *, coalesce(lead(sig) OVER w = sig AND lead(gates) OVER w = gates, false) nx,
     coalesce(lag(sig) OVER w = sig AND lag(gates) OVER w = gates, false) pv FROM runs
    WINDOW w AS (PARTITION BY owner, fp ORDER BY "at")))) WHERE NOT nx) WHERE k <= 50""")
def j3(spark, sf):
    return H.retain(runs(spark, sf))


@register("j4_attempts", "owner:s fp:s at:s attempt:i previous_at:s warn:b", _RUNS + """
 SELECT owner, fp, "at", row_number() OVER w attempt, lag("at") OVER w previous_at, row_number() OVER w >= 3 warn
 FROM runs WINDOW w AS (PARTITION BY owner, fp ORDER BY "at")""")
def j4(spark, sf):
    return H.attempts(runs(spark, sf))


@register("j5_compared_runs", "owner:s fp:s at:s gates_same:b forward_same:b same_data:b level_delta:i "
          "inside_count:i known_count:i", _RUNS + """
 SELECT owner, fp, "at", gates=pg gates_same, has_forward=pf forward_same, sig=ps same_data,
  list_position(lv, level)-list_position(lv, pl) level_delta,
  CAST(n BETWEEN pn-2 AND pn+2 AS INT) inside_count, 1 known_count FROM (
 SELECT *, lag(gates) OVER w pg, lag(has_forward) OVER w pf, lag(sig) OVER w ps, lag(level) OVER w pl, lag(n) OVER w pn,
  ['insufficient','weak','moderate','good','strong'] lv FROM runs WINDOW w AS (PARTITION BY owner, fp ORDER BY "at"))
 WHERE pn IS NOT NULL""")
def j5(spark, sf):
    n = F.col("n").cast("double")
    r = runs(spark, sf).withColumn("robust", n).withColumn("picks", F.create_map(
        F.lit("a"), n, F.lit("b"), n * 2)).withColumn("spans", F.create_map(
            F.lit("a"), F.struct((n - 2).alias("lo"), (n + 2).alias("hi"))))
    return H.compare_runs(r)


def tries(spark, sf):
    e = R.table(spark, sf, "events")
    d = F.to_date("ts")
    return e.select((F.col("user_id") % 5).alias("owner"), F.concat_ws(
        "-", "event_type", (F.col("user_id") % 20).cast("string")).alias("key"),
        F.col("ts").cast("string").alias("at"), F.col("event_id").alias("n"),
        (F.col("event_id") % 3 == 0).alias("counts"), (F.col("event_id") % 4).alias("plateau"),
        F.concat(F.lit("f"), F.col("user_id") % 20).alias("file"), d.alias("from_day"),
        F.date_add(d, 10).alias("to_day"))


_TRIES = """WITH tries AS MATERIALIZED (SELECT user_id % 5 AS owner, event_type||'-'||(user_id % 20) AS "key", ts, event_id n,
  event_id % 3 = 0 counts, event_id % 4 plateau, 'f'||(user_id % 20) file, CAST(ts AS DATE) from_day,
  CAST(ts AS DATE)+10 to_day FROM events),
kept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC) k FROM (
  SELECT owner, "key", max(n) n, max_by(counts, n) counts, max_by(plateau, n) plateau, max_by(file, n) file,
   max_by(from_day, n) from_day, max_by(to_day, n) to_day FROM tries GROUP BY ALL)) WHERE k <= 20)
"""


@register("j6_unseen_tries", "owner:i key:s n:i counts:b plateau:i",
          _TRIES + 'SELECT * FROM kept')
def j6(spark, sf):
    return H.unseen_tries(tries(spark, sf))


@register("j6_earlier_counted", "owner:i key:s n:i", _TRIES + """
 SELECT owner, "key", n FROM kept JOIN (SELECT owner, max("key") cur FROM kept GROUP BY 1) USING (owner)
 WHERE counts AND "key" <> cur""")
def j6b(spark, sf):
    t = H.unseen_tries(tries(spark, sf))
    return H.earlier_counted(t, t.groupBy("owner").agg(F.max("key").alias("key")))


@register("j6_without_whole_report", "owner:i key:s n:i", _TRIES + """
 SELECT owner, "key", n FROM kept WHERE (owner, n) NOT IN (SELECT (owner, max(n)) FROM kept GROUP BY owner)
  AND (owner, file, from_day) NOT IN (SELECT (owner, max_by(file, n), max_by(from_day, n)) FROM kept GROUP BY owner)""")
def j6c(spark, sf):
    t = H.unseen_tries(tries(spark, sf))
    cut = t.groupBy("owner").agg(*[F.max_by(c, "n").alias(c) for c in ("file", "from_day", "to_day")])
    return H.drop_whole_report(t, cut)


@register("j7_overlapping_tries", "owner:i key:s n:i", _TRIES + """
 SELECT owner, "key", n FROM kept JOIN (SELECT owner, max(from_day) a, max(to_day) b FROM kept GROUP BY 1)
 USING (owner) WHERE from_day <= b AND to_day >= a AND plateau <> 1""")
def j7(spark, sf):
    t = H.unseen_tries(tries(spark, sf))
    p = t.groupBy("owner").agg(F.max("from_day").alias("p_from"), F.max("to_day").alias("p_to"),
                               F.lit(1).alias("p_plateau"))
    return H.overlapping_tries(t, p)


# ------------------------------------------------------------------ evaluation
_pick = lambda name, src, order: (
    f"SELECT study_id, row_idx, '{name}' AS method FROM (SELECT *, row_number() OVER (PARTITION BY study_id "
    f"ORDER BY {order}, row_idx) k FROM {src}) WHERE k=1")
_BASE = chain("edges").rstrip() + """,
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY is_profit, row_idx)
  + row_number() OVER (PARTITION BY study_id ORDER BY oos_profit, row_idx) s FROM cells WHERE known),
nbm AS MATERIALIZED (SELECT study_id, row_idx, avg(x) m FROM (SELECT e.study_id, src row_idx, c.is_profit x FROM edges e
   JOIN cells c ON c.study_id=e.study_id AND c.row_idx=dst WHERE dist=1
   UNION ALL SELECT study_id, row_idx, is_profit FROM cells) GROUP BY ALL),
picks AS MATERIALIZED (""" + " UNION ALL ".join([
    _pick("best_optimised", "cells", "is_profit DESC"),
    _pick("best_forward", "rk", "oos_profit DESC"), _pick("best_rank_sum", "rk", "s DESC"),
    _pick("best_neighbour_mean", "nbm", "round(m, 6) DESC"),
    _pick("random_passing", f"(SELECT *, {draw_sql('1', 'row_idx+1')} u FROM cells)",
          "passes_joint DESC, u DESC")]) + """),
truth AS MATERIALIZED (SELECT study_id, row_idx, is_expected_payoff edge FROM passes),
sc AS MATERIALIZED (SELECT study_id, max(edge) oracle, list_sort(list(edge))[CAST(floor(count(*)/2.0) AS INT)+1] med
  FROM truth GROUP BY 1),
reg AS MATERIALIZED (SELECT p.*, edge, CASE WHEN oracle-med > 1e-9 THEN (oracle-edge)/(oracle-med) END regret
  FROM picks p JOIN truth USING (study_id, row_idx) JOIN sc USING (study_id))
"""


def _choices(spark, sf):
    a = audit(spark, sf)
    return V.baseline_selectors(a.cells, a.edges)


@register("k1_baseline_selectors", "study_id:s method:s row_idx:i", "SELECT * FROM picks", _BASE)
def k1(spark, sf):
    return _choices(spark, sf)


def _regret(spark, sf):
    truth = R.sweep(spark, sf).select("study_id", "row_idx", F.col("is.expected_payoff").alias("edge"))
    return V.regret(_choices(spark, sf), truth)


@register("k2_regret", "study_id:s method:s row_idx:i regret:d", "SELECT * FROM reg", _BASE)
def k2(spark, sf):
    return _regret(spark, sf)


@register("k2_regret_table", "group_:s method:s cases:i abstention:d median_regret:d", """
 SELECT g AS group_, method, count(*) cases, 0.0 abstention, median(regret) median_regret FROM (
  SELECT *, unnest([study_id, 'all']) g FROM reg) GROUP BY ALL""", _BASE)
def k2b(spark, sf):
    return V.regret_table(_regret(spark, sf).withColumnRenamed("study_id", "scenario")).withColumnRenamed(
        "group", "group_")


def cases(spark, sf):
    o = R.table(spark, sf, "orders")
    lv = F.get(F.array(*[F.lit(x) for x in H.LEVELS]), (F.col("o_custkey") % 5).cast("int"))
    return o.select(F.col("o_orderstatus").alias("scenario"), F.col("o_orderkey").alias("seed"),
                    lv.alias("level"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
                    .alias("row_idx"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") / 1e5)
                    .alias("edge"))


_CASES = """WITH c AS MATERIALIZED (SELECT o_orderstatus scenario, o_orderkey seed,
  ['insufficient','weak','moderate','good','strong'][CAST(o_custkey % 5 AS INT)+1] AS level,
  CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice/1e5 END edge FROM orders)
"""
_pos = "avg(CASE WHEN level IN ('moderate','good','strong') THEN 1.0 ELSE 0 END)"
_high = "avg(CASE WHEN level IN ('good','strong') THEN 1.0 ELSE 0 END)"


@register("k3_false_positives", "scenario:s cases:i positive:d high:d strong:d meets:b", _CASES + f"""
 SELECT coalesce(scenario,'total') scenario, count(*) cases, {_pos} positive, {_high} high,
  avg(CASE WHEN level='strong' THEN 1.0 ELSE 0 END) strong, {_pos} <= 0.05 meets FROM c GROUP BY ROLLUP(scenario)""")
def k3(spark, sf):
    return V.false_positive_table(cases(spark, sf))


@register("k3_power", "scenario:s cases:i power:d high:d meets:b", _CASES + f"""
 SELECT scenario, count(*) cases, {_pos} AS power, {_high} high, {_pos} >= 0.8 meets FROM c GROUP BY 1""")
def k3b(spark, sf):
    return V.power_table(cases(spark, sf))


@register("k3_level_coherence", "level:s cases:i mean_edge:d", _CASES + """
 SELECT level, count(*) cases, avg(edge) mean_edge FROM c WHERE edge IS NOT NULL GROUP BY 1""")
def k3c(spark, sf):
    return V.level_coherence(cases(spark, sf))


def forecasts(spark, sf):
    li = R.table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("cell"), F.col("l_quantity").alias("fall"),
        F.lit(25.5).alias("fall_p50"), F.lit(47.5).alias("fall_p95"), F.col("l_extendedprice").alias("total"),
        F.lit(6000.0).alias("total_p05"), F.lit(95000.0).alias("total_p95"),
        ((F.col("l_quantity") - 0.5) / 50).alias("pit"), (F.col("l_discount") * 2).alias("prob_loss"))


_CAL = """WITH cal AS MATERIALIZED (SELECT l_returnflag||'-'||l_linestatus cell, count(*) n,
  count(*) FILTER (l_quantity > 47.5) beyond_p95, count(*) FILTER (l_quantity > 25.5) beyond_p50,
  count(*) FILTER (l_extendedprice < 6000 OR l_extendedprice > 95000) outside, avg(pow(l_discount*2, 2)) brier,
  """ + ", ".join(f"count(*) FILTER (least(9, floor((l_quantity-0.5)/50*10)) = {i}) d{i}" for i in range(10)) + """
  FROM lineitem GROUP BY 1)
"""


@register("k4_interval_calibration", "cell:s n:i beyond_p95:i beyond_p50:i outside:i brier:d d0:i d4:i d9:i",
          _CAL + "SELECT * FROM cal")
def k4(spark, sf):
    return V.interval_calibration(forecasts(spark, sf))


_lm = lambda j: (f"(lgamma(n+1)-lgamma(({j})+1)-lgamma(n-({j})+1)+({j})*ln(r)+(n-({j}))*ln(1-r))")


_BINOMIAL = f"""
 SELECT cell, test, least(1, sum(CASE WHEN {_lm('j')} <= {_lm('k')} + 1e-7 THEN exp({_lm('j')}) ELSE 0 END)) p,
  any_value(k / n) rate, any_value(NOT k / n BETWEEN lo AND hi) off_band FROM (
  SELECT cell, n, test, k, r, lo, hi, unnest(range(CAST(greatest(0, floor(n*r-40*sqrt(n*r*(1-r))-40)) AS BIGINT),
   CAST(least(n, ceil(n*r+40*sqrt(n*r*(1-r))+40)) AS BIGINT)+1)) j FROM (""" + " UNION ALL ".join(
    f"SELECT cell, n, '{t}' test, {t} k, {r} r, {lo} lo, {hi} hi FROM cal" for t, (r, lo, hi) in V.BANDS.items()) + """))
 GROUP BY ALL"""
_DECILES = [f"d{i}" for i in range(10)]
_T = f"(1/(1+{N.NORM_CDF_P}*sqrt(chi)))"
_UPPER = (f"{N.NORM_CDF_DENSITY}*exp(-chi/2)*(" + "+".join(
    f"({b})*pow({_T}, {i + 1})" for i, b in enumerate(N.NORM_CDF_B)) + ")")
_HOLM = _CAL.rstrip() + f""", chis AS (SELECT cell, {'+'.join(f'pow({d}-n/10, 2)/(n/10)' for d in _DECILES)} chi,
  {' OR '.join(f'{d}/n NOT BETWEEN {V.DECILE_BAND[0]} AND {V.DECILE_BAND[1]}' for d in _DECILES)} off_band FROM cal),
tests AS MATERIALIZED (SELECT cell, test, rate, p, off_band FROM ({_BINOMIAL}) UNION ALL
 SELECT cell, 'pit', chi, CASE WHEN chi <= 0 THEN 1 ELSE 2*{_UPPER} + sqrt(2/3.141592653589793)*exp(-chi/2)
  *(sqrt(chi)*(1 + chi/3 + chi*chi/15 + chi*chi*chi/105)) END, off_band FROM chis),
placed AS (SELECT *, row_number() OVER (ORDER BY p, cell, test) place, count(*) OVER () m FROM tests),
stepped AS (SELECT *, max(CASE WHEN p*(m-place+1) >= {V.ALPHA} THEN 1 ELSE 0 END) OVER (ORDER BY place
  ROWS UNBOUNDED PRECEDING) = 0 AS significant FROM placed)
"""


@register("k5_binomial_tests", "cell:s test:s p:d", f"SELECT cell, test, p FROM ({_BINOMIAL})", _CAL)
def k5(spark, sf):
    t = V.calibration_tests(V.interval_calibration(forecasts(spark, sf)))
    return t.filter("test <> 'pit'")


@register("k5_calibration_verdict", "cell:s test:s rate:d off_band:b significant:b fails:b",
          "SELECT *, significant AND off_band fails FROM stepped", _HOLM)
def k5b(spark, sf):
    return V.calibration_tests(V.interval_calibration(forecasts(spark, sf)))


@register("k5_smallest_apt", "horizon:i smallest_days:i", """
 SELECT 126 AS horizon, min(days) FILTER (worst IS NULL OR days > worst) smallest_days FROM (
  SELECT n - n % 100 AS days, max(CASE WHEN cell IN (SELECT cell FROM stepped WHERE significant AND off_band)
   THEN n - n % 100 END) OVER () worst FROM cal)""", _HOLM)
def k5c(spark, sf):
    c = V.interval_calibration(forecasts(spark, sf))
    meta = c.select("cell", F.lit(126).alias("horizon"), (F.col("n") - F.col("n") % 100).alias("days"))
    return V.smallest_apt(V.calibration_tests(c), meta)


@register("k6_shrinkage_accuracy", "scenario:s cases:i rmse_is:d rmse_oos:d rmse_expected:d "
          "bias_oos:d below_bound:d detected:d", """
 SELECT coalesce(study_id,'total') scenario, count(*) cases, sqrt(avg(pow(xi-t,2)))/1e3 rmse_is,
  sqrt(avg(pow(xo-t,2)))/1e3 rmse_oos, sqrt(avg(pow(ex-t,2)))/1e3 rmse_expected, avg(xo-t)/1e3 bias_oos,
  avg(CASE WHEN t-family < lo THEN 1.0 ELSE 0 END) below_bound, avg(CASE WHEN lo > 0 THEN 1.0 ELSE 0 END) detected
 FROM (SELECT u.study_id, xi, xo, c.is_expected_payoff t, m.family, CASE WHEN v > 0
   THEN m.a+b*xi + v/(v+k/"to")*(xo-m.a-b*xi) ELSE m.a+b*xi END ex, CASE WHEN v > 0 THEN m.a+b*xi + v/(v+k/"to")*(xo-m.a-b*xi)
   ELSE m.a+b*xi END - family - 1000 lo
  FROM units u JOIN model m USING (study_id) JOIN cells c ON c.study_id=u.study_id AND c.row_idx=u.row_idx
  WHERE xo IS NOT NULL) GROUP BY ROLLUP(study_id)""", _with_units("edges"))
def k6(spark, sf):
    a = audit(spark, sf)
    u = B.units(a.cells, a.edges)
    p = B.posterior(u.filter("xo IS NOT NULL").join(B.shrink_model(u), "study_id")).join(
        a.cells.select("study_id", "row_idx", F.col("is.expected_payoff").alias("truth")),
        ["study_id", "row_idx"])
    c = p.select(F.col("study_id").alias("scenario"), (F.col("xi") / 1e3).alias("seen_is"),
                 (F.col("xo") / 1e3).alias("seen_oos"), (F.col("expected") / 1e3).alias("expected"),
                 (F.col("truth") / 1e3).alias("truth"),
                 ((F.col("truth") - F.col("family")) / 1e3).alias("true_own"),
                 ((F.col("expected") - F.col("family") - 1000) / 1e3).alias("own_lo"))
    return V.shrinkage_accuracy(c)


@register("k7_alarm_rates", "group_:s duration:d cases:i alarms:d outside:d", """
 SELECT o_orderstatus group_, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.2 END duration, count(*) cases,
  avg(CASE WHEN o_custkey % 3 <> 0 THEN 1.0 ELSE 0 END) alarms, avg(CASE WHEN o_custkey % 3 = 2 THEN 1.0 ELSE 0 END) outside
 FROM orders GROUP BY ALL""")
def k7(spark, sf):
    k = F.col("o_custkey") % 3
    c = R.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("group"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(0.2)
        .alias("duration"), F.when(k == 0, "normal").when(k == 1, "tail").otherwise("outside")
        .alias("unseen_level"))
    return V.alarm_rates(c).withColumnRenamed("group", "group_")


@register("k8_variant_comparison", "scenario:s cases:i level_changes:i choice_changes:i better:i worse:i", _CASES + """
 SELECT scenario, count(*) cases, count(*) FILTER (seed % 3 = 0 AND level <> 'weak') level_changes,
  count(*) FILTER (edge IS NOT NULL AND seed % 4 = 1) choice_changes,
  count(*) FILTER (edge IS NOT NULL AND seed % 4 = 1 AND seed % 8 = 1) better,
  count(*) FILTER (edge IS NOT NULL AND seed % 4 = 1 AND seed % 8 <> 1) worse FROM c GROUP BY 1""")
def k8(spark, sf):
    a = cases(spark, sf).dropDuplicates(["scenario", "seed"])
    s = F.col("seed")
    b = a.withColumn("level", F.when(s % 3 == 0, "weak").otherwise(F.col("level"))).withColumn(
        "edge", F.col("edge") + F.when(s % 8 == 1, 1.0).when(s % 4 == 1, -1.0).otherwise(0.0))
    return V.variant_comparison(a, b)


@register("k8_sharpe_variants", "study_id:s chance_max:d chance_max_cells:d chance_max_noise:d beats:b "
          "beats_cells:b beats_noise:b")
def k8b(spark, sf):
    a = audit(spark, sf)
    return V.sharpe_variants(B.sharpe_selection(a.cells), P.effective_trials(a.coarse),
                             B.neighbour_noise(a.cells, a.edges))


@register("k8_table_order_rule", "study_id:s level:s fired:b would_change:b")
def k8c(spark, sf):
    m = metrics(spark, sf)
    f = verdict.findings(m)
    return V.table_order_rule(verdict.evidence_level(f, m), f)
