"""Trade-list queries over the derived deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateauscope.operators import montecarlo as M
from plateauscope.operators import trades as T
from plateauscope.plans import relations as R
from plateauscope.plans.stages import memo, stage

from .base import register
from .stats import draw_sql, norm_inv_sql

_D = """WITH d0 AS MATERIALIZED (
 SELECT CAST(l_suppkey % 5 AS INT) report_id, l_shipdate ts, CAST(l_shipdate AS DATE) AS day,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag symbol, l_quantity volume,
  l_extendedprice/l_quantity price, CAST(round(l_extendedprice*100) AS BIGINT)-5100000 net_cents,
  CAST(-l_linenumber AS BIGINT) commission_cents, CAST(0 AS BIGINT) swap_cents FROM lineitem),
d AS MATERIALIZED (SELECT *, row_number() OVER w seq, net_cents-commission_cents profit_cents,
  1000000000 + sum(net_cents) OVER (w ROWS UNBOUNDED PRECEDING) balance_cents FROM d0
  WINDOW w AS (PARTITION BY report_id ORDER BY ts,l_orderkey,l_linenumber,l_partkey,l_suppkey,net_cents)),
dd AS MATERIALIZED (SELECT report_id, day, sum(net_cents) pnl_cents, sum(volume) volume, count(*) trades,
  sum(price*volume*10) notional FROM d GROUP BY ALL),
cal AS MATERIALIZED (SELECT report_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT report_id, min(day) a, max(day) b FROM dd GROUP BY 1)),
daily AS MATERIALIZED (SELECT cal.report_id, cal.day, row_number() OVER (PARTITION BY cal.report_id
   ORDER BY cal.day)-1 day_idx, coalesce(pnl_cents,0) pnl_cents, coalesce(volume,0) volume,
  coalesce(trades,0) trades, coalesce(notional,0) notional FROM cal
  LEFT JOIN dd ON dd.report_id=cal.report_id AND dd.day=cal.day
  WHERE trades IS NOT NULL OR dayofweek(cal.day) NOT IN (0,6)),
mean AS MATERIALIZED (SELECT report_id, avg(pnl_cents) m, count(*) n FROM daily GROUP BY 1),
y AS MATERIALIZED (SELECT daily.report_id, day_idx t, pnl_cents-m y, n FROM daily JOIN mean USING (report_id))
"""


def contracts(spark, sf):
    return R.closed(spark, sf).select("report_id", "symbol").distinct().withColumn(
        "value_per_unit", F.lit(10.0))


def daily(spark, sf):
    return memo(spark, (sf, "daily"), lambda: T.daily_series(R.closed(spark, sf),
                                                            contracts(spark, sf)))


@register("h1_cost_carry", "report_id:i seq:i commission_cents:i open_commission_cents:i "
          "net_cents:i", _D + """
 SELECT report_id, max(seq) seq, sum(commission_cents) commission_cents,
  coalesce(sum(commission_cents) FILTER (NOT c),0) open_commission_cents,
  max(profit_cents) FILTER (c) + sum(commission_cents) net_cents FROM (
  SELECT *, count(*) FILTER (c) OVER (PARTITION BY report_id ORDER BY seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) island FROM (
   SELECT *, l_linenumber % 3 <> 0 c FROM d)) GROUP BY report_id, island
 HAVING count(*) FILTER (c) > 0""")
def h1(spark, sf):
    raw = R.deals(spark, sf).withColumn("is_close", F.col("commission_cents") % 3 != 0)
    return T.cost_carry(raw)


def fills(spark, sf):
    """Every third deal opens more than the two that follow it close; each side in turn."""
    d = R.deals(spark, sf).select("report_id", "symbol", "seq", "ts", "price", "volume")
    k = F.col("seq") % 4
    side = F.when(k.isin(0, 3), "buy").otherwise("sell")
    return d.withColumn("direction", F.when(k < 2, "in").otherwise("out")).withColumn("side", side)


_FIFO = _D + """, legs AS MATERIALIZED (
 SELECT report_id, symbol, seq, ts, price, volume, seq % 4 < 2 opens,
  CASE WHEN seq % 4 IN (0, 2) THEN 'buy' ELSE 'sell' END AS queue FROM d),
flow AS MATERIALIZED (SELECT *, x0 - least(0, min(-x0n) OVER w2) q FROM (
  SELECT *, sum(CASE WHEN opens THEN volume ELSE -volume END) OVER w x0,
   -sum(CASE WHEN opens THEN volume ELSE -volume END) OVER w x0n,
   sum(CASE WHEN opens THEN volume ELSE 0 END) OVER w opened FROM legs
  WINDOW w AS (PARTITION BY report_id, symbol, queue ORDER BY seq))
 WINDOW w2 AS (PARTITION BY report_id, symbol, queue ORDER BY seq)),
used AS MATERIALIZED (SELECT *, coalesce(lag(c1) OVER (PARTITION BY report_id, symbol, queue ORDER BY seq), 0) c0
 FROM (SELECT *, opened - q c1 FROM flow)),
hit AS MATERIALIZED (SELECT c.report_id, c.symbol, c.queue, c.seq, sum(least(c.c1, o.opened) - greatest(c.c0, o.opened-o.volume)) matched,
  sum((least(c.c1, o.opened) - greatest(c.c0, o.opened-o.volume)) * o.price) cost, min(o.ts) open_ts
 FROM used c JOIN used o ON o.report_id=c.report_id AND o.symbol=c.symbol AND o.queue=c.queue
  AND o.opens AND NOT c.opens AND o.opened > c.c0 AND o.opened-o.volume < c.c1 GROUP BY ALL),
fifo AS MATERIALIZED (SELECT u.report_id, u.symbol, u.seq, u.ts, u.price, u.volume closed_volume, u.queue position_side,
  coalesce(matched,0) matched, CASE WHEN abs(matched-volume) < 1e-9 THEN cost/matched END open_price
 FROM used u LEFT JOIN hit USING (report_id, symbol, queue, seq) WHERE NOT opens)
"""


def fifo(spark, sf):
    return memo(spark, (sf, "fifo"), lambda: T.match_fifo(fills(spark, sf), stage))


@register("h2_fifo_matching", "report_id:i seq:i position_side:s closed_volume:d matched:d "
          "open_price:d", _FIFO + "SELECT * REPLACE (open_price/7.3 AS open_price) FROM fifo")
def h2(spark, sf):
    return fifo(spark, sf).withColumn("open_price", F.col("open_price") / 7.3)


@register("h3_daily_series", "report_id:i day:s day_idx:i pnl_cents:i trades:i volume:d notional:d",
          _D + "SELECT * FROM daily")
def h3(spark, sf):
    return daily(spark, sf)


@register("h4_day_trades", "report_id:i day_idx:i seq:i inc:d", _D + """
 SELECT d.report_id, day_idx, seq, ln(1 + net_cents/CAST(balance_cents-net_cents AS DOUBLE)) inc
 FROM d JOIN daily ON daily.report_id=d.report_id AND daily.day=d.day
 WHERE d.report_id NOT IN (SELECT report_id FROM d WHERE balance_cents-net_cents <= 0
  OR balance_cents <= 0)""")
def h4(spark, sf):
    return T.day_trades(R.deals(spark, sf), log=True, daily=daily(spark, sf))


@register("h5_contract_values", "report_id:i symbol:s value_per_unit:d median_price:d samples:i "
          "agreement:d point:d", _FIFO + """, v AS (SELECT report_id, symbol, price,
  CASE WHEN seq % 5 = 0 THEN 13.0 ELSE 10.0 END v FROM fifo WHERE open_price IS NOT NULL
   AND abs(price-open_price) >= 2e-5*price)
 SELECT v.report_id, v.symbol, any_value(m) value_per_unit, median(price) median_price, count(*) samples,
  avg(CASE WHEN abs(v/m-1) <= 0.1 THEN 1.0 ELSE 0 END) agreement, 0.01 point
 FROM v JOIN (SELECT report_id, symbol, median(v) m FROM v GROUP BY ALL) USING (report_id, symbol)
 GROUP BY ALL HAVING count(*) >= 5""")
def h5(spark, sf):
    c = fifo(spark, sf)
    move = (F.col("price") - F.col("open_price")) * F.when(
        F.col("position_side") == "buy", 1).otherwise(-1)
    value = F.when(F.col("seq") % 5 == 0, 13.0).otherwise(10.0)
    return T.contract_values(c.withColumn("profit", move * F.col("closed_volume") * value)
                             .withColumn("digits", F.lit(2)))


_eq = """eq AS MATERIALIZED (SELECT *, sum(x) OVER (PARTITION BY report_id{k} ORDER BY day_idx ROWS UNBOUNDED PRECEDING) e
  FROM src), fl AS MATERIALIZED (SELECT *, greatest(0, max(e) OVER (PARTITION BY report_id{k} ORDER BY day_idx
  ROWS UNBOUNDED PRECEDING)) - e f FROM eq)"""


def _scaled(df):
    """Money in units of 300, so that six decimals are far from the precision of a double."""
    return df.withColumns({c: F.col(c) / 3e4 for c in (
        "stressed_cents", "cost_cents", "drawdown_cents")})


@register("h6_cost_stress", "report_id:i stressed_cents:d cost_cents:d degradation:d "
          "still_profitable:b drawdown_cents:d", _D + """, src AS MATERIALIZED (SELECT *, 2*1e-4*notional*100
  + 0.5*100*volume + (2*0.25+0.1)*100*trades c, pnl_cents - (2*1e-4*notional*100 + 0.5*100*volume
  + (2*0.25+0.1)*100*trades) x FROM daily), """ + _eq.format(k="") + """
 SELECT report_id, sum(x)/3e4 stressed_cents, sum(c)/3e4 cost_cents,
  (sum(pnl_cents)-sum(x))/abs(sum(pnl_cents)) degradation, sum(x) > 0 still_profitable,
  max(f)/3e4 drawdown_cents FROM fl GROUP BY 1""")
def h6(spark, sf):
    return _scaled(T.cost_stress(daily(spark, sf), 2.0, per_lot=0.5, per_side=0.25,
                                 per_trade=0.1))


@register("h7_cost_scenarios", "report_id:i scenario:s stressed_cents:d degradation:d "
          "drawdown_cents:d", _D + """, src AS MATERIALIZED (SELECT *, pnl_cents - bp*1e-4*notional*100 x FROM daily,
  (VALUES ('base',0.0),('moderate',1.0),('severe',3.0)) s(scenario, bp)), """
          + _eq.format(k=", scenario") + """
 SELECT report_id, scenario, sum(x)/3e4 stressed_cents,
  (sum(pnl_cents)-sum(x))/abs(sum(pnl_cents)) degradation, max(f)/3e4 drawdown_cents
 FROM fl GROUP BY ALL""")
def h7(spark, sf):
    return _scaled(T.cost_scenarios(daily(spark, sf)))


@register("h7_break_even", "report_id:i per_trade:d per_lot:d bp:d", _D + """
 SELECT report_id, sum(pnl_cents)/100.0/sum(trades) per_trade, sum(pnl_cents)/100.0/sum(volume) per_lot,
  sum(pnl_cents)/100.0/sum(notional)*1e4 bp FROM daily GROUP BY 1""")
def h7b(spark, sf):
    return T.break_even(daily(spark, sf))


@register("h8_equity_drawdown", "report_id:i days:i net_cents:i max_drawdown_cents:i sharpe:d",
          _D + ", src AS MATERIALIZED (SELECT *, pnl_cents x FROM daily), " + _eq.format(k="") + """
 SELECT report_id, count(*) AS days, sum(pnl_cents) net_cents, max(f) max_drawdown_cents,
  avg(pnl_cents)/stddev_samp(pnl_cents) sharpe FROM fl GROUP BY 1""")
def h8(spark, sf):
    return T.sharpe_and_drawdown(daily(spark, sf))


def days(spark, sf):
    return memo(spark, (sf, "day_arrays"), lambda: M.day_summaries(
        T.day_trades(R.deals(spark, sf), daily=daily(spark, sf)), daily(spark, sf)))


@register("h9_stationary_bootstrap", "report_id:i sims:i total_p05:d total_p50:d total_p95:d "
          "fall_p50:d fall_p95:d loss_63:d loss_126:d loss_252:d")
def h9(spark, sf):
    return M.bootstrap_summary(M.stationary_bootstrap(days(spark, sf)))


@register("h10_mean_interval", "report_id:i n:i mean_p05:d mean_p50:d mean_p95:d")
def h10(spark, sf):
    return M.mean_interval(M.bootstrap_summary(M.stationary_bootstrap(days(spark, sf))))


@register("h11_sample_audit", "report_id:i n:i sharpe:d min_track:i reason:s", _D + f"""
 SELECT report_id, n, sharpe, min_track, CASE WHEN n < 30 THEN 'few_days'
  WHEN abs(sharpe)*sqrt(n) < {norm_inv_sql('0.8')}+{norm_inv_sql('0.95')} OR n < min_track
  THEN 'low_power' END reason FROM (SELECT *, ceil(least(20000, greatest(30, ceil(pow((
   {norm_inv_sql('0.8')}+{norm_inv_sql('0.95')})/abs(sharpe), 2))))*(1+ln(10))) min_track FROM (
  SELECT report_id, count(*) n, avg(pnl_cents)/stddev_samp(pnl_cents) sharpe FROM daily GROUP BY 1))""")
def h11(spark, sf):
    return T.sample_audit(daily(spark, sf), trials=10)


@register("h12_swap_warnings", "report_id:i swap_share:d warnings:s", _D + """
 SELECT report_id, least(1, abs(sum(commission_cents*1000))/CAST(abs(sum(net_cents)) AS DOUBLE))
  swap_share, CASE WHEN least(1, abs(sum(commission_cents*1000))/CAST(abs(sum(net_cents)) AS DOUBLE)) > 0.05
  THEN 'swap_dominance' ELSE '' END warnings FROM d GROUP BY 1""")
def h12(spark, sf):
    d = R.deals(spark, sf).withColumn("swap_cents", F.col("commission_cents") * 1000)
    return T.swap_warnings(d, avg_trade_days=1.0).withColumn(
        "warnings", F.concat_ws(",", "warnings"))


@register("h13_unseen_trades_audit", "report_id:i days:i per_trade:d sharpe:d swap_share:d", _D + """
 SELECT report_id, count(*) AS days, sum(pnl_cents)/100.0/sum(trades) per_trade,
  avg(pnl_cents)/stddev_samp(pnl_cents) sharpe, 0.0 swap_share FROM daily GROUP BY 1""")
def h13(spark, sf):
    return T.unseen_trades_audit(R.deals(spark, sf))


@register("h14_position_sizing", "report_id:i sizing:s signal:s trades:i up_after_loss:d "
          "up_after_win:d growth:d", _D + """
 SELECT report_id, CASE WHEN growth >= 1.25 AND slope >= 0.5 THEN 'proportional' ELSE 'fixed' END sizing,
  CASE WHEN NOT b0 > 0 THEN 'no_balance' WHEN growth < 1.25 THEN 'stable_balance'
   WHEN slope >= 0.5 THEN 'grows_with_balance' ELSE 'does_not_grow' END signal,
  trades, ul*1.0/al up_after_loss, uw*1.0/aw up_after_win, growth FROM (
 SELECT report_id, count(*) trades, count(*) FILTER (nv IS NOT NULL AND net_cents<0) al,
  count(*) FILTER (nv IS NOT NULL AND net_cents>0) aw,
  count(*) FILTER (nv > volume*1.05 AND net_cents<0) ul, count(*) FILTER (nv > volume*1.05 AND net_cents>0) uw,
  max(b)/CAST(min(b) AS DOUBLE) growth, min(b) b0, regr_slope(ln(volume), ln(CASE WHEN b > 0 THEN b END)) slope
 FROM (SELECT *, lead(volume) OVER (PARTITION BY report_id ORDER BY seq) nv,
  balance_cents-net_cents b FROM d) GROUP BY 1)""")
def h14(spark, sf):
    return T.detect_sizing(R.deals(spark, sf))


def cuts(spark, sf):
    ids = R.deals(spark, sf).select("report_id").distinct()
    return ids.select("report_id", F.to_date(F.when(
        F.col("report_id") == 4, "2030-01-01").otherwise("1999-12-31")).alias("choose_end"),
        F.to_date(F.when(F.col("report_id") < 2, "1997-12-31")).alias("opt_end"))


def opened(spark, sf):
    """Deals with an opening 0 to 6 days before the close."""
    return R.deals(spark, sf).withColumn("open_ts", F.col("ts") - F.make_dt_interval(
        (F.col("seq") % 7).cast("int")) - F.make_dt_interval((F.col("seq") % 5).cast("int")))


_seg = """seg AS MATERIALIZED (SELECT *, CASE segment WHEN 'clean' THEN DATE '2000-01-01' WHEN 'fwd' THEN DATE '1998-01-01'
  ELSE (SELECT min(day) FROM d z WHERE z.report_id=s.report_id) END from_day FROM (
 SELECT *, CASE WHEN report_id < 2 AND day <= DATE '1997-12-31' THEN 'opt'
  WHEN day <= DATE '1999-12-31' THEN CASE WHEN report_id < 2 THEN 'fwd' ELSE 'used' END
  ELSE 'clean' END segment FROM d WHERE report_id <> 4) s)"""


@register("h15_cut_segments", "report_id:i segment:s from_day:s trades:i straddling:i error:s",
          _D + ", " + _seg + """
 SELECT report_id, segment, from_day, count(*) trades, count(*) FILTER (
   CAST(ts AS DATE) - CAST(seq % 7 + seq % 5 AS INT) < from_day) straddling, NULL AS error
 FROM seg GROUP BY ALL UNION ALL SELECT 4, NULL, NULL, 0, 0, 'no_trades_after'""")
def h15(spark, sf):
    return T.split_by_cuts(opened(spark, sf), cuts(spark, sf))[1]


@register("h16_deal_summary", "report_id:i trades:i net_cents:i profit_factor:d", _D + """
 SELECT report_id, count(*) trades, sum(net_cents) net_cents,
  sum(greatest(net_cents + 3, 0))/CAST(sum(greatest(-net_cents-3,0) + 3) AS DOUBLE) profit_factor
 FROM d GROUP BY 1""")
def h16(spark, sf):
    return T.deal_summary(R.deals(spark, sf).withColumn("open_commission_cents", F.lit(-3)))


_BL = _D + """, sz AS MATERIALIZED (SELECT report_id, n, greatest(5, CAST(ceil(sqrt(log10(n))) AS INT)) kn, CAST(ceil(sqrt(n)) AS INT)
   + greatest(5, CAST(ceil(sqrt(log10(n))) AS INT)) mmax, 2*sqrt(log10(n)/n) thr,
   ceil(least(3*sqrt(n), n/3.0)) bmax FROM mean),
al AS MATERIALIZED (SELECT a.report_id, k, a.t-k t2, y, a.n FROM y a JOIN sz USING (report_id), range(0,400) r(k)
  WHERE k <= mmax+kn AND a.t >= k),
acv AS MATERIALIZED (SELECT al.report_id, k, sum(al.y*b.y)/any_value(al.n) g FROM al
  JOIN y b ON b.report_id=al.report_id AND b.t=al.t2 GROUP BY ALL),
rho AS MATERIALIZED (SELECT acv.report_id, k, abs(g/g0) r, g, g0 FROM acv
  JOIN (SELECT report_id, g g0 FROM acv WHERE k=0) USING (report_id)),
mh AS MATERIALIZED (SELECT report_id, coalesce(min(k) FILTER (f < thr), max(k) FILTER (r >= thr), 1) mhat FROM (
  SELECT *, max(r) OVER (PARTITION BY report_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) f FROM rho)
  JOIN sz USING (report_id) WHERE k BETWEEN 1 AND mmax GROUP BY 1),
w AS MATERIALIZED (SELECT report_id, any_value(g0) + sum(2*l*g) d0, sum(2*k*l*g) big FROM (
  SELECT rho.*, CASE WHEN k/CAST(least(2*mhat, mmax) AS DOUBLE) < 0.5 THEN 1.0
   ELSE 2*(1-k/CAST(least(2*mhat, mmax) AS DOUBLE)) END l
  FROM rho JOIN mh USING (report_id) JOIN sz USING (report_id) WHERE k BETWEEN 1 AND least(2*mhat, mmax))
  GROUP BY 1)
"""


@register("h17_block_length", "report_id:i n:i mhat:i block:d", _BL + """
 SELECT report_id, n, mhat, least(bmax, greatest(1, cbrt(2*big*big/(2*d0*d0))*cbrt(n))) AS block
 FROM w JOIN sz USING (report_id) JOIN mh USING (report_id)""")
def h17(spark, sf):
    return T.block_length(daily(spark, sf))


PRED = ("report_id:i sims:i total_p05:d total_p50:d total_p95:d fall_p50:d fall_p95:d prob_loss:d "
        "prob_fall_0:d")


@register("h18_two_stage_forecast", PRED)
def h18(spark, sf):
    return M.predictive_summary(M.predictive_paths(
        days(spark, sf), T.block_length(daily(spark, sf)), 126), (1e8,))


@register("h19_urn_forecast", PRED)
def h19(spark, sf):
    return M.predictive_summary(M.predictive_paths(
        days(spark, sf), T.block_length(daily(spark, sf)), 126, method="bayes"), (1e8,))


@register("h20_calibrated_forecast", "report_id:i horizon:i total_p05:d total_p50:d total_p95:d "
          "fall_p50:d fall_p95:d prob_loss:d")
def h20(spark, sf):
    return M.calibrated_forecast(days(spark, sf), T.block_length(daily(spark, sf)), 126,
                                 sims=1000, outer=50, inner=100)


@register("h21_randomised_pit", "report_id:i pit:d", _D + """
 SELECT report_id, (count(*) FILTER (pnl_cents < y) + 0.25*count(*) FILTER (pnl_cents = y))/count(*) pit
 FROM daily JOIN (SELECT report_id, max_by(pnl_cents, day_idx) y FROM daily GROUP BY 1) USING (report_id)
 GROUP BY 1""")
def h21(spark, sf):
    d = daily(spark, sf)
    last = d.groupBy("report_id").agg(F.max_by("pnl_cents", "day_idx").alias("y"))
    return M.randomised_pit(d.select("report_id", F.col("pnl_cents").alias("x")), last,
                            ["report_id"], 0.25)


def _chi(q: str) -> str:
    h = f"({q}/2)"
    return (f"CASE WHEN {q} <= 0 THEN 1 ELSE exp(-{h})*(1+{h}+pow({h},2)/2+pow({h},3)/6"
            f"+pow({h},4)/24) END")


def _pairs(src: str, value: str) -> str:
    return f"""(SELECT a.report_id, k, a.v*b.{value} p, a.n FROM (SELECT report_id, k, t-k t2, {value} v, n
   FROM {src}, range(1,11) r(k) WHERE t >= k OFFSET 0) a JOIN {src} b
   ON b.report_id=a.report_id AND b.t=a.t2)"""


def _lb(src: str) -> str:
    return f"""SELECT report_id, q, {_chi('q')} p FROM (
 SELECT report_id, sum(pow(s/g0,2)/(n-k))*any_value(n)*(any_value(n)+2) q FROM (
  SELECT report_id, k, sum(p) s, any_value(n) n FROM {_pairs(src, 'z')} GROUP BY ALL)
  JOIN (SELECT report_id, sum(z*z) g0 FROM {src} GROUP BY 1) USING (report_id) GROUP BY 1)"""


@register("h22_ljung_box", "report_id:i q:d p:d", _D + ", z AS MATERIALIZED (SELECT report_id, t, n, y z FROM y) "
          + _lb("z"))
def h22(spark, sf):
    return T.ljung_box(T.centred(daily(spark, sf)))


@register("h22_robust_portmanteau", "report_id:i q:d p:d", _D + f"""
 SELECT report_id, q, {_chi('q')} p FROM (SELECT report_id, sum(s*s/s2) q FROM (
  SELECT report_id, k, sum(p) s, sum(p*p) s2 FROM {_pairs('y', 'y')} GROUP BY ALL)
  WHERE s2 > 0 GROUP BY 1)""")
def h22b(spark, sf):
    return T.robust_portmanteau(T.centred(daily(spark, sf)))


def _volatility(name, kind, expr):
    z = _D + f""", v AS MATERIALIZED ({expr}),
 z AS MATERIALIZED (SELECT report_id, t, v - avg(v) OVER (PARTITION BY report_id) z,
  count(*) OVER (PARTITION BY report_id) n FROM v) """
    @register(name, "report_id:i q:d p:d", z + _lb("z"))
    def fn(spark, sf):
        return T.volatility_clustering(daily(spark, sf), kind)


_volatility("h22_volatility_squares", "squares", "SELECT report_id, t, y*y v FROM y")
_volatility("h22_volatility_absolute", "absolute", "SELECT report_id, t, abs(y) v FROM y")
_volatility("h22_volatility_rank", "rank", """SELECT report_id, t, rank() OVER (PARTITION BY report_id ORDER BY a)
  + (count(*) OVER (PARTITION BY report_id, a)-1)/2.0 v FROM (SELECT report_id, day_idx t,
  abs(pnl_cents-m) a FROM daily JOIN (SELECT report_id, median(pnl_cents) m FROM daily GROUP BY 1) USING (report_id))""")


def _orders(spark, sf):
    return memo(spark, (sf, "order_paths"), lambda: _order_tables(spark, sf))


def _order_tables(spark, sf):
    """Paths and equity at the grid points, in one table; point 0 has the path's own figures."""
    paths, marks = M.order_paths(days(spark, sf), stage=stage)
    at = M.order_points(marks, T.day_trades(R.deals(spark, sf), daily=daily(spark, sf)))
    none = F.lit(None).cast("double")
    return paths.select("report_id", "sim", F.lit(0).cast("long").alias("point"), none.alias("x"),
                        "total", "fall", "longest").unionByName(at.select(
                            "report_id", "sim", "point", "x", none.alias("total"), none.alias("fall"),
                            none.alias("longest")))


# Days with trades as summaries, and every path as a running sum over them in the order of its draws.
_ORDERS = _D + f""", inside AS MATERIALIZED (SELECT report_id, day, net_cents, row_number() OVER w k,
  sum(net_cents) OVER (w ROWS UNBOUNDED PRECEDING) c,
  count(*) FILTER (net_cents > 0) OVER (w ROWS UNBOUNDED PRECEDING) g FROM d
  WINDOW w AS (PARTITION BY report_id, day ORDER BY seq)),
peaks AS MATERIALIZED (SELECT *, greatest(0, max(c) OVER (PARTITION BY report_id, day ORDER BY k
  ROWS UNBOUNDED PRECEDING)) p FROM inside),
runs AS (SELECT report_id, day, g, count(*) FILTER (net_cents < 0) l FROM inside GROUP BY ALL),
streaks AS (SELECT report_id, day, max(l) longest, max(g) > 0 won, max_by(l, g) tail,
  coalesce(max(l) FILTER (g = 0), 0) lead FROM runs GROUP BY ALL),
sums AS MATERIALIZED (SELECT p.report_id, p.day, sum(net_cents) total, max(p) hi, least(0, min(c)) lo,
  max(p - c) fall, count(*) cnt, any_value(longest) longest, any_value(won) won, any_value(tail) tail,
  any_value(lead) lead, row_number() OVER (PARTITION BY p.report_id ORDER BY p.day) j
  FROM peaks p JOIN streaks USING (report_id, day) GROUP BY p.report_id, p.day),
sizes AS (SELECT report_id, count(*) n, sum(cnt) trades FROM sums GROUP BY 1
  HAVING sum(cnt) >= {M.MIN_ORDER_TRADES} AND count(*) >= 2),
orders AS MATERIALIZED (SELECT s.*, sim, CASE WHEN sim >= 0 THEN
  {draw_sql(str(M.ORDER_SEED), "sim*n + j")} ELSE j END u
  FROM sums s JOIN sizes USING (report_id), range(-1, 2000) q(sim)),
"""

_LUCK = _ORDERS + """walk AS MATERIALIZED (SELECT *, sum(total) OVER w - total b,
  sum(CASE WHEN won THEN 1 ELSE 0 END) OVER w gg FROM orders
  WINDOW w AS (PARTITION BY report_id, sim ORDER BY u, j ROWS UNBOUNDED PRECEDING)),
walk2 AS (SELECT *, greatest(0, coalesce(max(b + hi) OVER (PARTITION BY report_id, sim ORDER BY u, j
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) peak,
  sum(tail) OVER (PARTITION BY report_id, sim, gg ORDER BY u, j ROWS UNBOUNDED PRECEDING) carry FROM walk),
walk3 AS (SELECT report_id, sim, fall, peak - b - lo drop_, longest, lead, coalesce(lag(carry) OVER (
   PARTITION BY report_id, sim ORDER BY u, j), 0) carried FROM walk2),
paths AS MATERIALIZED (SELECT report_id, sim, max(greatest(fall, drop_)) f,
  max(greatest(longest, carried + lead)) l FROM walk3 GROUP BY ALL),
real AS (SELECT report_id, f rf, l rl FROM paths WHERE sim < 0)
"""
_at = lambda v, p: f"list_sort(list({v}))[1 + CAST(floor(2000*{p}) AS INT)]"


@register("h24_order_luck", "report_id:i sims:i real_fall:d real_streak:i fall_p05:d fall_p50:d "
          "fall_p95:d streak_p50:i streak_p95:i fall_percentile:d worse_share:d", f"""
 SELECT report_id, 2000 sims, rf real_fall, rl real_streak, {_at('f', .05)} fall_p05, {_at('f', .5)} fall_p50,
  {_at('f', .95)} fall_p95, {_at('l', .5)} streak_p50, {_at('l', .95)} streak_p95,
  (count(*) FILTER (f < rf) + 0.5 * count(*) FILTER (f = rf)) / 2000 fall_percentile,
  count(*) FILTER (f > rf) / 2000 worse_share
 FROM paths JOIN real USING (report_id) WHERE sim >= 0 GROUP BY report_id, rf, rl""", _LUCK)
def h24(spark, sf):
    return M.order_summary(_orders(spark, sf).filter("point = 0").drop("point", "x"))


_POINTS = _ORDERS + f"""grid AS (SELECT report_id, CAST(floor((i + 1) * trades / least(trades, {M.GRID_POINTS})
   + 0.5) AS BIGINT) - 1 AS g FROM sizes, range(0, {M.GRID_POINTS}) q(i) WHERE i < trades),
prefix AS (SELECT report_id, sim, day, cnt, sum(cnt) OVER w - cnt start_, sum(total) OVER w - total b
  FROM orders WINDOW w AS (PARTITION BY report_id, sim ORDER BY u, j ROWS UNBOUNDED PRECEDING)),
hits AS (SELECT p.report_id, sim, day, g + 1 point, g - start_ + 1 k, b FROM prefix p JOIN grid
  ON grid.report_id = p.report_id AND g >= start_ AND g < start_ + cnt),
at_ AS MATERIALIZED (SELECT h.report_id, sim, point, b + c x FROM hits h JOIN inside i
  ON i.report_id = h.report_id AND i.day = h.day AND i.k = h.k)
"""


@register("h24_order_bands", "report_id:i point:i p05:d p25:d p50:d p75:d p95:d real:d", f"""
 SELECT a.report_id, a.point, {', '.join(f"{_at('a.x', p)} p{int(100 * p):02d}" for p in (.05, .25, .5, .75, .95))},
  any_value(r.x) AS real FROM at_ a JOIN (SELECT report_id, point, x FROM at_ WHERE sim < 0) r
  ON r.report_id = a.report_id AND r.point = a.point WHERE a.sim >= 0 GROUP BY a.report_id, a.point""", _POINTS)
def h24b(spark, sf):
    return M.order_bands(_orders(spark, sf).filter("point > 0"))


@register("h24_sample_curves", "report_id:i sim:i point:i equity:d",
          "SELECT report_id, sim, point, x equity FROM at_ WHERE sim < 100", _POINTS)
def h24d(spark, sf):
    c = M.order_curves(_orders(spark, sf).filter("point > 0"))
    return c.select("report_id", "sim", F.explode(F.arrays_zip("points", "curve")).alias("p")).select(
        "report_id", "sim", F.col("p.points").alias("point"), F.col("p.curve").alias("equity"))


@register("h24_real_order", "report_id:i real_fall:d real_streak:i", _D + """, e AS MATERIALIZED (SELECT *, sum(net_cents) OVER
   (PARTITION BY report_id ORDER BY seq ROWS UNBOUNDED PRECEDING) e,
   count(*) FILTER (net_cents > 0) OVER (PARTITION BY report_id ORDER BY seq ROWS UNBOUNDED PRECEDING) g
  FROM d), f AS MATERIALIZED (SELECT *, greatest(0, max(e) OVER (PARTITION BY report_id ORDER BY seq
   ROWS UNBOUNDED PRECEDING))-e f FROM e)
 SELECT report_id, max(f) real_fall, (SELECT max(c) FROM (SELECT count(*) FILTER (net_cents<0) c FROM f z
   WHERE z.report_id=f.report_id GROUP BY g)) real_streak FROM f GROUP BY report_id""")
def h24c(spark, sf):
    return M.order_summary(M.order_paths(days(spark, sf), sims=1)[0])


@register("h25_gated_report", "report_id:i sizing:s mode:s days:i trading_days:i streak_p:d "
          "volatility_p:d gates_ok:b forecast_ok:b")
def h25(spark, sf):
    return T.gated_report(R.deals(spark, sf), daily(spark, sf))


@register("h26_forecast_table", "report_id:i horizon:i total_p05:d total_p50:d total_p95:d "
          "fall_p95:d prob_loss:d")
def h26(spark, sf):
    d = daily(spark, sf)
    allowed = T.gated_report(R.deals(spark, sf), d).filter("size(array_remove(missing, 'gates')) = 0")
    return M.forecast_table(days(spark, sf), d, allowed, sims=500, outer=30, inner=100)


@register("h27_forecast_blockers", "report_id:i blockers:s")
def h27(spark, sf):
    g = T.gated_report(R.deals(spark, sf), daily(spark, sf))
    k = F.col("report_id")
    params = g.select("report_id", (k % 3 == 1).cast("int").alias("different"),
                      (k % 3 == 2).cast("int").alias("missing_params"))
    rep = g.select("report_id", F.when(k == 3, "is").alias("repeated"))
    other = g.select("report_id", (k % 2).alias("other_tries"))
    return T.forecast_blockers(g, params, rep, other).withColumn(
        "blockers", F.concat_ws(",", "blockers"))


@register("h28_unseen_figures", "report_id:i trades:i net_cents:i source:s", _D + ", " + _seg + """
 SELECT t.report_id, coalesce(c.trades, t.trades) trades, coalesce(c.net, t.net) net_cents,
  CASE WHEN c.trades IS NULL THEN 'report' ELSE 'after_cut' END source
 FROM (SELECT report_id, count(*) trades, sum(net_cents) net FROM d GROUP BY 1) t
 LEFT JOIN (SELECT report_id, count(*) trades, sum(net_cents) net FROM seg WHERE segment='clean'
  GROUP BY 1) c USING (report_id)""")
def h28(spark, sf):
    d = opened(spark, sf).withColumn("open_commission_cents", F.lit(0))
    tagged, _ = T.split_by_cuts(d, cuts(spark, sf))
    return T.unseen_figures(T.deal_summary(tagged.filter("segment = 'clean'")), T.deal_summary(d))
