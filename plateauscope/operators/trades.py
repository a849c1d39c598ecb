"""Trade-list analytics: costs, matching, daily series, sizing, samples and splits.

``deals``: report_id, seq, ts, day, symbol, volume, price, net_cents, commission_cents,
swap_cents, profit_cents, balance_cents. Money is BIGINT cents until a ratio is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import chi2_survival_even, norm_cdf, norm_inv
from .ordering import attach, quantiles, row_block, running_totals, with_ranks

# Limits and scenarios of the trade audit.
SCENARIOS_BP = (("base", 0.0), ("moderate", 1.0), ("severe", 3.0))
MIN_MOVE = 2e-5
MIN_SAMPLES, MIN_AGREEMENT, AGREEMENT_BAND = 5, 0.6, 0.1
MIN_SIZING_TRADES = MIN_EACH = 10
LOT_UP, MARTINGALE_RATE, MARTINGALE_GAP = 1.05, 0.4, 0.3
MIN_GROWTH, PROPORTIONAL_SLOPE = 1.25, 0.5
MIN_SAMPLE_DAYS = 30
FORECAST_MIN_DAYS, FORECAST_MIN_TRADING_DAYS = 504, 100
GATE_ALPHA, GATE_LAGS = 0.05, 10
REPORT = ["report_id"]


def cost_carry(raw: DataFrame) -> DataFrame:
    """Costs of openings wait for the next close, which takes them over.

    ``raw``: report_id, seq, is_close, commission_cents, swap_cents, profit_cents.
    The island of a close is its running number; islands are summed with map-side
    combine, so a long run of openings never meets in one task.
    """
    r = raw.withColumn("_blk", row_block("seq")).withColumn(
        "_c", F.col("is_close").cast("int").cast("long"))
    r = running_totals(r, REPORT, "_blk", ["seq"], {"closes": "_c"})
    r = r.withColumn("island", F.col("closes") - F.col("_c"))
    opened = lambda c: F.sum(F.when(~F.col("is_close"), F.col(c)).otherwise(0))
    close = lambda c: F.max(F.when(F.col("is_close"), F.col(c)))
    g = r.groupBy("report_id", "island").agg(
        close("seq").alias("seq"), close("profit_cents").alias("profit_cents"),
        close("commission_cents").alias("_cc"), close("swap_cents").alias("_cs"),
        opened("commission_cents").alias("open_commission_cents"),
        opened("swap_cents").alias("_os")).filter("seq IS NOT NULL")
    cost = F.col("commission_cents") + F.col("swap_cents")
    return (g.withColumn("commission_cents", F.col("_cc") + F.col("open_commission_cents"))
            .withColumn("swap_cents", F.col("_cs") + F.col("_os"))
            .select("report_id", "seq", "profit_cents", "commission_cents", "swap_cents",
                    "open_commission_cents", (F.col("profit_cents") + cost).alias("net_cents")))


def split_reversals(fills: DataFrame) -> DataFrame:
    """Replace each reversal by a close of the open position and an opening of the rest.

    A reversal exists only where one position per symbol is held, so the position
    before it is the running signed volume.
    """
    side = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    r = fills.withColumn("_v", side * F.col("volume")).withColumn("_blk", row_block("seq"))
    r = running_totals(r, ["report_id", "symbol"], "_blk", ["seq"], {"_pos": "_v"})
    before = (F.col("_pos") - F.col("_v")) * side
    held = F.when(before < 0, F.least(-before, F.col("volume"))).otherwise(0.0)
    opposite = F.when(F.col("side") == "buy", "sell").otherwise("buy")
    part = lambda kind, queue, vol: F.struct(
        F.lit(kind).alias("kind"), queue.alias("queue"), vol.alias("part_volume"))
    legs = (F.when(F.col("direction") == "in", F.array(part("open", F.col("side"),
                                                            F.col("volume"))))
            .when(F.col("direction") == "out", F.array(part("close", opposite, F.col("volume"))))
            .when(F.col("direction") == "out by", F.array(part("by", opposite, F.col("volume"))))
            .otherwise(F.array(part("close", opposite, held),
                               part("open", F.col("side"), F.col("volume") - held))))
    r = r.select("report_id", "symbol", "seq", "ts", "price", "volume", F.posexplode(legs)
                 .alias("leg", "x")).select("*", "x.*").drop("x")
    return r.filter("part_volume > 1e-12")


def match_fifo(fills: DataFrame, stage=lambda df, label: df) -> DataFrame:
    """First-in first-out matching per report, symbol and side, as an interval join.

    On the axis of volume opened so far, opening i covers an interval, and what is
    still queued after each fill is the running flow reflected at zero. A close
    consumes the next stretch of that axis, so matching is an overlap join. Both
    sides are cut into buckets of the mean volume: a key of the join holds a few
    intervals, whatever the length of the report. ``stage`` keeps what several joins read: a relation
    that is not kept is built again, with its shuffles, for each of them.
    """
    q = ["report_id", "symbol", "queue"]
    legs = stage(split_reversals(fills).select(*q, "seq", "ts", "price", "leg", "kind", "part_volume"), "legs")
    opens = F.col("kind") == "open"
    legs = (legs.withColumn("_blk", row_block("seq"))
            .withColumn("_in", F.when(opens, F.col("part_volume")).otherwise(0.0))
            .withColumn("_flow", F.when(opens, -F.col("part_volume"))
                        .otherwise(F.col("part_volume"))))
    legs = running_totals(legs, q, "_blk", ["seq", "leg"], {"opened": "_in", "net": "_flow"},
                          peak="net")
    # queued after = reflected flow; consumed = opened - queued.
    legs = legs.withColumn("queued", F.round(F.col("net_peak") - F.col("net"), 9))
    legs = legs.withColumn("c1", F.round(F.col("opened") - F.col("queued"), 9))
    legs = stage(legs.drop("_flow", "net", "net_peak", "queued"), "queues")
    width = legs.groupBy(*q).agg(F.avg("part_volume").alias("_w"))
    legs = attach(legs, width, q, "inner", "seq")
    o = legs.filter(opens).select(
        *q, F.col("ts").alias("open_ts"), F.col("price").alias("_op"), "_w",
        F.round(F.col("opened") - F.col("_in"), 9).alias("o0"),
        F.round(F.col("opened"), 9).alias("o1"))
    # A close starts where consumption stood: its own queue before it was served.
    c = legs.filter(~opens)
    c = stage(_with_consumed_before(c, q).select(
        *q, "seq", "leg", "kind", "ts", "price", "part_volume", "c0", "c1", "_w"), "closes")
    cells = lambda a, b: F.explode(F.sequence(
        F.floor(a / F.col("_w")).cast("long"),
        F.greatest(F.floor(a / F.col("_w")), F.ceil(b / F.col("_w")) - 1).cast("long")))
    ob = o.withColumn("_cell", cells(F.col("o0"), F.col("o1"))).drop("_w")
    cb = c.select(*q, "seq", "leg", "kind", "c0", "c1", "_w").filter("c1 > c0 + 1e-12").withColumn(
        "_cell", cells(F.col("c0"), F.col("c1")))
    hit = cb.join(ob, [*q, "_cell"]).withColumn("_cut", F.greatest(
        F.col("c0"), F.col("o0"), F.col("_cell") * F.col("_w"))).withColumn(
        "_end", F.least(F.col("c1"), F.col("o1"), (F.col("_cell") + 1) * F.col("_w")))
    hit = hit.withColumn("take", F.col("_end") - F.col("_cut")).filter("take > 1e-12")
    got = hit.groupBy(*q, "seq", "leg").agg(
        F.sum("take").alias("matched"), F.sum(F.col("take") * F.col("_op")).alias("_cost"),
        F.min_by("open_ts", "o0").alias("open_ts"))
    full = F.abs(F.col("matched") - F.col("part_volume")) <= 1e-9 * F.greatest(
        F.lit(1.0), F.col("part_volume"))
    out = c.join(got, [*q, "seq", "leg"], "left")
    return out.select(
        "report_id", "symbol", "seq", "ts", "price", F.col("part_volume").alias("closed_volume"),
        F.coalesce("matched", F.lit(0.0)).alias("matched"),
        F.when(F.col("kind") != "by", F.col("queue")).alias("position_side"),
        F.when(full & (F.col("kind") != "by"), F.col("_cost") / F.col("matched"))
        .alias("open_price"), "open_ts")


def _with_consumed_before(closes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consumed volume before each close: the consumed total of the close before it.

    Consumption never falls, so the value carried over a block border is the
    maximum of the earlier blocks.
    """
    inner = Window.partitionBy(*keys, "_blk").orderBy("seq", "leg")
    last = closes.groupBy(*keys, "_blk").agg(F.max("c1").alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    head = last.select(*keys, "_blk", F.coalesce(F.max("_m").over(w), F.lit(0.0)).alias("_h"))
    return closes.join(head, [*keys, "_blk"]).withColumn(
        "c0", F.coalesce(F.lag("c1").over(inner), F.col("_h"))).drop("_h")


def _with_calendar(days: DataFrame) -> DataFrame:
    """Fill weekdays without closes between a report's first and last day."""
    span = days.groupBy(*REPORT).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    cal = span.select(*REPORT, F.explode(F.sequence("_a", "_b")).alias("day"))
    full = cal.join(days, [*REPORT, "day"], "left")
    full = full.filter(F.col("trades").isNotNull() | ~F.dayofweek("day").isin(1, 7))
    return full


def daily_series(deals: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Daily sums with weekday fill: report_id, day, day_idx, pnl, volume, trades, notional.

    Deals are summed per symbol and day where they are read; what follows sees days only. A report with
    an unreadable date has no rows: the series is all or nothing.
    """
    keys = [*REPORT, "day"]
    sums = lambda by, *more: deals.groupBy(*by).agg(
        F.sum("net_cents").alias("pnl_cents"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("trades"), *more)
    if contracts is None:
        days = sums(keys).withColumn("notional", F.lit(None).cast("double")).withColumn(
            "_unknown", F.col("trades"))
    else:
        traded = F.col("price") * F.col("volume")
        d = sums([*keys, "symbol"], F.sum(traded).alias("_traded"), F.count_if(traded.isNull()).alias("_open"))
        d = d.join(contracts.select(*REPORT, "symbol", "value_per_unit"), [*REPORT, "symbol"], "left")
        value = F.col("value_per_unit")
        days = d.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("pnl_cents", "volume", "trades")],
            F.sum(F.col("_traded") * value).alias("notional"),
            F.sum(F.when(value.isNull(), F.col("trades")).otherwise(F.col("_open"))).alias("_unknown"))
    days = days.join(days.filter("day IS NULL").select(*REPORT), REPORT, "left_anti")
    known = days.groupBy(*REPORT).agg((F.sum("_unknown") == 0).alias("_known"))
    full = _with_calendar(days).join(known, REPORT)
    w = Window.partitionBy(*REPORT).orderBy("day")  # a calendar: a few thousand rows
    return full.select(
        *REPORT, "day", (F.row_number().over(w) - 1).alias("day_idx"),
        F.coalesce("pnl_cents", F.lit(0)).alias("pnl_cents"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("trades", F.lit(0)).alias("trades"),
        F.when(F.col("_known"), F.coalesce("notional", F.lit(0.0))).alias("notional"))


def day_trades(deals: DataFrame, log: bool = False, daily: DataFrame | None = None) -> DataFrame:
    """Ordered increments per day (money in cents, or log return on the balance before).

    ``daily`` is the series of the same deals where it is at hand. Reports that are left out are taken
    from the series, so that deals meet a few days only and are not moved for it.
    """
    idx = (daily_series(deals) if daily is None else daily).select(*REPORT, "day", "day_idx")
    if log:
        before = F.col("balance_cents") - F.col("net_cents")
        ok = (before > 0) & (1 + F.col("net_cents") / before > 0)
        bad = deals.filter(~F.coalesce(ok, F.lit(False))).select(*REPORT).distinct()
        idx = idx.join(bad, REPORT, "left_anti")
        inc = F.log1p(F.col("net_cents") / before)
    else:
        inc = F.col("net_cents").cast("double")
    return deals.join(idx, [*REPORT, "day"]).select(*REPORT, "day_idx", "seq", inc.alias("inc"))


def contract_values(closes: DataFrame) -> DataFrame:
    """Money per unit of price and volume, per report and symbol, from priced closes."""
    move = (F.col("price") - F.col("open_price")) * F.when(
        F.col("position_side") == "buy", 1.0).otherwise(-1.0)
    c = closes.withColumn("_move", move).filter(
        F.col("position_side").isNotNull() & (F.col("closed_volume") > 0)
        & (F.col("profit") != 0) & (F.abs("_move") >= MIN_MOVE * F.col("price")))
    c = c.withColumn("value", F.col("profit") / (F.col("_move") * F.col("closed_volume")))
    c = c.filter("value > 0")
    keys = [*REPORT, "symbol"]
    med = quantiles(c, keys, "value", {"value_per_unit": 0.5}, count="samples")
    price = quantiles(c, keys, "price", {"median_price": 0.5})
    near = attach(c, med, keys, "inner").groupBy(*keys).agg(
        F.avg((F.abs(F.col("value") / F.col("value_per_unit") - 1) <= AGREEMENT_BAND)
              .cast("int")).alias("agreement"), F.max("digits").alias("digits"))
    return med.join(near, keys).join(price, keys).filter(
        (F.col("samples") >= MIN_SAMPLES) & (F.col("agreement") >= MIN_AGREEMENT)).select(
        *keys, "value_per_unit", "median_price", F.pow(F.lit(10.0), -F.col("digits"))
        .alias("point"), "samples", "agreement")


def equity_path(daily: DataFrame, value: str = "pnl_cents",
                keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """Running equity and fall from the peak (which starts at zero) of a daily series."""
    keys = list(keys)
    w = (Window.partitionBy(*keys).orderBy("day_idx")
         .rowsBetween(Window.unboundedPreceding, 0))
    d = daily.withColumn("equity", F.sum(value).over(w))
    return d.withColumn("fall", F.greatest(F.lit(0), F.max("equity").over(w)) - F.col("equity"))


def sharpe_and_drawdown(daily: DataFrame) -> DataFrame:
    e = equity_path(daily)
    return e.groupBy(*REPORT).agg(
        F.count(F.lit(1)).alias("days"), F.max("fall").alias("max_drawdown_cents"),
        F.sum("pnl_cents").alias("net_cents"),
        (F.avg("pnl_cents") / F.nullif(F.stddev_samp("pnl_cents"), F.lit(0.0))).alias("sharpe"))


def cost_stress(daily: DataFrame, bp: Column | float = 0.0, per_lot: float = 0.0,
                per_side: float = 0.0, per_trade: float = 0.0,
                keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """Net, cost and drawdown after extra costs (money in cents)."""
    keys = list(keys)
    bp = bp if isinstance(bp, Column) else F.lit(float(bp))
    cost = (bp * 1e-4 * F.coalesce("notional", F.lit(0.0)) * 100 + per_lot * 100 * F.col("volume")
            + (2 * per_side + per_trade) * 100 * F.col("trades"))
    d = daily.withColumn("cost", cost).withColumn(
        "stressed", F.col("pnl_cents").cast("double") - F.col("cost"))
    g = equity_path(d, "stressed", keys).groupBy(*keys).agg(
        F.sum("pnl_cents").alias("net_cents"), F.sum("stressed").alias("stressed_cents"),
        F.sum("cost").alias("cost_cents"), F.max("fall").alias("drawdown_cents"))
    lost = (F.col("net_cents") - F.col("stressed_cents")) / F.nullif(
        F.abs("net_cents").cast("double"), F.lit(0.0))
    return g.select(*keys, "net_cents", "stressed_cents", "cost_cents",
                    lost.alias("degradation"), (F.col("stressed_cents") > 0)
                    .alias("still_profitable"), "drawdown_cents")


def cost_scenarios(daily: DataFrame) -> DataFrame:
    """The stress table at the fixed basis-point scenarios, where a notional is known."""
    live = daily.groupBy(*REPORT).agg(F.max("notional").alias("_n")).filter("_n > 0")
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(b).alias("bp"))
                     for n, b in SCENARIOS_BP])
    d = daily.join(live.select(*REPORT), REPORT, "left_semi").withColumn(
        "_s", F.explode(rows)).select("*", "_s.*").drop("_s")
    return cost_stress(d, F.col("bp"), keys=(*REPORT, "scenario", "bp"))


def break_even(daily: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Extra cost that would erase the result: per trade, lot, basis point and point."""
    g = daily.groupBy(*REPORT).agg(
        (F.sum("pnl_cents") / 100).alias("net"), F.sum("trades").alias("trades"),
        F.sum("volume").alias("volume"), F.sum("notional").alias("notional")).filter("trades > 0")
    g = g.withColumn("per_trade", F.col("net") / F.col("trades")).withColumn(
        "per_lot", F.when(F.col("volume") > 0, F.col("net") / F.col("volume"))).withColumn(
        "bp", F.when(F.col("notional") > 0, F.col("net") / F.col("notional") * 1e4))
    if contracts is None:
        return g
    one = contracts.groupBy(*REPORT).agg(
        F.count(F.lit(1)).alias("_k"), F.max("value_per_unit").alias("_v"),
        F.max("point").alias("_p"), F.max("median_price").alias("_m"))
    g = g.join(one, REPORT, "left")
    single = (F.col("_k") == 1) & (F.col("_p") > 0) & (F.col("_v") > 0)
    return (g.withColumn("points", F.when(single, F.col("per_lot") / (F.col("_v") * F.col("_p"))))
            .withColumn("point_of_one_bp", F.when(single, 1e-4 * F.col("_m") / F.col("_p")))
            .drop("_k", "_v", "_p", "_m"))


def next_in_order(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """The values of the following row, found inside row blocks and across their borders."""
    keys = list(keys)
    df = df.withColumn("_blk", row_block(order))
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    heads = df.groupBy(*keys, "_blk").agg(*[F.min_by(c, order).alias(f"_h_{c}") for c in cols])
    b = Window.partitionBy(*keys).orderBy("_blk")
    heads = heads.select(*keys, "_blk", *[F.lead(f"_h_{c}").over(b).alias(f"_n_{c}") for c in cols])
    df = df.join(heads, [*keys, "_blk"])
    out = df.select("*", *[F.coalesce(F.lead(c).over(w), F.col(f"_n_{c}")).alias(f"next_{c}")
                           for c in cols])
    return out.drop("_blk", *[f"_n_{c}" for c in cols])


def detect_sizing(deals: DataFrame) -> DataFrame:
    """Position sizing per report: fixed, martingale or proportional, with the evidence."""
    d = deals.filter("volume > 0 AND net_cents IS NOT NULL").withColumn(
        "before", (F.col("balance_cents") - F.col("net_cents")).cast("double"))
    d = next_in_order(d, REPORT, "seq", ["volume"])
    up = F.col("next_volume") > F.col("volume") * LOT_UP
    has = F.col("next_volume").isNotNull()
    lb, lv = F.ln(F.when(F.col("before") > 0, F.col("before"))), F.ln("volume")
    g = d.groupBy(*REPORT).agg(
        F.count(F.lit(1)).alias("trades"), F.min("volume").alias("lo"), F.max("volume").alias("hi"),
        F.count_if(has & (F.col("net_cents") < 0)).alias("after_loss"),
        F.count_if(has & (F.col("net_cents") > 0)).alias("after_win"),
        F.count_if(has & (F.col("net_cents") < 0) & up).alias("_ul"),
        F.count_if(has & (F.col("net_cents") > 0) & up).alias("_uw"),
        F.min("before").alias("_b0"), F.max("before").alias("_b1"),
        F.regr_slope(lv, lb).alias("slope"))
    g = g.withColumn("up_after_loss", F.coalesce(F.try_divide("_ul", "after_loss"), F.lit(0.0)))
    g = g.withColumn("up_after_win", F.coalesce(F.try_divide("_uw", "after_win"), F.lit(0.0)))
    growth = F.col("_b1") / F.col("_b0")
    martingale = ((F.col("after_loss") >= MIN_EACH) & (F.col("after_win") >= MIN_EACH)
                  & (F.col("up_after_loss") >= MARTINGALE_RATE)
                  & (F.col("up_after_loss") - F.col("up_after_win") >= MARTINGALE_GAP))
    signal = (F.when(F.col("trades") < MIN_SIZING_TRADES, "few_trades")
              .when(F.col("hi") <= F.col("lo") * (1 + 1e-9), "constant_lot")
              .when(martingale, "raises_after_loss")
              .when(~(F.col("_b0") > 0) | F.col("_b0").isNull(), "no_balance")
              .when(growth < MIN_GROWTH, "stable_balance")
              .when(F.coalesce("slope", F.lit(0.0)) >= PROPORTIONAL_SLOPE, "grows_with_balance")
              .otherwise("does_not_grow"))
    kind = (F.when(signal == "raises_after_loss", "martingale")
            .when(signal == "grows_with_balance", "proportional").otherwise("fixed"))
    return g.select(*REPORT, kind.alias("sizing"), signal.alias("signal"), "trades",
                    "up_after_loss", "up_after_win", growth.alias("growth"), "slope")


def split_by_cuts(deals: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tag each deal with its segment. Returns (deals with segment, per-segment frame).

    ``cuts``: report_id, choose_end DATE, opt_end DATE (may be NULL). Reports whose
    cuts are not usable get no rows; the second frame carries their error.
    """
    span = deals.groupBy(*REPORT).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_if(F.col("day").isNull()).alias("_bad"))
    c = span.join(cuts, REPORT).withColumn("opt_end", F.when(
        F.col("opt_end") != F.col("choose_end"), F.col("opt_end")))
    error = (F.when(F.col("_bad") > 0, "unreadable_dates")
             .when(F.col("choose_end").isNull(), "bad_date")
             .when(F.col("opt_end") > F.col("choose_end"), "order")
             .when(F.col("first_day") > F.col("choose_end"), "no_trades_before")
             .when(F.col("choose_end") >= F.col("last_day"), "no_trades_after"))
    c = c.withColumn("error", error)
    d = attach(deals, c.filter("error IS NULL").select(*REPORT, "choose_end", "opt_end",
                                                       "first_day"), REPORT, "inner", "seq")
    seg = (F.when(F.col("day") <= F.col("opt_end"), "opt")
           .when(F.col("day") <= F.col("choose_end"),
                 F.when(F.col("opt_end").isNotNull(), "fwd").otherwise("used"))
           .otherwise("clean"))
    start = (F.when(seg == "clean", F.date_add("choose_end", 1))
             .when(seg == "fwd", F.date_add("opt_end", 1)).otherwise(F.col("first_day")))
    d = d.withColumn("segment", seg).withColumn("_from", start)
    open_day = F.to_date("open_ts") if "open_ts" in deals.columns else F.lit(None).cast("date")
    d = d.withColumn("straddles", F.coalesce(open_day < F.col("_from"), F.lit(False)))
    per = d.groupBy(*REPORT, "segment").agg(
        F.min("_from").alias("from_day"), F.max("day").alias("last_close"),
        F.count(F.lit(1)).alias("trades"), F.count_if("straddles").alias("straddling"))
    failed = c.filter("error IS NOT NULL").select(*REPORT, F.lit(None).cast("string").alias(
        "segment"), F.lit(None).cast("date").alias("from_day"), F.lit(None).cast("date")
        .alias("last_close"), F.lit(0).cast("long").alias("trades"),
        F.lit(0).cast("long").alias("straddling"), "error")
    per = per.withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    return d.drop("_from", "choose_end", "opt_end", "first_day"), per


def deal_summary(deals: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """Trades, net profit and profit factor by transaction (opening cost on its own)."""
    opened = F.coalesce("open_commission_cents", F.lit(0))
    close = (F.coalesce("profit_cents", F.lit(0)) + F.coalesce("swap_cents", F.lit(0))
             + F.coalesce("commission_cents", F.lit(0)) - opened)
    pos = lambda x: F.greatest(x, F.lit(0))
    g = deals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_cents").alias("net_cents"),
        F.sum(pos(close) + pos(opened)).alias("_won"),
        F.sum(pos(-close) + pos(-opened)).alias("_lost"))
    return g.select(*keys, "trades", "net_cents", F.when(
        F.col("_lost") > 0, F.col("_won") / F.col("_lost")).alias("profit_factor"))


# --------------------------------------------------------------------------
# Samples and dependence
# --------------------------------------------------------------------------

def power_against_zero(daily: DataFrame, alpha: float = 0.05) -> DataFrame:
    g = daily.groupBy(*REPORT).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pnl_cents").alias("_m"),
        F.stddev_samp("pnl_cents").alias("_s")).filter("n >= 5 AND _s > 0")
    z = F.sqrt("n") * F.abs("_m") / F.col("_s")
    return g.select(*REPORT, "n", norm_cdf(z - F.abs(norm_inv(F.lit(1 - alpha)))).alias("power"),
                    (F.col("_m") / F.col("_s")).alias("sharpe"))


def min_track_length(sharpe: Column, trials: float = 1, power: float = 0.8) -> Column:
    need = norm_inv(F.lit(power)) + F.abs(norm_inv(F.lit(0.95)))
    n = F.least(F.lit(20000), F.greatest(F.lit(30), F.ceil(F.pow(
        need / F.abs(sharpe), F.lit(2.0)))))
    return F.when(F.abs(sharpe) >= 1e-9, F.ceil(n * (1 + F.ln(F.greatest(
        F.lit(1.0), F.lit(float(trials)))))))


def sample_audit(daily: DataFrame, trials: float = 1) -> DataFrame:
    p = power_against_zero(daily).withColumn(
        "min_track", min_track_length(F.col("sharpe"), trials))
    few = F.col("n") < MIN_SAMPLE_DAYS
    low = (F.col("power") < 0.8) | (F.col("n") < F.col("min_track"))
    return p.select(*REPORT, "n", "power", "sharpe", "min_track",
                    F.when(few, "few_days").when(low, "low_power").alias("reason"))


def swap_warnings(deals: DataFrame, avg_trade_days: float = 0.0, mixed_ticks: bool = False,
                  fingerprint_mismatch: bool = False) -> DataFrame:
    g = deals.groupBy(*REPORT).agg(F.sum("swap_cents").alias("swap"), F.sum("net_cents").alias("net"))
    share = F.when(F.abs("net") > 0, F.least(F.lit(1.0), F.abs("swap") / F.abs("net"))).otherwise(
        F.when(F.col("swap") != 0, 1.0).otherwise(0.0))
    g = g.withColumn("swap_share", share)
    heavy = (F.col("swap_share") > 0.15) | (F.lit(avg_trade_days >= 1) & (F.col("swap_share") > 0.05))
    codes = F.filter(F.array(F.when(heavy, "swap_dominance"),
                             F.when(F.lit(mixed_ticks), "mixed_ticks"),
                             F.when(F.lit(fingerprint_mismatch), "data_fingerprint")),
                     lambda x: x.isNotNull())
    return g.select(*REPORT, "swap_share", codes.alias("warnings"))


def unseen_trades_audit(deals: DataFrame, contracts: DataFrame | None = None,
                        trials: float = 1) -> DataFrame:
    """Daily sample, break-even and swap weight of one report in a single row."""
    daily = daily_series(deals, contracts)
    enough = daily.groupBy(*REPORT).agg(F.count(F.lit(1)).alias("days")).filter("days >= 5")
    return (enough.join(sample_audit(daily, trials).drop("n"), REPORT, "left")
            .join(break_even(daily, contracts).drop("volume", "notional"), REPORT, "left")
            .join(swap_warnings(deals), REPORT, "left"))


def lag_products(series: DataFrame, lags: Column, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """Sums over pairs k apart: (keys, k, s, s2) of y_t y_{t-k} and its square.

    ``series``: keys, t, y; ``lags`` is an array of the lags of a row. The pairs come
    from an equi-join on the shifted index; no group of a report is ever gathered.
    """
    keys = list(keys)
    left = series.select(*keys, F.col("y").alias("_a"), "t", F.explode(lags).alias("k"))
    left = left.withColumn("t", F.col("t") - F.col("k")).filter("t >= 0")
    right = series.select(*keys, "t", F.col("y").alias("_b"))
    prod = F.col("_a") * F.col("_b")
    return left.join(right, [*keys, "t"]).groupBy(*keys, "k").agg(
        F.sum(prod).alias("s"), F.sum(prod * prod).alias("s2"))


def centred(daily: DataFrame, value: str = "pnl_cents") -> DataFrame:
    """Daily series minus its mean: report_id, t, y, n."""
    x = daily.select(*REPORT, F.col("day_idx").alias("t"), F.col(value).alias("x"))
    m = x.groupBy(*REPORT).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    return x.join(m, REPORT).select(*REPORT, "t", (F.col("x") - F.col("mean")).alias("y"), "n")


def block_length(daily: DataFrame, value: str = "pnl_cents") -> DataFrame:
    """Automatic block length of the stationary bootstrap (Politis-White, corrected)."""
    y = centred(daily, value)
    n = F.col("n")
    kn = F.greatest(F.lit(5), F.ceil(F.sqrt(F.log10(n))).cast("int"))
    mmax = (F.ceil(F.sqrt(n)) + kn).cast("int")
    acv = lag_products(y, F.sequence(F.lit(0), F.least(mmax + kn, n.cast("int") - 1)))
    sizes = y.groupBy(*REPORT).agg(F.max("n").alias("n"))
    # One short array per report: about sqrt(n) autocovariances.
    g = acv.groupBy(*REPORT).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))),
                                             lambda x: x["s"]).alias("g")).join(sizes, REPORT)
    g = (g.withColumn("g", F.transform("g", lambda s: s / F.col("n")))
         .withColumn("kn", kn).withColumn("mmax", mmax)
         .withColumn("thr", 2 * F.sqrt(F.log10(n) / n))
         .withColumn("bmax", F.ceil(F.least(3 * F.sqrt(n), n / 3))))
    rho = lambda k: F.abs(F.coalesce(F.get("g", k), F.lit(0.0)) / F.get("g", F.lit(0)))
    quiet = F.filter(F.sequence(F.lit(1), F.col("mmax")), lambda m: F.forall(
        F.sequence(F.lit(1), F.col("kn")), lambda k: rho(m + k) < F.col("thr")))
    loud = F.filter(F.sequence(F.lit(1), F.col("mmax")), lambda k: rho(k) >= F.col("thr"))
    g = g.withColumn("mhat", F.coalesce(F.get(quiet, F.lit(0)), F.array_max(loud), F.lit(1)))
    g = g.withColumn("m", F.least(2 * F.col("mhat"), F.col("mmax")))
    flat = lambda k: F.when(k / F.col("m") < 0.5, 1.0).otherwise(2 * (1 - k / F.col("m")))
    total = lambda f: F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda a, k:
                                  a + f(k) * flat(k) * F.coalesce(F.get("g", k), F.lit(0.0)))
    g = g.withColumn("big", total(lambda k: 2.0 * k)).withColumn(
        "d", 2 * F.pow(F.get("g", F.lit(0)) + total(lambda k: F.lit(2.0)), F.lit(2.0)))
    b = F.cbrt(2 * F.col("big") * F.col("big") / F.col("d")) * F.cbrt(n.cast("double"))
    plain = (n < 8) | ~(F.get("g", F.lit(0)) > 0) | ~(F.col("d") > 0) | (F.col("big") == 0)
    return g.select(*REPORT, "n", "mhat", F.when(plain, 1.0).otherwise(
        F.least(F.col("bmax").cast("double"), F.greatest(F.lit(1.0), b))).alias("block"))


def ljung_box(series: DataFrame, lags: int = GATE_LAGS) -> DataFrame:
    """Ljung-Box on a centred series (report_id, t, y, n); an even number of lags."""
    p = lag_products(series, F.sequence(F.lit(0), F.lit(lags)))
    sizes = series.groupBy(*REPORT).agg(F.max("n").alias("n"))
    g0 = p.filter("k = 0").select(*REPORT, F.col("s").alias("g0"))
    q = (p.filter("k > 0").join(g0, REPORT).join(sizes, REPORT)
         .groupBy(*REPORT).agg(F.sum(F.pow(F.col("s") / F.col("g0"), F.lit(2.0))
                                     / (F.col("n") - F.col("k"))).alias("_q"),
                               F.max("n").alias("n"), F.max("g0").alias("g0")))
    stat = F.when(F.col("g0") > 0, F.col("_q") * F.col("n") * (F.col("n") + 2)).otherwise(0.0)
    return q.filter(F.col("n") >= lags + 2).select(
        *REPORT, stat.alias("q"), chi2_survival_even(stat, lags).alias("p"))


def robust_portmanteau(series: DataFrame, lags: int = GATE_LAGS) -> DataFrame:
    """Lag statistic that stays valid under changing variance."""
    p = lag_products(series, F.sequence(F.lit(1), F.lit(lags))).filter("s2 > 0")
    q = p.groupBy(*REPORT).agg(F.sum(F.col("s") * F.col("s") / F.col("s2")).alias("q"))
    return q.select(*REPORT, "q", chi2_survival_even(F.col("q"), lags).alias("p"))


def volatility_clustering(daily: DataFrame, kind: str = "squares",
                          lags: int = GATE_LAGS) -> DataFrame:
    """Ljung-Box on squares, absolute values or ranks of the distance to the median."""
    if kind == "rank":
        med = quantiles(daily, REPORT, "pnl_cents", {"_m": 0.5})
        x = daily.join(med, REPORT).withColumn("_x", F.abs(F.col("pnl_cents") - F.col("_m")))
        x = with_ranks(x, REPORT, "_x", "day_idx", "_v").withColumn(
            "_x", F.col("_v_below") + (F.col("_v_ties") + 1) / 2)
    else:
        c = centred(daily)
        size = F.col("y") * F.col("y") if kind == "squares" else F.abs("y")
        x = c.select(*REPORT, F.col("t").alias("day_idx"), size.alias("_x"))
    return ljung_box(centred(x, "_x"), lags)


def gated_report(deals: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Sizing, dependence gates and whether a forecast is allowed, per report."""
    daily = daily if daily is not None else daily_series(deals)
    c = centred(daily)
    streaks = robust_portmanteau(c).select(*REPORT, F.col("p").alias("streak_p"))
    vol = volatility_clustering(daily).select(*REPORT, F.col("p").alias("volatility_p"))
    n = daily.groupBy(*REPORT).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("trades") > 0).alias("trading_days"),
        F.sum("trades").alias("trades"), F.min("day").alias("from_day"), F.max("day").alias("to_day"))
    s = detect_sizing(deals).select(*REPORT, "sizing", "signal")
    g = n.join(s, REPORT).join(streaks, REPORT, "left").join(vol, REPORT, "left")
    ok = F.coalesce((F.col("streak_p") >= GATE_ALPHA) & (F.col("volatility_p") >= GATE_ALPHA),
                    F.lit(False))
    missing = F.filter(F.array(
        F.when(F.col("sizing") == "martingale", "martingale"),
        F.when(F.col("days") < FORECAST_MIN_DAYS, "days"),
        F.when(F.col("trading_days") < FORECAST_MIN_TRADING_DAYS, "trading_days"),
        F.when(~ok, "gates")), lambda x: x.isNotNull())
    return g.select(*REPORT, "sizing", "signal", F.when(F.col("sizing") == "proportional", "log")
                    .otherwise("money").alias("mode"), "days", "trading_days", "trades",
                    "from_day", "to_day", "streak_p", "volatility_p", ok.alias("gates_ok"),
                    missing.alias("missing"), (F.size(missing) == 0).alias("forecast_ok"))


def compare_parameters(report: DataFrame, config: DataFrame) -> DataFrame:
    """Status of every configured parameter in the report: same, different or missing.

    Both frames: study_id, name, text.
    """
    from ..functions.parsing import to_number
    clean = lambda c: F.lower(F.trim(c))
    j = config.select("study_id", "name", clean(F.col("text")).alias("expected")).join(
        report.select("study_id", "name", clean(F.col("text")).alias("found")),
        ["study_id", "name"], "left")
    a, b = to_number(F.col("found")), to_number(F.col("expected"))
    equal = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-9 * F.greatest(
        F.lit(1.0), F.abs(a))).otherwise(F.col("found") == F.col("expected"))
    return j.withColumn("status", F.when(F.col("found").isNull(), "missing").when(
        equal, "same").otherwise("different"))


def parameter_match(compared: DataFrame) -> DataFrame:
    pick = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = compared.groupBy("study_id").agg(pick("same"), pick("different"), pick("missing"))
    return g.withColumn("matches", (F.col("different") == 0) & (F.col("missing") == 0))


def forecast_blockers(report: DataFrame, params: DataFrame, repeated: DataFrame,
                      overlaps: DataFrame) -> DataFrame:
    """Reasons not to offer a forecast, per report (all frames keyed by report_id)."""
    j = (report.join(params, REPORT, "left").join(repeated, REPORT, "left")
         .join(overlaps, REPORT, "left"))
    reasons = F.filter(F.array(
        F.when(F.col("different") > 0, "other_configuration"),
        F.when((F.col("different") == 0) & (F.col("missing_params") > 0), "parameters_missing"),
        F.when(F.col("repeated").isNotNull(), "repeated_period"),
        F.when(F.coalesce("other_tries", F.lit(0)) > 0, "compared_before"),
        F.when(~F.col("forecast_ok"), "data")), lambda x: x.isNotNull())
    return j.select(*REPORT, reasons.alias("blockers"))


def unseen_figures(clean_summary: DataFrame, report_metrics: DataFrame) -> DataFrame:
    """Figures of the unseen period: the clean segment after a cut, else the report's own."""
    return report_metrics.alias("r").join(clean_summary.alias("c"), REPORT, "left").select(
        *REPORT, F.coalesce("c.trades", "r.trades").alias("trades"),
        F.coalesce("c.net_cents", "r.net_cents").alias("net_cents"),
        F.coalesce("c.profit_factor", "r.profit_factor").alias("profit_factor"),
        F.when(F.col("c.trades").isNotNull(), "after_cut").otherwise("report").alias("source"))
