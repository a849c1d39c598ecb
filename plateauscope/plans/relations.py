"""Audit relations derived from the star-schema tables.

``sweep_metrics`` turns ``lineitem`` into a parameter sweep: discount, tax and
quantity band are the parameters of a pass, each line is one trade, and lines
shipped before 2000 are the optimised period. Six studies share the grid:

* ``bump``     a planted plateau around (5, 4, 2)
* ``noise``    no planted edge
* ``loser``    a cost so high that nothing can pass
* ``flip``     an edge on the first parameter that moves away in the forward
* ``solo``     ``bump`` without a forward period
* ``partial``  ``bump`` with a forward for a part of the passes only
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_falls
from .stages import memo, stage

METRICS = ("profit", "profit_factor", "recovery_factor", "sharpe", "drawdown", "trades",
           "expected_payoff")
PARAMS = ("p0", "p1", "p2")
SPLIT = "2000-01-01"
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px")
TASK_ROWS = 100_000  # rows of lineitem that a task puts in order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.round(F.col("l_discount") * 100).cast("int").alias("p0"),
        F.round(F.col("l_tax") * 100).cast("int").alias("p1"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("p2"),
        F.when(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp"), "is").otherwise("oos")
        .alias("period"),
        F.to_date("l_shipdate").alias("day"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        F.year("l_shipdate").alias("year"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("px"))


def _period_metrics(lines: DataFrame, keys: list[str], studies: dict[str, Column], rows: int) -> DataFrame:
    """Metrics per (keys, series, p0, p1, p2, period) of ``studies``: series and its money in cents.

    What has no order is combined where the rows are read; the rows travel once for the falls of all
    studies. The money of a study is ``px`` and a constant of the group, so ``px`` orders them all.
    """
    group = [*keys, *PARAMS, "period"]
    lines = lines.dropna(subset=[*group, "day"])
    capital = capital_of(rows)
    series = [*group, "series"]
    t = lines.select(*group, F.explode(F.array(*[F.struct(
        F.lit(n).alias("series"), pnl.alias("pnl")) for n, pnl in studies.items()])).alias("v"))
    sums = t.select(*group, "v.*").groupBy(*series).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("pnl").alias("cents"),
        F.sum(F.greatest("pnl", F.lit(0))).alias("won"),
        F.sum(F.least("pnl", F.lit(0))).alias("lost"),
        F.avg("pnl").alias("mean"),
        F.stddev_samp("pnl").alias("sd"))
    falls = running_falls(lines.select(*group, "day", *ORDER), group, "day", ORDER, studies, capital,
                          max(1, rows // TASK_ROWS))
    return sums.join(falls, series).select(
        *series,
        (F.col("cents") / 100).alias("profit"),
        F.coalesce(F.try_divide(F.col("won").cast("double"), -F.col("lost")), F.lit(99.0))
        .alias("profit_factor"),
        F.coalesce(F.try_divide(F.col("cents").cast("double"), F.col("fall")), F.lit(99.0))
        .alias("recovery_factor"),
        (F.try_divide(F.col("mean"), F.nullif("sd", F.lit(0.0))) * F.sqrt("trades"))
        .alias("sharpe"),
        "drawdown",
        F.col("trades").cast("double").alias("trades"),
        (F.col("mean") / 100).alias("expected_payoff"))


def _studies() -> dict[str, Column]:
    ridge = F.greatest(F.lit(0), 6 - F.abs(F.col("p0") - 5) - F.abs(F.col("p1") - 4)
                       - F.abs(F.col("p2") - 2)).cast("long")
    moving = F.greatest(F.lit(0), 6 - F.abs(F.col("p0") - F.when(
        F.col("period") == "is", 3).otherwise(9))).cast("long")
    return {"bump": F.col("px") - 6000000 + 500000 * ridge, "noise": F.col("px") - 6000000,
            "flip": F.col("px") - 6000000 + 600000 * moving, "loser": F.col("px") - 9000000}


def capital_of(rows: int) -> int:
    """Starting capital in cents: grows like the drawdown of a longer sample."""
    return int(round(800000 * rows ** 0.5))


def _row_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "lineitem").count()  # answered from Parquet footers


def sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study_id, p0, p1, p2, period, seven metrics), one row per pass and period."""
    def build():
        base = _period_metrics(_lines(spark, sf_dir), [], _studies(), _row_count(spark, sf_dir))
        base = stage(base.withColumnRenamed("series", "study_id"), "sweep_base")
        bump = base.filter("study_id = 'bump'")
        solo = bump.filter("period = 'is'").withColumn("study_id", F.lit("solo"))
        part = (bump.filter("period = 'is' OR (p0 + p1 + p2) % 3 <> 0")
                .withColumn("study_id", F.lit("partial")))
        return base.unionByName(solo).unionByName(part)
    return memo(spark, (sf_dir, "sweep_metrics"), build)


def as_passes(metrics: DataFrame) -> DataFrame:
    """Pivot period rows to one row per pass, in the layout of the audit."""
    m = F.struct(*METRICS)
    per = metrics.groupBy("study_id", *PARAMS).agg(
        F.max(F.when(F.col("period") == "is", m)).alias("is"),
        F.max(F.when(F.col("period") == "oos", m)).alias("oos"))
    param = lambda p: F.struct(
        F.lit(p).alias("name"), F.lit("number").alias("kind"),
        F.col(p).cast("double").alias("num"), F.col(p).cast("string").alias("txt"))
    return per.filter(F.col("is").isNotNull()).select(
        "study_id",
        (F.col("p0") * 45 + F.col("p1") * 5 + F.col("p2")).cast("long").alias("row_idx"),
        (F.col("p0") * 45 + F.col("p1") * 5 + F.col("p2") + 1).cast("string").alias("pass_id"),
        F.array(*[param(p) for p in PARAMS]).alias("params"),
        "is", "oos",
        F.col("is.profit").alias("criterion_is"), F.col("oos.profit").alias("criterion_oos"),
        F.col("oos").isNotNull().alias("oos_known"),
        F.lit(False).alias("lost_in_is"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, (sf_dir, "passes"), lambda: as_passes(sweep_metrics(spark, sf_dir)))


def min_trades(spark: SparkSession, sf_dir: str) -> float:
    return float(max(4, _row_count(spark, sf_dir) // 1500))


def sweep_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted sweep cut into one study per ship flag and year."""
    def build():
        t = _lines(spark, sf_dir).withColumn("study_id", F.concat_ws("-", "l_returnflag", "year"))
        # Inside a year the first half is optimised and the second half is the forward.
        t = t.withColumn("period", F.when(F.month("day") <= 6, "is").otherwise("oos"))
        return as_passes(_period_metrics(t, ["study_id"], {"bump": _studies()["bump"]},
                                         _row_count(spark, sf_dir)))
    return memo(spark, (sf_dir, "passes_many"), build)


DEAL_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net_cents")


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades per report without an order, as they are read."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 5).cast("int").alias("report_id"),
        F.col("l_shipdate").alias("ts"), F.to_date("l_shipdate").alias("day"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("volume"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") - 5100000).alias("net_cents"),
        (-F.col("l_linenumber")).cast("long").alias("commission_cents"),
        F.lit(0).cast("long").alias("swap_cents")).dropna(subset=["report_id", "day"])


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades per report (money in cents), ordered by ``seq`` in each report.

    Rows go to their day once, with what they were read from; days are counted where rows are read.
    """
    def build():
        base = closed(spark, sf_dir)
        days = base.groupBy("report_id", "day").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("net_cents").alias("_net"))
        prior = Window.partitionBy("report_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        heads = stage(days.select("report_id", "day", *[
            F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"{c}_0") for c in ("_n", "_net")]), "deal_days")
        tasks = max(1, _row_count(spark, sf_dir) // TASK_ROWS)
        w = Window.partitionBy("report_id", "day").orderBy(*DEAL_ORDER).rowsBetween(
            Window.unboundedPreceding, 0)
        t = base.drop("commission_cents", "swap_cents").repartition(tasks, "report_id", "day")
        t = t.select("*", F.row_number().over(w).alias("_in"), F.sum("net_cents").over(w).alias("_cum"))
        return t.join(heads, ["report_id", "day"]).select(
            "report_id", (F.col("_n_0") + F.col("_in")).alias("seq"), "ts", "symbol", "volume", "price",
            "net_cents", (-F.col("l_linenumber")).cast("long").alias("commission_cents"),
            (F.lit(1000000000).cast("long") + F.col("_net_0") + F.col("_cum"))
            .alias("balance_cents"))
    kept = memo(spark, (sf_dir, "deals"), build)
    swap = F.lit(0).cast("long")
    return kept.select(
        "report_id", "seq", "ts", F.to_date("ts").alias("day"), "symbol", "volume", "price", "net_cents",
        "commission_cents", swap.alias("swap_cents"),
        (F.col("net_cents") - F.col("commission_cents") - swap).alias("profit_cents"), "balance_cents")


SPARSE_LEVELS = (11, 9, 5, 7, 4, 7, 7, 5, 5, 6)


def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study_id, block, cell, row_idx): distinct points of the lines in a space of ten axes.

    Discount, tax, quantity band, line number, quarter, weekday, year, supplier, part and price
    band; the return flag is the block. ``row_idx`` numbers the points of the whole space. Points travel and
    are kept as that number; those outside the levels of an axis also as they are.
    """
    names, below, digits = [f"z{i}" for i in range(len(SPARSE_LEVELS))], 1, []
    for n in reversed(SPARSE_LEVELS):
        digits.insert(0, F.expr(f"CAST(row_idx div {below} % {n} AS int)"))
        below *= n

    def build():
        li = table(spark, sf_dir, "lineitem")
        day = F.to_date("l_shipdate")
        axes = [F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100),
                F.floor((F.col("l_quantity") - 1) / 10), F.col("l_linenumber") - 1, F.quarter(day) - 1,
                F.weekday(day), F.pmod(F.year(day), F.lit(7)), F.col("l_suppkey") % 5,
                F.col("l_partkey") % 5, F.least(F.floor(F.col("l_extendedprice") / 20000), F.lit(5))]
        flag = F.position(F.col("l_returnflag"), F.lit("ANR")).alias("flag")
        points = li.select(flag, *[a.cast("int").alias(z) for a, z in zip(axes, names)])
        code, inside = F.col("flag").cast("long"), F.col("flag").isNotNull()
        for z, n in zip(names, SPARSE_LEVELS):
            code = code * n + F.col(z)
            inside = inside & F.col(z).between(0, n - 1)
        odd = F.when(~F.coalesce(inside, F.lit(False)), F.array("flag", *names))
        # A point is a few bytes of a file, so the number of lines sets the tasks that it is read in.
        tasks = max(1, _row_count(spark, sf_dir) // TASK_ROWS)
        return points.select(code.alias("row_idx"), odd.alias("odd")).repartition(
            tasks, "row_idx", "odd").distinct()

    kept = memo(spark, (sf_dir, "sparse_cells"), build)
    flag = F.expr(f"CAST(row_idx div {below} AS int)")
    return kept.select(
        F.lit("lines").alias("study_id"),
        F.when(F.col("odd").isNotNull(), F.slice("odd", 1, 1)).otherwise(F.array(flag)).alias("block"),
        F.when(F.col("odd").isNotNull(), F.slice("odd", 2, len(names))).otherwise(F.array(*digits))
        .alias("cell"), "row_idx")
