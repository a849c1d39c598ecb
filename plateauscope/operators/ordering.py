"""Exact order statistics that never put a whole group in one task.

A study may hold a third of all rows, so no operator here opens a window over a
study. Values are first counted per (key, value, row block) with map-side
combine; a coarse bucket of the value (``order_bucket``) splits the order into
many short windows, and the per-bucket totals (a few thousand per key) give the
offsets. The result is exact for ranks, quantiles and row positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import order_bucket

# Rows of one key and one value that may share a group.
ROW_BLOCK = 1 << 16

LINEAR, FLOOR_N1, FLOOR_N, UPPER_MEDIAN = "linear", "floor_n1", "floor_n", "upper_median"


def row_block(row: str | Column) -> Column:
    col = F.col(row) if isinstance(row, str) else row
    return F.floor(col / ROW_BLOCK).cast("long")


def _with_offsets(counts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``before``/``n`` to rows (keys, v, [more order cols], c)."""
    counts = counts.withColumn("_b", order_bucket(F.col("v")))
    per_bucket = counts.groupBy(*keys, "_b").agg(F.sum("c").alias("_bc"))
    w = Window.partitionBy(*keys).orderBy("_b")
    per_bucket = per_bucket.select(
        *keys, "_b",
        (F.sum("_bc").over(w) - F.col("_bc")).alias("_off"),
        F.sum("_bc").over(Window.partitionBy(*keys)).alias("n"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    counts = counts.withColumn("_in", F.sum("c").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    if list(order) != ["v"]:
        by_value = Window.partitionBy(*keys, "_b").orderBy("v")
        counts = counts.withColumn("_upto", F.sum("c").over(by_value))
        counts = counts.withColumn("ties", F.sum("c").over(
            Window.partitionBy(*keys, "_b", "v")))
    joined = counts.join(per_bucket, [*keys, "_b"])
    cols = [*keys, *order, "c", "n", (F.col("_off") + F.col("_in")).alias("before")]
    if list(order) != ["v"]:
        cols += ["ties", (F.col("_off") + F.col("_upto") - F.col("ties")).alias("below")]
    return joined.select(*cols)


def value_counts(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """Distinct values per key with their count ``c``, rows below and total ``n``."""
    v = F.col(value) if isinstance(value, str) else value
    counts = (df.select(*keys, v.cast("double").alias("v")).filter("v IS NOT NULL")
              .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))
    return _with_offsets(counts, keys, ["v"])


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
              probs: dict[str, float], convention: str = LINEAR,
              count: str | None = None) -> DataFrame:
    """Exact quantiles per key: one row per key, one column per entry of ``probs``."""
    placed = value_counts(df, keys, value)
    aggs = []
    for name, q in probs.items():
        if convention == LINEAR:
            pos = (F.col("n") - 1) * F.lit(float(q))
        elif convention == FLOOR_N1:
            pos = F.floor((F.col("n") - 1) * F.lit(float(q)))
        elif convention == FLOOR_N:
            pos = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(q))))
        else:
            pos = F.floor(F.col("n") / 2)
        lo, hi = F.floor(pos), F.ceil(pos)
        holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("c"))
        aggs += [F.max(F.when(holds(lo), F.col("v"))).alias(f"_lo_{name}"),
                 F.max(F.when(holds(hi), F.col("v"))).alias(f"_hi_{name}"),
                 F.max(pos - lo).alias(f"_f_{name}")]
    aggs.append(F.max("n").alias("_n"))
    wide = placed.groupBy(*keys).agg(*aggs)
    out = [*keys]
    for name in probs:
        lo, hi, f = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        out.append((lo + (hi - lo) * f).alias(name))
    if count:
        out.append(F.col("_n").alias(count))
    return wide.select(*out)


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, str | Column],
            q: float = 0.5) -> DataFrame:
    """One quantile of several columns per key, in a single pass.

    The columns are stacked with their index as an extra key, so one shuffle
    serves them all; every key of ``df`` is kept, even with no value at all.
    """
    items = list(values.items())
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"),
                 (F.col(c) if isinstance(c, str) else c).cast("double").alias("x"))
        for i, (_, c) in enumerate(items)])).alias("_e")).select(*keys, "_e.k", "_e.x")
    per = quantiles(stacked, [*keys, "k"], "x", {"m": q})
    wide = per.groupBy(*keys).agg(*[
        F.max(F.when(F.col("k") == i, F.col("m"))).alias(name)
        for i, (name, _) in enumerate(items)])
    return df.select(*keys).distinct().join(wide, list(keys), "left")


def mad(df: DataFrame, keys: Sequence[str], value: str, out: str = "mad") -> DataFrame:
    """Scaled median absolute deviation per key; 0 with fewer than two values."""
    centre = quantiles(df, keys, value, {"_med": 0.5}, count="_n")
    dev = (df.select(*keys, F.col(value).alias("_x")).filter("_x IS NOT NULL")
           .transform(lambda d: attach(d, centre, keys))
           .select(*keys, "_n", F.abs(F.col("_x") - F.col("_med")).alias("_d")))
    spread = quantiles(dev, keys, "_d", {"_mad": 0.5}, count="_m")
    return spread.select(*keys, F.when(F.col("_m") >= 2, 1.4826 * F.col("_mad"))
                         .otherwise(0.0).alias(out))


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, row: str,
               prefix: str = "_r", position: bool = False) -> DataFrame:
    """Add exact rank information of ``value`` inside ``keys`` to every row.

    Adds ``{prefix}_n`` (rows with a value), ``{prefix}_below`` (strictly
    smaller) and ``{prefix}_ties`` (equal, itself included); with ``position``
    also ``{prefix}_pos``, the 0-based place with ties broken by ``row``.
    Rows join back on (key, value, row block), so a value shared by a third of
    the rows is still spread over many tasks.
    """
    keys = list(keys)
    df = df.withColumn("v", F.col(value).cast("double")).withColumn("_blk", row_block(row))
    counts = (df.filter("v IS NOT NULL").groupBy(*keys, "v", "_blk")
              .agg(F.count(F.lit(1)).alias("c")))
    placed = _with_offsets(counts, keys, ["v", "_blk"])
    placed = placed.select(*keys, "v", "_blk", F.col("n").alias(f"{prefix}_n"),
                           F.col("below").alias(f"{prefix}_below"),
                           F.col("ties").alias(f"{prefix}_ties"),
                           F.col("before").alias("_start"))
    out = df.join(placed, [*keys, "v", "_blk"], "left")
    if position:
        w = Window.partitionBy(*keys, "v", "_blk").orderBy(row)
        out = out.withColumn(f"{prefix}_pos", F.when(
            F.col("v").isNotNull(), F.col("_start") + F.row_number().over(w) - 1))
    return out.drop("v", "_blk", "_start")


def attach(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left",
           spread: str | Column | None = None) -> DataFrame:
    """Join a one-row-per-key frame back to the rows of its keys.

    The optimiser broadcasts a side whose real size is under its threshold and splits
    the rows of a heavy key over several tasks. Where the session has switched that
    splitting off, the side is sent to the (key, block) groups that exist instead.
    """
    keys = list(keys)
    conf = rows.sparkSession.conf
    if (conf.get("spark.sql.adaptive.enabled", "true") == "true"
            and conf.get("spark.sql.adaptive.skewJoin.enabled", "true") == "true"):
        return rows.join(side, keys, how)
    if spread is None:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(64)).cast("long")
    else:
        salt = row_block(spread)
    rows = rows.withColumn("_salt", salt)
    groups = rows.select(*keys, "_salt").distinct()
    return rows.join(groups.join(side, keys), [*keys, "_salt"], how).drop("_salt")


def running_totals(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
                   values: dict[str, str], peak: str | None = None) -> DataFrame:
    """Running sums of a long ordered series, built block by block.

    ``block`` must not decrease along ``order`` (a day, say). Sums run inside
    each block; block totals run over the few blocks of a key. With ``peak``
    naming one of the outputs, ``{peak}_peak`` is its running maximum with a
    start of zero.
    """
    keys, order = list(keys), list(order)
    w = (Window.partitionBy(*keys, block).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    inner = df
    for out, col in values.items():
        inner = inner.withColumn(f"_{out}_in", F.sum(col).over(w))
    if peak:
        inner = inner.withColumn("_peak_in", F.max(f"_{peak}_in").over(w))
    aggs = [F.sum(col).alias(f"_{out}_t") for out, col in values.items()]
    if peak:
        aggs.append(F.max(f"_{peak}_in").alias("_peak_t"))
    blocks = inner.groupBy(*keys, block).agg(*aggs)
    prior = (Window.partitionBy(*keys).orderBy(block)
             .rowsBetween(Window.unboundedPreceding, -1))
    for out in values:
        blocks = blocks.withColumn(f"_{out}_0", F.coalesce(
            F.sum(f"_{out}_t").over(prior), F.lit(0)))
    if peak:
        blocks = blocks.withColumn("_peak_0", F.greatest(F.lit(0), F.coalesce(F.max(
            F.col(f"_{peak}_0") + F.col("_peak_t")).over(prior), F.lit(0))))
    heads = blocks.select(*keys, block, *[f"_{o}_0" for o in values],
                          *(["_peak_0"] if peak else []))
    out = inner.join(heads, [*keys, block])
    for name in values:
        out = out.withColumn(name, F.col(f"_{name}_0") + F.col(f"_{name}_in"))
    if peak:
        out = out.withColumn(f"{peak}_peak", F.greatest(
            F.col("_peak_0"), F.col(f"_{peak}_0") + F.col("_peak_in")))
    return out.drop(*[f"_{n}{end}" for n in values for end in ("_in", "_0")],
                    *(["_peak_in", "_peak_0"] if peak else []))


def running_falls(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
                  values: dict[str, Column], start: float, partitions: int) -> DataFrame:
    """Greatest falls of running sums from their peak (at least zero): (keys, series, fall, drawdown).

    ``drawdown`` is the greatest fall in percent of ``start`` > 0 plus the peak. Rows travel once, as
    ``df`` has them, for all ``values``, which are computed where they arrive; ``partitions`` is their
    number of tasks. A block becomes its stairs: each height its running sum reached first, with the
    lowest sum before the next one, relative to the beginning of the block. Stairs and what was before the
    block give its exact falls, so nothing but blocks is put in order over a key.
    """
    keys, order = list(keys), list(order)
    w = (Window.partitionBy(*keys, block).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    t = df.repartition(partitions, *keys, block)
    t = t.select(*keys, block, *order, *[v.alias(f"_x_{n}") for n, v in values.items()])
    t = t.select("*", *[F.sum(f"_x_{n}").over(w).alias(f"_s_{n}") for n in values])
    t = t.select("*", *[F.max(f"_s_{n}").over(w).alias(f"_p_{n}") for n in values])
    t = t.select(*keys, block, F.explode(F.array(*[F.struct(
        F.lit(n).alias("series"), F.col(f"_x_{n}").alias("x"), F.col(f"_s_{n}").alias("s"),
        F.col(f"_p_{n}").alias("p")) for n in values])).alias("e")).select(*keys, block, "e.*")
    stairs = t.groupBy(*keys, block, "series", "p").agg(F.min("s").alias("low"), F.sum("x").alias("x"))
    blocks = stairs.groupBy(*keys, block, "series").agg(
        F.sum("x").alias("x"), F.max("p").alias("top"), F.collect_list(F.struct("p", "low")).alias("stairs"))
    before = (Window.partitionBy(*keys, "series").orderBy(block)
              .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_0", F.coalesce(F.sum("x").over(before), F.lit(0)))
    blocks = blocks.withColumn("_peak", F.greatest(F.lit(0), F.max(F.col("_0") + F.col("top")).over(before)))
    at = blocks.select(*keys, "series", "_0", "_peak", F.inline("stairs"))
    peak = F.greatest(F.col("_peak"), F.col("_0") + F.col("p"))
    fall = peak - F.col("_0") - F.col("low")
    return at.groupBy(*keys, "series").agg(
        F.max(fall).alias("fall"), F.max(100 * fall.cast("double") / (peak + start)).alias("drawdown"))
