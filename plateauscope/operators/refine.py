"""Search ranges for a second, finer sweep around a plateau representative.

Every swept axis of a plateau gets a table of admissible reaches: for each distance from the
centre, the values a tester would generate between the levels that far away. Choosing one
reach per axis under a budget of combinations is then relational. The heaviest axes whose
running product holds the budget start one level wide and the others stand still; going from
the heaviest axis down, each takes the widest reach of its table that the product of all
others leaves room for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import attach

BUDGET = 20000
FINE_REACH = 3
PLATEAU = ["study_id", "component"]
AXIS = [*PLATEAU, "dim"]
_NEAR = 1e-9


def reach_table(axes: DataFrame, levels: DataFrame, budget: int) -> DataFrame:
    """(plateau, dim, reach, lo, hi, gap, seen, cells) for the levels around every centre.

    ``cells`` counts the values from ``lo`` to ``hi`` at the smallest step between levels
    seen. Reaches that could not fit the budget alone are left out.
    """
    along = Window.partitionBy("study_id", "dim").orderBy("pos")
    lv = levels.select("study_id", "dim", "pos", F.col("num").alias("v"),
                       (F.col("num") - F.lag("num").over(along)).alias("below"),
                       (F.lead("num").over(along) - F.col("num")).alias("above"))
    near = attach(axes.select(*AXIS, F.col("pos").alias("at")), lv, ["study_id", "dim"], "inner",
                  "component")
    rings = near.groupBy(*AXIS, F.abs(F.col("pos") - F.col("at")).alias("reach")).agg(
        F.min("v").alias("v0"), F.max("v").alias("v1"), F.count(F.lit(1)).alias("k"),
        F.min(F.when(F.col("pos") > F.col("at"), F.col("below"))
              .when(F.col("pos") < F.col("at"), F.col("above"))).alias("g"))
    out = Window.partitionBy(*AXIS).orderBy("reach")
    table = rings.select(*AXIS, "reach", F.min("v0").over(out).alias("lo"),
                         F.max("v1").over(out).alias("hi"), F.min("g").over(out).alias("gap"),
                         F.sum("k").over(out).alias("seen"))
    steps = F.floor((F.col("hi") - F.col("lo")) / F.col("gap") + _NEAR) + 1
    table = table.withColumn("cells", F.greatest(F.col("seen"), F.coalesce(steps, F.lit(1))))
    return table.filter((F.col("reach") <= 1) | (F.col("cells") <= budget))


def widest(options: DataFrame, budget: int) -> DataFrame:
    """(plateau, dim, choice): the chosen place in each axis' ``cells``, a rising array.

    ``options``: plateau, dim, weight, cells, start (place where the axis starts). Equal weights
    go by dim.
    """
    order = F.struct((-F.col("weight")).alias("w"), "dim", "cells", "start")
    lists = options.groupBy(*PLATEAU).agg(F.sort_array(F.collect_list(order)).alias("axes"))
    begin = F.aggregate("axes", F.lit(1.0), lambda p, a: p * F.get(a["cells"], a["start"]))
    none = F.array().cast("array<struct<dim:int,choice:int>>")

    def take(state: Column, a: Column) -> Column:
        others = state["p"] / F.get(a["cells"], a["start"])
        place = F.greatest(a["start"], F.size(F.filter(
            a["cells"], lambda c: c * others <= F.lit(float(budget)))) - 1)
        return F.struct((others * F.get(a["cells"], place)).alias("p"), F.concat(
            state["chosen"], F.array(F.struct(a["dim"].alias("dim"), place.alias("choice"))))
            .alias("chosen"))

    done = F.aggregate("axes", F.struct(begin.alias("p"), none.alias("chosen")), take)
    return lists.select(*PLATEAU, F.explode(done["chosen"]).alias("c")).select(
        *PLATEAU, "c.dim", "c.choice")


def _heavy_enough(count: str, budget: int) -> Column:
    """Whether an axis and all heavier ones together hold the budget."""
    heavier = Window.partitionBy(*PLATEAU).orderBy(F.desc("weight"), F.desc("dim")).rowsBetween(
        Window.unboundedPreceding, 0)
    return F.product(F.col(count).cast("double")).over(heavier) <= budget


def _ranges(axes: DataFrame, table: DataFrame, budget: int) -> DataFrame:
    """(plateau, dim, start, stop, step, levels) of the axes at their chosen reach."""
    cells = table.groupBy(*AXIS).agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "reach", F.col("cells").cast("double").alias("c")))), lambda x: x["c"]).alias("cells"))
    options = axes.select(*AXIS, "weight").join(cells, AXIS).withColumn("one", F.get("cells", F.lit(1)))
    options = options.withColumn("start", _heavy_enough("one", budget).cast("int"))
    chosen = widest(options, budget).withColumnRenamed("choice", "reach")
    return chosen.join(table, [*AXIS, "reach"]).select(
        *AXIS, F.col("lo").alias("start"), F.col("hi").alias("stop"),
        F.when(F.col("reach") > 0, F.coalesce("gap", F.lit(0.0))).otherwise(0.0).alias("step"),
        F.col("cells").cast("long").alias("levels"))


def _half_steps(rows: DataFrame, budget: int) -> DataFrame:
    """(plateau, dim, f_start, f_stop, f_step, f_levels, f_fixed) at half the step.

    ``rows``: plateau, dim, weight, center, step > 0, first and last level, whole (all integers).
    """
    half = F.when(F.col("whole"), F.greatest(F.lit(1.0), F.floor(F.col("step") / 2))).otherwise(
        F.round(F.col("step") / 2, 8))
    rows = rows.withColumn("half", half.cast("double"))

    def side(r: Column | int) -> tuple[Column, Column]:
        d = F.lit(r) * F.col("step") if isinstance(r, int) else r * F.col("step")
        return (F.greatest("first", F.round(F.col("center") - d, 8)),
                F.least("last", F.round(F.col("center") + d, 8)))

    def cells(r) -> Column:
        lo, hi = side(r)
        return F.floor((hi - lo) / F.col("half") + _NEAR) + 1

    # A reach is open only while each step outwards adds values.
    n = [cells(r).cast("double") for r in range(1, FINE_REACH + 1)]
    open_to, grows = [F.array(n[0])], F.lit(True)
    for r in range(1, FINE_REACH):
        grows = grows & (n[r] > n[r - 1])
        open_to.append(F.when(grows, F.array(n[r])).otherwise(F.array().cast("array<double>")))
    rows = rows.withColumn("cells", F.concat(*open_to)).withColumn("one", n[0])
    rows = rows.withColumn("moves", _heavy_enough("one", budget))
    moving = rows.filter("moves").withColumn("start", F.lit(0))
    chosen = widest(moving.select(*AXIS, "weight", "cells", "start"), budget)
    rows = rows.join(chosen, AXIS, "left")
    lo, hi = side(F.col("choice") + 1)
    pick = lambda a, b: F.when(F.col("moves"), a).otherwise(b)
    return rows.select(*AXIS, pick(lo, F.col("center")).alias("f_start"),
                       pick(hi, F.col("center")).alias("f_stop"),
                       pick(F.col("half"), F.lit(0.0)).alias("f_step"),
                       pick(F.get("cells", "choice"), F.lit(1)).cast("long").alias("f_levels"),
                       (F.col("moves") & (F.col("half") < F.col("step"))).alias("f_finer"))


def refinement(representatives: DataFrame, cells: DataFrame, levels: DataFrame,
               roles: DataFrame, coverage: DataFrame, budget: int = BUDGET,
               finer: bool | None = None) -> DataFrame:
    """One row per plateau and parameter; half steps where the grid was tried in full."""
    levels = levels.groupBy("study_id", "dim", "name", "type", "pos").agg(
        F.min("num").alias("num"), F.min("txt").alias("txt"))
    reps = representatives.select("study_id", "component", "row_idx").join(
        cells.select("study_id", "row_idx", "coords"), ["study_id", "row_idx"])
    at = reps.select(*PLATEAU, F.posexplode("coords").alias("dim", "pos"))
    about = levels.groupBy("study_id", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.min("num").alias("first"), F.max("num").alias("last"),
        F.bool_and(F.col("num") == F.floor("num")).alias("whole"))
    about = about.join(roles.select("study_id", "dim", "role", F.col("marginal").alias("weight")),
                       ["study_id", "dim"])
    rows = (at.join(levels.withColumnRenamed("num", "center").withColumnRenamed("txt", "text"),
                    ["study_id", "dim", "pos"]).join(about, ["study_id", "dim"]))
    number = F.col("type") == "number"
    rows = rows.withColumn("kind", F.when(F.col("n") < 2, "constant").when(number, "range")
                           .otherwise("category"))
    axes = rows.filter(number & (F.col("n") > 1) & (F.col("role") != "flat"))
    found = _ranges(axes, reach_table(axes, levels.filter(number), budget), budget)
    rows = rows.join(found, AXIS, "left")
    still = F.col("kind") == "range"
    rows = (rows.withColumn("start", F.coalesce("start", F.when(still, F.col("center"))))
            .withColumn("stop", F.coalesce("stop", F.when(still, F.col("center"))))
            .withColumn("step", F.coalesce("step", F.lit(0.0)))
            .withColumn("levels", F.coalesce("levels", F.lit(1).cast("long")))
            .withColumn("fixed", F.col("step") == 0))
    fine = F.col("sampling") == "grid" if finer is None else F.lit(finer)
    rows = attach(rows, coverage.select("study_id", fine.alias("_fine")), ["study_id"], "inner",
                  "component")
    half = _half_steps(rows.filter("_fine AND step > 0").select(
        *AXIS, "weight", "center", "step", "first", "last", "whole"), budget)
    rows = rows.join(half, AXIS, "left")
    has = F.col("f_levels").isNotNull()
    new = lambda c: F.when(has, F.col(f"f_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        *PLATEAU, "dim", "name", "kind", F.when(number, F.col("center")).alias("center"), "text",
        new("start"), new("stop"), new("step"), new("levels"),
        F.when(has, F.col("f_levels") == 1).otherwise(F.col("fixed")).alias("fixed"),
        F.coalesce("f_finer", F.lit(False)).alias("finer"))
