"""Run history: fingerprints, summaries, retention, comparison and unseen tries.

``runs``: run_id, at, fp (strategy fingerprint), sig (data signature), gates, level,
and whatever else a summary carries. A strategy has at most a few dozen runs kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import row_block

# How much history is kept and the order of the levels.
KEEP_RUNS = 50
KEEP_TRIES = 20
WARN_ATTEMPTS = 3
LEVELS = ("insufficient", "weak", "moderate", "good", "strong")


def strategy_fingerprint(passes: DataFrame) -> DataFrame:
    """Hash of the sorted, lower-cased, distinct parameter names of each study."""
    names = passes.select("study_id", F.explode(F.transform(
        "params", lambda p: F.lower(F.trim(p["name"])))).alias("n")).filter("n <> ''").distinct()
    return names.groupBy("study_id").agg(F.sha2(F.concat_ws(
        "|", F.array_sort(F.collect_set("n"))), 256).alias("fp"))


def data_signature(passes: DataFrame) -> DataFrame:
    """Hash of ids, profits and trades of both periods, in two combining steps.

    Each row is hashed, row blocks are hashed in order, and the block hashes again, so
    a study of any size never gathers in one task.
    """
    text = F.concat_ws(":", "pass_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "is.profit", "is.trades", "oos.profit", "oos.trades")])
    r = passes.select("study_id", "row_idx", F.sha2(text, 256).alias("h"),
                      row_block("row_idx").alias("b"))
    roll = lambda df, keys, at: df.groupBy(*keys).agg(F.sha2(F.concat_ws("", F.transform(
        F.sort_array(F.collect_list(F.struct(at, "h"))), lambda x: x["h"])), 256).alias("h"))
    return roll(roll(r, ["study_id", "b"], "row_idx"), ["study_id"], "b").withColumnRenamed("h", "sig")


def run_summary(studies: DataFrame, plateaus: DataFrame, passes: DataFrame, spans: DataFrame,
                levels: DataFrame, prints: DataFrame, signatures: DataFrame) -> DataFrame:
    """One history row per study: limits, level, pick, its values and spans."""
    best = plateaus.filter("rank = 1").select(
        "study_id", "component", F.col("representative").alias("row_idx"), "size",
        F.round("robust", 1).alias("robust"))
    pick = best.join(passes.select("study_id", "row_idx", "pass_id", F.transform(
        "params", lambda p: F.struct(p["name"].alias("name"), p["num"].alias("num"),
                                     p["txt"].alias("txt"))).alias("values")),
        ["study_id", "row_idx"])
    span = best.select("study_id", "component").join(spans, ["study_id", "component"]).groupBy(
        "study_id").agg(F.sort_array(F.collect_list(F.struct("dim", "name", "lo", "hi", "values")))
                        .alias("span"))
    return (studies.select("study_id", "total", "has_forward", "require_profit",
                           "min_profit_factor", "max_drawdown_pct", "min_trades")
            .join(prints, "study_id").join(signatures, "study_id")
            .join(levels.select("study_id", "level"), "study_id", "left")
            .join(pick.drop("component", "row_idx"), "study_id", "left")
            .join(span, "study_id", "left"))


def retain(runs: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """History after appending in order: a run identical to the one before it replaces it.

    ``runs``: owner, fp, at, sig, gates, unseen. Identical means same strategy, data and
    gates; the unseen result of the replaced run is carried on.
    """
    w = Window.partitionBy("owner", "fp").orderBy("at")
    same = lambda c, side: (side(c).over(w) == F.col(c))
    nxt = F.coalesce(same("sig", F.lead) & same("gates", F.lead), F.lit(False))
    prev = F.coalesce(same("sig", F.lag) & same("gates", F.lag), F.lit(False))
    r = runs.withColumn("_drop", nxt).withColumn("_new", (~prev).cast("int"))
    r = r.withColumn("_g", F.sum("_new").over(w))
    carried = Window.partitionBy("owner", "fp", "_g").orderBy("at")
    r = r.withColumn("unseen", F.last("unseen", ignorenulls=True).over(carried))
    newest = Window.partitionBy("owner").orderBy(F.desc("at"), F.desc("fp"))
    return (r.filter("NOT _drop").withColumn("_k", F.row_number().over(newest))
            .filter(F.col("_k") <= keep).drop("_drop", "_new", "_g", "_k"))


def attempts(runs: DataFrame) -> DataFrame:
    """Place of each run in its strategy, the run before it, and the repeat warning."""
    w = Window.partitionBy("owner", "fp").orderBy("at")
    return runs.select("*", F.row_number().over(w).alias("attempt"),
                       F.lag("at").over(w).alias("previous_at"),
                       (F.row_number().over(w) >= WARN_ATTEMPTS).alias("warn"))


def inside_span(value, lo, hi):
    tol = 1e-9 * F.greatest(F.lit(1.0), F.abs(lo), F.abs(hi))
    return (value >= lo - tol) & (value <= hi + tol)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Each run against the one before it of the same strategy.

    ``runs`` also has: gates, has_forward, level, size, robust, picks MAP<name, value> and
    spans MAP<name, STRUCT<lo, hi>>.
    """
    w = Window.partitionBy("owner", "fp").orderBy("at")
    prev = ["at", "gates", "has_forward", "level", "size", "robust", "spans", "sig"]
    r = runs.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in prev])
    r = r.filter("prev_at IS NOT NULL")
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(c))
    gates_same = F.col("gates").eqNullSafe(F.col("prev_gates"))
    fwd_same = F.col("has_forward").eqNullSafe(F.col("prev_has_forward"))
    checks = F.transform(F.map_entries("picks"), lambda e: F.when(
        F.col("prev_spans")[e["key"]].isNotNull(), inside_span(
            e["value"], F.col("prev_spans")[e["key"]]["lo"], F.col("prev_spans")[e["key"]]["hi"])))
    r = r.withColumn("_c", checks)
    delta = F.when((place("level") > 0) & (place("prev_level") > 0),
                   place("level") - place("prev_level"))
    return r.select(
        "owner", "fp", "at", "prev_at", gates_same.alias("gates_same"),
        fwd_same.alias("forward_same"), (F.col("sig") == F.col("prev_sig")).alias("same_data"),
        (gates_same & fwd_same).alias("levels_comparable"), "prev_level", "level",
        delta.alias("level_delta"),
        F.size(F.filter("_c", lambda x: x)).alias("inside_count"),
        F.size(F.filter("_c", lambda x: x.isNotNull())).alias("known_count"),
        "prev_size", "size", "prev_robust", "robust")


def unseen_tries(tries: DataFrame, keep: int = KEEP_TRIES) -> DataFrame:
    """Upsert by key: the latest figures under the first date, the last twenty kept.

    ``tries``: owner, key, at, n (order of arrival), and the figures of the try.
    """
    cols = [c for c in tries.columns if c not in ("owner", "key", "at", "n")]
    g = tries.groupBy("owner", "key").agg(
        F.min_by("at", "n").alias("at"), F.max("n").alias("n"),
        F.max_by(F.struct(*cols), "n").alias("_f"))
    w = Window.partitionBy("owner").orderBy(F.desc("n"))
    return (g.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep)
            .select("owner", "key", "at", "n", "_f.*"))


def earlier_counted(tries: DataFrame, current: DataFrame) -> DataFrame:
    """Tries that counted before the current key of each owner."""
    j = tries.join(current.select("owner", F.col("key").alias("_cur")), "owner")
    return j.filter(F.col("counts") & (F.col("key") != F.col("_cur"))).drop("_cur")


def drop_whole_report(tries: DataFrame, cut: DataFrame) -> DataFrame:
    """Remove the try over a whole report once the same report is cut by date."""
    return tries.join(cut.select("owner", "file", "from_day", "to_day"),
                      ["owner", "file", "from_day", "to_day"], "left_anti")


def overlapping_tries(tries: DataFrame, periods: DataFrame) -> DataFrame:
    """Tries of another plateau on dates that overlap a period (owner, p_from, p_to, p_plateau)."""
    j = tries.join(periods, "owner")
    return j.filter((F.col("from_day") <= F.col("p_to")) & (F.col("to_day") >= F.col("p_from"))
                    & (F.col("plateau") != F.col("p_plateau")))
