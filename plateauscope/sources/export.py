"""Result tables and files: pass table, report, values and refinement ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ["study_id", "row_idx"]


def guard_text(c: Column) -> Column:
    """Keep a spreadsheet from reading a text cell as a formula."""
    return F.regexp_replace(c, "^([=+\\-@])", "'$1")


def pass_table(cells: DataFrame, stability: DataFrame, members: DataFrame,
               plateaus: DataFrame) -> DataFrame:
    """One row per configuration with everything the audit says about it."""
    rank = members.select(*NODE, "component").join(
        plateaus.select("study_id", "component", F.col("rank").alias("plateau_rank")),
        ["study_id", "component"]).drop("component")
    s = stability.select(*NODE, "robust", "support", "q25", "frac_pass", "cliff", "peak_z")
    t = cells.join(s, NODE).join(rank, NODE, "left")
    return t.select(
        "study_id", "row_idx", guard_text(F.col("pass_id")).alias("pass_id"),
        F.concat_ws(",", F.transform("params", lambda p: guard_text(
            F.concat(p["name"], F.lit("="), p["txt"])))).alias("params"),
        "quality_is", "quality_oos", "score", "robust", "support", "q25", "frac_pass", "cliff",
        "peak_z", (F.size("fails_is") == 0).cast("int").alias("passes_is"),
        F.when(F.col("known"), (F.size("fails_oos") == 0).cast("int")).alias("passes_oos"),
        "plateau_rank", F.col("is.profit").alias("profit"), F.col("is.trades").alias("trades"),
        F.col("criterion_is").alias("criterion"))


def write_pass_table(table: DataFrame, path: str, decimal_comma: bool = False) -> None:
    """CSV files partitioned by study, with one number format throughout."""
    cols = []
    for name, kind in table.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.round(c, 6).cast("string")
            c = F.replace(c, F.lit("."), F.lit(",")) if decimal_comma else c
        cols.append(c.alias(name))
    (table.select(*cols).write.partitionBy("study_id").mode("overwrite")
     .option("header", True).option("sep", ";" if decimal_comma else ",").csv(path))


def fingerprint(studies: DataFrame, coverage: DataFrame, plateaus: DataFrame,
                levels: DataFrame) -> DataFrame:
    """Hash of the canonical result of each study."""
    p = plateaus.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "representative", "size", F.round("robust", 4).alias("robust"),
        F.round("pass_frac", 4).alias("pass_frac")))).alias("plateaus"))
    j = (studies.select("study_id", "mode", "total", "min_profit_factor", "max_drawdown_pct",
                        "min_trades")
         .join(coverage.select("study_id", F.round("coverage", 8).alias("coverage"), "sampling"),
               "study_id").join(levels.select("study_id", "level"), "study_id", "left")
         .join(p, "study_id", "left"))
    cols = sorted(c for c in j.columns if c != "study_id")
    return j.select("study_id", F.sha2(F.to_json(F.struct(*cols)), 256).alias("fingerprint"))


def study_report(studies: DataFrame, coverage: DataFrame, roles: DataFrame, plateaus: DataFrame,
                 peaks: DataFrame, findings: DataFrame, levels: DataFrame,
                 prints: DataFrame) -> DataFrame:
    """One JSON document per study: level, findings, sensitivity, plateaus and peaks.

    The lists are bounded by the rules, the parameters and the twelve kept peaks.
    """
    pack = lambda df, name, *cols: df.groupBy("study_id").agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    j = (studies.select("study_id", "mode", "total", "has_forward", "period_ratio")
         .join(coverage.select("study_id", "coverage", "sampling", "cartesian"), "study_id")
         .join(levels.select("study_id", "level", "critical", "warnings"), "study_id", "left")
         .join(prints, "study_id", "left")
         .join(pack(findings, "findings", "position", "code", "severity", "scope"), "study_id", "left")
         .join(pack(roles, "sensitivity", "dim", "name", "n_levels", "effective", "role"),
               "study_id", "left")
         .join(pack(plateaus, "plateaus", "rank", "component", "size", "core_size", "robust",
                    "median_score", "q10_score", "worst_score", "median_is", "median_oos",
                    "pass_frac", "representative", "support"), "study_id", "left")
         .join(pack(peaks, "rejected_peaks", "criterion_rank", "row_idx", "key", "score",
                    "support", "tags"), "study_id", "left"))
    return j.select("study_id", F.to_json(F.struct(*[c for c in j.columns])).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    report.select("study_id", F.col("report").alias("value")).write.partitionBy(
        "study_id").mode("overwrite").text(path)


def format_value(num: Column, txt: Column) -> Column:
    """Text of a value in a values file: no trailing zeros, flags and names as they are."""
    whole = num == F.floor(num)
    return F.when(num.isNull(), txt).when(whole, num.cast("long").cast("string")).otherwise(
        F.regexp_replace(F.regexp_replace(F.format_string("%.8f", num), "0+$", ""), "\\.$", ""))


def merge_values(chosen: DataFrame, base: DataFrame | None) -> DataFrame:
    """Chosen values over a base set: base order kept, extra names at the end.

    ``chosen``: study_id, position, name, text. ``base``: study_id, line_no, name, raw.
    A base set that shares no name with the choice is a mismatch and is not used.
    """
    c = chosen.select("study_id", "name", F.col("position").alias("_p"), F.col("text").alias("_t"))
    if base is None:
        return c.select("study_id", F.col("_p").alias("position"), "name", F.col("_t").alias("text"),
                        F.lit("optimized").alias("source"), F.lit(False).alias("mismatch"))
    b = base.groupBy("study_id", "name").agg(F.min("line_no").alias("_l"),
                                             F.min_by("raw", "line_no").alias("_raw"))
    common = c.join(b, ["study_id", "name"]).select("study_id").distinct().withColumn(
        "_ok", F.lit(True))
    has = b.select("study_id").distinct().withColumn("_has", F.lit(True))
    j = c.join(b, ["study_id", "name"], "full").join(common, "study_id", "left").join(
        has, "study_id", "left").join(c.select("study_id").distinct(), "study_id", "left_semi")
    mismatch = F.coalesce("_has", F.lit(False)) & ~F.coalesce("_ok", F.lit(False))
    j = j.filter(F.col("_p").isNotNull() | F.coalesce("_ok", F.lit(False)))
    return j.select(
        "study_id", F.coalesce(F.when(F.col("_ok"), F.col("_l")), F.col("_p") + (1 << 20))
        .alias("position"), "name", F.coalesce("_t", "_raw").alias("text"),
        F.when(F.col("_t").isNotNull(), "optimized").otherwise("base").alias("source"),
        mismatch.alias("mismatch"))


def values_file(plateaus: DataFrame, passes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``name=value`` lines of the first plateau's representative: (study_id, line_no, value)."""
    first = plateaus.filter("rank = 1").select("study_id", F.col("representative").alias("row_idx"))
    p = first.join(passes.select(*NODE, "params"), NODE).select(
        "study_id", F.posexplode("params").alias("position", "p"))
    chosen = p.select("study_id", F.col("position").cast("long").alias("position"), "p.name",
                      format_value(F.col("p.num"), F.col("p.txt")).alias("text"))
    m = merge_values(chosen, base)
    w = Window.partitionBy("study_id").orderBy("position", "name")
    return m.select("study_id", F.row_number().over(w).alias("line_no"),
                    F.concat_ws("=", "name", "text").alias("value"))


def refinement_file(ranges: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Range lines (Y = swept, N = fixed) of refinement rows of one plateau per study."""
    num = lambda c: format_value(F.col(c), F.lit("0"))
    center = format_value(F.col("center"), F.col("text"))
    swept = F.concat_ws("||", center, num("start"), num("step"), num("stop"), F.lit("Y"))
    still = F.concat_ws("||", center, center, F.lit("0"), center, F.lit("N"))
    chosen = ranges.select("study_id", F.col("dim").cast("long").alias("position"), "name",
                           F.when(F.col("fixed"), still).otherwise(swept).alias("text"))
    m = merge_values(chosen, base)
    m = m.withColumn("text", F.when(F.col("source") == "base", F.concat_ws(
        "||", "text", "text", F.lit("0"), "text", F.lit("N"))).otherwise(F.col("text")))
    w = Window.partitionBy("study_id").orderBy("position", "name")
    return m.select("study_id", F.row_number().over(w).alias("line_no"),
                    F.concat_ws("=", "name", "text").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder of text per study; lines stay in order inside a file."""
    (lines.repartition("study_id").sortWithinPartitions("study_id", "line_no")
     .select("study_id", "value").write.partitionBy("study_id").mode("overwrite").text(path))
