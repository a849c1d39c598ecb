"""Evidence findings, level, outcome and highlights from one metrics row per study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bias as B
from . import plateau as P
from .plateau import FORWARD_CRITICAL

CRITICAL, WARN, OK, INFO = "critical", "warn", "ok", "info"
VIABLE_REFUGE = 0.25
PROVENANCE_CRITICAL_SHARE = 0.01

# Columns of the metrics row; a study supplies those it has, the rest are NULL.
METRIC_TYPES = {
    **{k: "boolean" for k in (
        "has_forward", "underpowered", "outside_any", "set_present", "set_usable",
        "forward_subset", "any_inert_gate", "offsets_complete")},
    **{k: "string" for k in ("mode", "sampling", "pass_source")},
    **{k: "double" for k in (
        "total", "gate_pass", "search_pass", "forward_count", "plateaus", "missing_metrics",
        "optimised_dims", "per_param", "fragility", "fragility_quality", "asymmetry",
        "spearman", "best_with_forward", "best_pass_frac", "region_rate", "gate_region_rate",
        "draws", "observed_max", "chance_max", "expected", "own_lo", "rescued", "irregular",
        "coverage", "coverage_search", "missing_in_set", "set_params_in_common",
        "median_support", "inversions", "median_quality_is", "median_quality_oos", "pass_is",
        "pass_oos", "tied", "best_inverted", "best_boundary", "period_ratio",
        "provenance_compared", "provenance_mismatches", "damaged", "hidden_losers",
        "duplicate_ids", "unmatched_is", "is_rows", "duplicate_vectors")},
}


def complete_metrics(df: DataFrame) -> DataFrame:
    """Add the metric columns a caller did not supply, as NULL."""
    return df.select("study_id", *[
        (F.col(k) if k in df.columns else F.lit(None)).cast(t).alias(k)
        for k, t in METRIC_TYPES.items()])


def _rules() -> list[tuple[str, str | Column, str, str | None, Column]]:
    """(code, severity, scope, category, condition), in the order they are reported."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    forward = F.coalesce(c("has_forward"), F.lit(False))
    base = F.when(forward & (c("forward_count") > 0), c("forward_count")).otherwise(c("total"))
    share = c("gate_pass") / base
    region = zero("plateaus") > 0
    refuge = (share >= VIABLE_REFUGE) & region
    staged = forward & (c("mode") == "is_then_oos")
    joint = forward & (c("mode") == "joint")
    tested = staged & region
    none_forward = (zero("gate_pass") == 0) & forward & (c("search_pass") > 0)
    merged = (c("sampling") == "sparse") & c("set_usable") & (c("coverage_search") < 0.02)
    merged = F.coalesce(merged, F.lit(False))
    usable = F.coalesce(c("set_usable"), F.lit(False))
    low_set = usable & ~merged & (c("coverage_search") < 0.02)
    misleading = (usable & (c("coverage_search") >= 0.02) & (c("coverage") >= 0.5)
                  & (c("coverage_search") < c("coverage") * 0.5))
    rest_set = usable & (c("coverage_search") >= 0.02) & ~F.coalesce(misleading, F.lit(False))
    stab = c("draws") > 0
    mism = c("provenance_mismatches") / F.nullif(c("provenance_compared"), F.lit(0.0))
    unmatched = zero("unmatched_is") > 0
    big = lambda n: F.when(zero(n) / F.nullif(c("is_rows"), F.lit(0.0)) > 0.05, WARN).otherwise(INFO)
    return [
        ("forward_none_pass", CRITICAL, "plateau", None, none_forward),
        ("none_pass", CRITICAL, "plateau", None, (zero("gate_pass") == 0) & ~none_forward),
        ("sliver_passes", CRITICAL, "plateau", None, (c("gate_pass") > 0) & (share < 0.02)),
        ("missing_columns", CRITICAL, "plateau", None, zero("missing_metrics") > 0),
        ("thin_evidence", CRITICAL, "plateau", None, c("per_param") < 15),
        ("limited_evidence", WARN, "plateau", None,
         (c("per_param") >= 15) & (c("per_param") < 50)),
        ("ample_evidence", OK, "plateau", None, c("per_param") >= 100),
        ("set_too_small", CRITICAL, "plateau", None, ~region & c("underpowered")),
        ("no_plateau", CRITICAL, "plateau", None,
         ~region & ~F.coalesce(c("underpowered"), F.lit(False))),
        ("ranking_fails_with_refuge", WARN, "table", None, (c("fragility") >= 0.5) & refuge),
        ("ranking_fails", WARN, "table", None, (c("fragility") >= 0.5) & ~refuge),
        ("ranking_half_holds", WARN, "table", None,
         (c("fragility") >= 0.3) & (c("fragility") < 0.5)),
        ("ranking_holds", OK, "plateau", None, c("fragility") < 0.3),
        ("quality_ranking_fails", WARN, "table", None, c("fragility_quality") >= 0.5),
        ("quality_ranking_holds", OK, "plateau", None, c("fragility_quality") < 0.3),
        ("found_then_validated", INFO, "plateau", None, staged),
        ("plateau_untested", WARN, "plateau", None, tested & (c("best_with_forward") == 0)),
        ("plateau_fails_forward", CRITICAL, "plateau", None, tested
         & (c("best_with_forward") > 0) & (c("best_pass_frac") < FORWARD_CRITICAL)),
        ("plateau_half_forward", WARN, "plateau", None, tested & (c("best_with_forward") > 0)
         & (c("best_pass_frac") >= FORWARD_CRITICAL) & (c("best_pass_frac") < 0.8)),
        ("joint_mode", INFO, "plateau", None, joint),
        ("periods_not_exchangeable", WARN, "table", None, c("asymmetry") >= 0.25),
        ("inert_gates", INFO, "plateau", None, c("any_inert_gate")),
        ("thresholds_hold", OK, "plateau", None, stab & (c("region_rate") >= 0.8)),
        ("thresholds_half_hold", WARN, "plateau", None,
         stab & (c("region_rate") >= 0.5) & (c("region_rate") < 0.8)),
        ("thresholds_decide", CRITICAL, "plateau", None, stab & (c("region_rate") < 0.5)),
        ("limits_hold", OK, "plateau", None, stab & (c("gate_region_rate") >= 0.8)),
        ("limits_move", WARN, "plateau", None,
         stab & (c("gate_region_rate") >= 0.5) & (c("gate_region_rate") < 0.8)),
        ("limits_decide", CRITICAL, "plateau", None, stab & (c("gate_region_rate") < 0.5)),
        ("sharpe_is_chance", CRITICAL, "plateau", None, c("observed_max") <= c("chance_max")),
        ("sharpe_beats_chance", OK, "plateau", None, c("observed_max") > c("chance_max")),
        ("expectation_distinct", INFO, "table", None,
         c("expected").isNotNull() & (c("own_lo") > 0)),
        ("expectation_not_distinct", WARN, "table", None, c("expected").isNotNull()
         & ~F.coalesce(c("own_lo") > 0, F.lit(False))),
        ("no_forward", CRITICAL, "plateau", None, ~forward),
        ("forward_used_to_select", INFO, "plateau", None, joint),
        ("forward_used_to_validate", INFO, "plateau", None, forward & ~joint),
        ("rescued_parameters", INFO, "plateau", None, zero("rescued") > 0),
        ("irregular_grid", WARN, "plateau", None, zero("irregular") > 0),
        ("approximate_ball", INFO, "plateau", None, ~c("offsets_complete")),
        ("sparse_sampling", WARN, "plateau", "coverage", (c("sampling") == "sparse") & ~merged),
        ("sparse_search_space", WARN, "plateau", "coverage", merged),
        ("low_search_coverage", WARN, "plateau", "coverage", low_set),
        ("coverage_misleads", WARN, "plateau", "coverage", misleading),
        ("search_covered", OK, "plateau", "coverage", rest_set & (c("coverage_search") >= 0.95)),
        ("search_coverage", INFO, "plateau", "coverage", rest_set & (c("coverage_search") < 0.95)),
        ("outside_range", WARN, "plateau", "coverage", usable & c("outside_any")),
        ("parameters_not_in_set", INFO, "plateau", "coverage",
         usable & (zero("missing_in_set") > 0)),
        ("no_search_space", INFO, "plateau", "coverage",
         ~usable & ~F.coalesce(c("set_present"), F.lit(False))),
        ("wrong_search_space", WARN, "plateau", "coverage",
         ~usable & c("set_present") & (zero("set_params_in_common") == 0)),
        ("search_space_without_ranges", INFO, "plateau", "coverage",
         ~usable & c("set_present") & (zero("set_params_in_common") > 0)),
        ("low_support", WARN, "plateau", None, c("median_support") < 4),
        ("no_transfer_with_refuge", WARN, "table", None, (c("spearman") < 0.1) & refuge),
        ("no_transfer", CRITICAL, "plateau", None, (c("spearman") < 0.1) & ~refuge),
        ("weak_transfer", WARN, "table", None, (c("spearman") >= 0.1) & (c("spearman") < 0.3)),
        ("transfer", OK, "plateau", None, c("spearman") >= 0.3),
        ("almost_all_viable", OK, "plateau", None, forward & (share >= 0.6)),
        ("broadly_viable", OK, "plateau", None, forward & (share < 0.6) & refuge),
        ("period_inversions", WARN, "table", None, zero("inversions") > 0),
        ("benign_forward", WARN, "plateau", None,
         (c("median_quality_oos") > c("median_quality_is") + 0.05)
         & (c("pass_oos") > c("pass_is") + 0.05)),
        ("tied_plateaus", INFO, "plateau", None, zero("tied") > 1),
        ("inverted_representative", WARN, "plateau", None, zero("best_inverted") > 0),
        ("at_the_boundary", WARN, "plateau", None, zero("best_boundary") > 0),
        ("short_forward", WARN, "plateau", None, c("period_ratio") < 0.15),
        ("long_forward", INFO, "plateau", None, c("period_ratio") > 1.2),
        ("different_runs", CRITICAL, "plateau", None, mism >= PROVENANCE_CRITICAL_SHARE),
        ("some_rows_differ", WARN, "table", None,
         (c("provenance_mismatches") > 0) & (mism < PROVENANCE_CRITICAL_SHARE)),
        ("forward_subset", WARN, "table", None, c("forward_subset")),
        ("damaged_rows", WARN, "plateau", None, zero("damaged") > 0),
        ("hidden_losers", INFO, "plateau", None, zero("hidden_losers") > 0),
        ("numbered_by_row", WARN, "plateau", None, c("pass_source") != "pass"),
        ("duplicate_ids", WARN, "plateau", None, zero("duplicate_ids") > 0),
        ("unmatched_used", INFO, "plateau", None, unmatched & ~joint),
        ("unmatched_dropped", big("unmatched_is"), "plateau", None, unmatched & joint),
        ("duplicate_vectors", big("duplicate_vectors"), "plateau", None,
         zero("duplicate_vectors") > 0),
    ]


def findings(metrics: DataFrame) -> DataFrame:
    """One row per rule that fires, in reporting order."""
    rows = []
    for i, (code, severity, scope, category, condition) in enumerate(_rules()):
        sev = F.lit(severity) if isinstance(severity, str) else severity
        rows.append(F.when(condition, F.struct(
            F.lit(i).alias("position"), F.lit(code).alias("code"), sev.alias("severity"),
            F.lit(scope).alias("scope"), F.lit(category).cast("string").alias("category"))))
    fired = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return complete_metrics(metrics).select("study_id", F.inline(fired))


def evidence_level(found: DataFrame, metrics: DataFrame) -> DataFrame:
    counts = found.groupBy("study_id").agg(
        F.count_if(F.col("severity") == CRITICAL).alias("critical"),
        F.count_if(F.col("severity") == WARN).alias("warnings"),
        F.count_if((F.col("severity") == WARN) & (F.col("scope") != "table")).alias("blocking"))
    m = complete_metrics(metrics).join(counts, "study_id", "left").fillna(
        0, ["critical", "warnings", "blocking"])
    validated = F.coalesce(F.col("has_forward") & (F.col("mode") == "is_then_oos")
                           & (F.col("best_with_forward") > 0) & (F.col("draws") > 0), F.lit(False))
    level = (F.when(F.col("underpowered"), "insufficient")
             .when(F.col("critical") > 0, "weak")
             .when(validated & (F.col("blocking") == 0), "strong")
             .when(validated & (F.col("blocking") == 1) & (F.col("region_rate") >= 0.8), "good")
             .otherwise("moderate"))
    return m.select("study_id", level.alias("level"), "critical", "warnings", "blocking")


def outcome(metrics: DataFrame) -> DataFrame:
    found = F.coalesce(F.col("search_pass"), F.col("gate_pass"), F.lit(0.0))
    code = (F.when(found == 0, "no_qualifying_configs")
            .when(F.col("underpowered"), "insufficient_data")
            .when(F.coalesce("plateaus", F.lit(0.0)) == 0, "no_plateau").otherwise("success"))
    return complete_metrics(metrics).select("study_id", code.alias("outcome"))


def displayed_level(levels: DataFrame, metrics: DataFrame, unseen: DataFrame) -> DataFrame:
    """Cap strong and good at moderate when a valid unseen period goes against the proposal.

    ``unseen``: study_id, unseen_level, other_config, repeated, plateau_rank.
    """
    j = levels.join(complete_metrics(metrics).select("study_id", "has_forward"), "study_id").join(
        unseen, "study_id", "left")
    valid = (~F.coalesce("other_config", F.lit(False)) & F.col("repeated").isNull()
             & (F.coalesce("plateau_rank", F.lit(1)) == 1))
    against = valid & (F.col("unseen_level") != "normal")
    capped = F.coalesce(F.col("has_forward") & against
                        & F.col("level").isin("strong", "good"), F.lit(False))
    return j.select("study_id", "level", F.when(capped, "moderate").otherwise(F.col("level"))
                    .alias("displayed"), F.coalesce(against, F.lit(False)).alias("against"))


def highlights(found: DataFrame, keep: int = 4) -> DataFrame:
    """First four points in favour and against, the latter by weight."""
    side = F.when(F.col("severity") == OK, "pro").when(
        F.col("severity").isin(WARN, CRITICAL), "con")
    weight = (F.when(F.col("severity") == OK, 0).when(F.col("severity") == CRITICAL, 0)
              .when(F.col("scope") == "table", 2).otherwise(1))
    # A study has at most one row per rule, so this window is a few dozen rows.
    w = Window.partitionBy("study_id", "side").orderBy(weight, "position")
    return (found.withColumn("side", side).filter("side IS NOT NULL")
            .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
            .select("study_id", "side", "place", "code", "severity"))


def next_step(levels: DataFrame, metrics: DataFrame) -> DataFrame:
    m = complete_metrics(metrics).join(levels.select("study_id", "level"), "study_id")
    step = (F.when(F.col("level") == "insufficient", "widen_search")
            .when(F.coalesce("plateaus", F.lit(0.0)) == 0, "refine_search")
            .when(F.col("fragility") >= 0.5, "ignore_table_order")
            .otherwise("test_unseen_period"))
    return m.select("study_id", step.alias("next_step"))


def metrics_frame(audit, stage, repeats: int = 2000, search: DataFrame | None = None,
                  integrity: DataFrame | None = None, gates: bool = True,
                  shrink_reps: int = 500) -> DataFrame:
    """One row per study with everything the rules look at."""
    a = audit
    num = lambda df, *cols: df.select("study_id", *cols)
    pairs = B.criterion_pairs(a.cells)
    best = a.plateaus.filter("rank = 1")
    by_quality = pairs.select("study_id", "row_idx", F.col("quality_is").alias("a"),
                              F.col("quality_oos").alias("b"))
    frag = B.selection_fragility(pairs, stage, repeats)
    fragq = B.selection_fragility(by_quality, stage, repeats)
    from .quality import evidence_density, gate_influence
    inert = gate_influence(a.cells, a.studies).groupBy("study_id").agg(
        F.max(F.col("inert") & (F.col("gate") != "profit")).alias("any_inert_gate"))
    top = a.plateaus.filter("rank <= 3").select("study_id", F.col("representative").alias("row_idx"))
    exp = B.expectation(stage(B.units(a.cells, a.edges), "units"), a.coarse, top,
                        reps=shrink_reps)[1]
    exp = exp.join(best.select("study_id", F.col("representative").alias("row_idx")),
                   ["study_id", "row_idx"])
    best_points = best.select("study_id", "component", F.col("representative").alias("row_idx"))
    edge = P.boundary_touch(best_points, a.cells, a.roles).groupBy("study_id").agg(
        F.count(F.lit(1)).alias("best_boundary"))
    parts = [
        num(a.studies, "has_forward", "mode", "period_ratio"),
        num(a.power, "total", "gate_pass", "search_pass", "plateaus", "underpowered"),
        a.cells.groupBy("study_id").agg(F.count_if("known").alias("forward_count")),
        num(a.coverage, "coverage", "sampling", "optimised_dims"),
        num(evidence_density(a.rows, num(a.coverage, "optimised_dims")), "per_param"),
        num(frag, "fragility", "asymmetry"),
        num(fragq, F.col("fragility").alias("fragility_quality")),
        num(B.spearman(pairs, ["study_id"], "a", "b"), "spearman"),
        num(best, F.col("with_forward").alias("best_with_forward"),
            F.col("pass_frac").alias("best_pass_frac"),
            F.col("inverted").cast("int").alias("best_inverted")),
        num(a.threshold_stability, "draws", "region_rate"),
        num(B.sharpe_selection(a.cells), "observed_max", "chance_max"),
        num(exp, "expected", "own_lo"), inert,
        a.roles.groupBy("study_id").agg(F.count_if("rescued").alias("rescued")),
        a.jumps.groupBy("study_id").agg(F.count_distinct("dim").alias("irregular")),
        num(a.radius, "median_support"),
        a.inversions.groupBy("study_id").agg(F.count(F.lit(1)).alias("inversions")),
        P.period_comparison(a.cells),
        P.ties(a.plateaus).groupBy("study_id").agg(F.max("tied").alias("tied")), edge]
    if gates:
        parts.append(num(a.gate_stability, F.col("region_rate").alias("gate_region_rate")))
    if search is not None:
        parts.append(search)
    if integrity is not None:
        parts.append(integrity)
    # Each part is one row per study; they are staged so the joins see their true size.
    parts = [stage(p, f"metrics{i}") for i, p in enumerate(parts)]
    out = reduce(lambda x, y: x.join(y, "study_id", "left"), parts)
    return stage(complete_metrics(out), "metrics")
