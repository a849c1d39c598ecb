"""Findings, level and outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateauscope.operators import verdict as V
from plateauscope.plans.stages import memo, stage

from .base import audit, register
from .sweep_sql import chain


def metrics(spark, sf):
    return memo(spark, (sf, "study_metrics"), lambda: V.metrics_frame(
        audit(spark, sf), stage))


@register("g1_findings", "study_id:s position:i code:s severity:s scope:s")
def g1(spark, sf):
    return V.findings(metrics(spark, sf))


def simple_metrics(spark, sf):
    """The deterministic part of the metrics row, which plain SQL can rebuild."""
    a = audit(spark, sf)
    m = a.power.join(a.studies.select("study_id", "has_forward", "mode", "period_ratio"),
                     "study_id")
    fc = a.cells.groupBy("study_id").agg(F.count_if("known").alias("forward_count"))
    best = a.plateaus.filter("rank = 1").select(
        "study_id", F.col("with_forward").alias("best_with_forward"),
        F.col("pass_frac").alias("best_pass_frac"))
    return (m.join(fc, "study_id").join(a.radius.select("study_id", "median_support"), "study_id")
            .join(best, "study_id", "left"))


_simple = """(SELECT p.*, has_forward, mode, pr, median_support, with_forward, pass_frac FROM (
 SELECT *, np = 0 AND search_pass > 0 AND search_pass < need underpowered FROM (
 SELECT c.study_id, count(*) total, count(*) FILTER (passes_joint) gate_pass,
  count(*) FILTER (known) fc, count(*) FILTER (passes) search_pass,
  ceil(3*(1+greatest(4, any_value(median_support))*0.9)) need,
  (SELECT count(*) FROM ranked k WHERE k.study_id=c.study_id) np, any_value(median_support)
   median_support FROM cells c JOIN radius USING (study_id) GROUP BY c.study_id)) p
 JOIN studies USING (study_id)
 LEFT JOIN (SELECT study_id, with_forward, pass_frac FROM ranked WHERE rank=1) b USING (study_id))"""


def _rule(code, sev, scope, cond):
    return f"SELECT study_id, '{code}' code, '{sev}' severity, '{scope}' AS scope FROM q WHERE {cond}"


_base = "CASE WHEN has_forward AND fc > 0 THEN fc ELSE total END"
_found = " UNION ALL ".join(_rule(*r) for r in [
    ("forward_none_pass", "critical", "plateau", "gate_pass=0 AND has_forward AND search_pass>0"),
    ("none_pass", "critical", "plateau", "gate_pass=0 AND NOT (has_forward AND search_pass>0)"),
    ("sliver_passes", "critical", "plateau", f"gate_pass>0 AND gate_pass/({_base}) < 0.02"),
    ("set_too_small", "critical", "plateau", "np=0 AND underpowered"),
    ("no_plateau", "critical", "plateau", "np=0 AND NOT underpowered"),
    ("found_then_validated", "info", "plateau", "has_forward"),
    ("plateau_untested", "warn", "plateau", "has_forward AND np>0 AND with_forward=0"),
    ("plateau_fails_forward", "critical", "plateau",
     "has_forward AND np>0 AND with_forward>0 AND pass_frac < 0.65"),
    ("plateau_half_forward", "warn", "plateau",
     "has_forward AND np>0 AND with_forward>0 AND pass_frac >= 0.65 AND pass_frac < 0.8"),
    ("no_forward", "critical", "plateau", "NOT has_forward"),
    ("forward_used_to_validate", "info", "plateau", "has_forward"),
    ("no_search_space", "info", "plateau", "true"),
    ("low_support", "warn", "plateau", "median_support < 4"),
    ("almost_all_viable", "ok", "plateau", f"has_forward AND gate_pass/({_base}) >= 0.6"),
    ("broadly_viable", "ok", "plateau",
     f"has_forward AND gate_pass/({_base}) < 0.6 AND gate_pass/({_base}) >= 0.25 AND np>0"),
    ("short_forward", "warn", "plateau", "pr < 0.15"),
    ("long_forward", "info", "plateau", "pr > 1.2"),
])
_qf = f"WITH q AS MATERIALIZED (SELECT * FROM {_simple}), found AS MATERIALIZED ({_found}) "


@register("g1_basic_findings", "study_id:s code:s severity:s scope:s", _qf + "SELECT * FROM found",
          chain("ranked"))
def g1b(spark, sf):
    return V.findings(simple_metrics(spark, sf))


@register("g2_evidence_level", "study_id:s level:s critical:i warnings:i blocking:i", _qf + """
 SELECT study_id, critical, warnings, blocking, CASE WHEN underpowered THEN 'insufficient'
  WHEN critical > 0 THEN 'weak' ELSE 'moderate' END AS level FROM q JOIN (
  SELECT study_id, count(*) FILTER (severity='critical') critical,
   count(*) FILTER (severity='warn') warnings,
   count(*) FILTER (severity='warn' AND scope<>'table') blocking FROM found GROUP BY 1)
 USING (study_id)""", chain("ranked"))
def g2(spark, sf):
    m = simple_metrics(spark, sf)
    return V.evidence_level(V.findings(m), m)


@register("g2_full_level", "study_id:s level:s critical:i warnings:i blocking:i")
def g2b(spark, sf):
    m = metrics(spark, sf)
    return V.evidence_level(V.findings(m), m)


@register("g3_outcome", "study_id:s outcome:s", f"""
 SELECT study_id, CASE WHEN search_pass=0 THEN 'no_qualifying_configs' WHEN underpowered
  THEN 'insufficient_data' WHEN np=0 THEN 'no_plateau' ELSE 'success' END outcome
 FROM {_simple}""", chain("ranked"))
def g3(spark, sf):
    return V.outcome(simple_metrics(spark, sf))


@register("g4_displayed_level", "study_id:s level:s displayed:s against:b")
def g4(spark, sf):
    m = metrics(spark, sf)
    lv = V.evidence_level(V.findings(m), m)
    unseen = audit(spark, sf).plateaus.filter("rank = 1").select(
        "study_id", F.when(F.col("q10_score") < 0.97, "outside").otherwise("normal")
        .alias("unseen_level"), F.lit(False).alias("other_config"),
        F.lit(None).cast("string").alias("repeated"), F.lit(1).alias("plateau_rank"))
    return V.displayed_level(lv, m, unseen)


@register("g5_highlights", "study_id:s side:s place:i code:s severity:s", _qf + """
 SELECT study_id, side, place, code, severity FROM (SELECT *, row_number() OVER (
  PARTITION BY study_id, side ORDER BY w, pos) place FROM (
  SELECT *, CASE WHEN severity='ok' THEN 'pro' ELSE 'con' END side,
   CASE WHEN severity IN ('ok','critical') THEN 0 WHEN scope='table' THEN 2 ELSE 1 END w,
   list_position(['forward_none_pass','none_pass','sliver_passes','set_too_small','no_plateau',
    'plateau_untested','plateau_fails_forward','plateau_half_forward','no_forward','low_support',
    'almost_all_viable','broadly_viable','short_forward'], code) pos
  FROM found WHERE severity <> 'info')) WHERE place <= 4""", chain("ranked"))
def g5(spark, sf):
    return V.highlights(V.findings(simple_metrics(spark, sf)))


@register("g6_next_step", "study_id:s next_step:s", f"""
 SELECT study_id, CASE WHEN underpowered THEN 'widen_search' WHEN np=0 THEN 'refine_search'
  ELSE 'test_unseen_period' END next_step FROM {_simple}""", chain("ranked"))
def g6(spark, sf):
    m = simple_metrics(spark, sf)
    return V.next_step(V.evidence_level(V.findings(m), m), m)
