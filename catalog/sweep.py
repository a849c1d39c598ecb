"""Quality, parameter space and plateau queries over the derived sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateauscope.operators import plateau as P
from plateauscope.operators import quality as Q
from plateauscope.operators import space as S
from plateauscope.operators.ordering import attach, with_ranks
from plateauscope.plans import relations as RL

from .base import audit, register
from .sweep_sql import chain

R = "study_id:s row_idx:i"
join = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


# ------------------------------------------------------------------ quality
@register("c1_policy_anchors",
          "study_id:s dd_zero:d dd_full:d pf_zero:d pf_full:d tr_zero:d tr_full:d",
          "SELECT study_id, 30.0 dd_zero, 5.0 dd_full, 1.0 pf_zero, 1.5 pf_full, "
          "greatest(5, mt*0.5) tr_zero, mt*5 tr_full FROM studies", chain("studies"))
def c1(spark, sf):
    a = F.col("anchors")
    return audit(spark, sf).studies.select("study_id", *[
        a[m][e].alias(f"{s}_{e}") for m, s in (("drawdown", "dd"), ("profit_factor", "pf"),
                                               ("trades", "tr")) for e in ("zero", "full")])


@register("c2_component_scores", f"{R} profit_factor:d recovery_factor:d drawdown:d sharpe:d "
          "trades:d", """SELECT study_id, row_idx,
  least(1, greatest(0, (is_profit_factor-1)/0.5)) profit_factor,
  least(1, greatest(0, is_recovery_factor/3.0)) recovery_factor,
  least(1, greatest(0, (is_drawdown-30)/(5-30.0))) drawdown,
  CASE WHEN is_sharpe IS NOT NULL THEN least(1, greatest(0, is_sharpe/2.5)) END sharpe,
  least(1, greatest(0, ln(is_trades/greatest(5,mt*0.5))/ln(mt*5/greatest(5,mt*0.5)))) trades
 FROM passes JOIN studies USING (study_id)""", chain("studies"))
def c2(spark, sf):
    a = audit(spark, sf)
    r = attach(a.passes, a.studies.select("study_id", "anchors"), ["study_id"], "inner", "row_idx")
    s = Q.component_scores(F.col("is"), F.col("anchors"))
    return r.select("study_id", "row_idx", *[v.alias(k) for k, v in s.items()])


@register("c3_length_adjust", f"{R} drawdown:d recovery_factor:d",
          """SELECT study_id, row_idx,
  least(100, oos_drawdown/sqrt(least(20,greatest(0.05,pr)))) drawdown,
  oos_recovery_factor/sqrt(least(20,greatest(0.05,pr))) recovery_factor
 FROM passes JOIN studies USING (study_id) WHERE oos_known""", chain("studies"))
def c3(spark, sf):
    a = audit(spark, sf)
    r = attach(a.passes.filter("oos_known"), a.studies.select("study_id", "period_ratio"), ["study_id"],
               "inner", "row_idx")
    m = Q.length_adjust(F.col("oos"), F.col("period_ratio"))
    return r.select("study_id", "row_idx", m["drawdown"].alias("drawdown"),
                    m["recovery_factor"].alias("recovery_factor"))


@register("c4_period_quality", f"{R} quality_is:d quality_oos:d quality_oos_adjusted:d",
          "SELECT * FROM scored", chain("scored"))
def c4(spark, sf):
    return audit(spark, sf).scored


@register("c5_gate_failures", f"{R} fails_is:s fails_oos:s",
          "SELECT study_id, row_idx, array_to_string(fails_is, ',') fails_is, "
          "array_to_string(fails_oos, ',') fails_oos FROM scored", chain("scored"))
def c5(spark, sf):
    return audit(spark, sf).scored.select(
        "study_id", "row_idx", join("fails_is").alias("fails_is"),
        join("fails_oos").alias("fails_oos"))


@register("c6_combined_retention", f"{R} quality_combined:d retention:d",
          "SELECT * FROM scored", chain("scored"))
def c6(spark, sf):
    return audit(spark, sf).scored


@register("c7_payoff_scale", "study_id:s zero:d full_:d", """
 SELECT study_id, greatest(0, s[CAST(floor((n-1)*0.25) AS INT)+1]) AS zero,
  s[CAST(floor((n-1)*0.9) AS INT)+1] AS full_ FROM (
  SELECT study_id, list_sort(list(x)) s, count(*) n FROM (
   SELECT study_id, is_expected_payoff x FROM passes UNION ALL
   SELECT study_id, oos_expected_payoff FROM passes WHERE oos_known) GROUP BY 1)
 WHERE n >= 20 AND s[CAST(floor((n-1)*0.9) AS INT)+1] >
  greatest(0, s[CAST(floor((n-1)*0.25) AS INT)+1])""", chain("passes"))
def c7(spark, sf):
    return Q.payoff_scale(audit(spark, sf).passes).withColumnRenamed("full", "full_")


@register("c8_quality_label", "study_id:s label:s n:i", """
 SELECT study_id, label, count(*) n FROM (SELECT study_id, CASE WHEN score IS NULL THEN 'no data'
  WHEN score>=0.7 THEN 'excellent' WHEN score>=0.55 THEN 'good' WHEN score>=0.4 THEN 'acceptable'
  WHEN score>=0.25 THEN 'weak' ELSE 'poor' END label FROM scored) GROUP BY ALL""",
          chain("scored"))
def c8(spark, sf):
    return audit(spark, sf).scored.groupBy(
        "study_id", Q.quality_label(F.col("score")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@register("c9_row_scores", f"{R} score:d passes:b passes_joint:b passes_discover:b",
          "SELECT * FROM scored", chain("scored"))
def c9(spark, sf):
    return audit(spark, sf).scored


@register("c10_viable_scale", "study_id:s iqr:d mad:d population_n:i", "SELECT * FROM scale",
          chain("scale"))
def c10(spark, sf):
    return Q.viable_scale(audit(spark, sf).rows)


_hit = "list_distinct(list_concat(fails_is, fails_oos))"
_both = lambda f, k: (f"CASE WHEN known THEN {f}(is_{k}, oos_{k}) ELSE is_{k} END")


@register("c11_gate_influence", "study_id:s gate:s fails:i sole:i inert:b observed:d limit_:d "
          "observed_oos:d limit_oos:d", f"""
 SELECT k.study_id, gate, fails, sole, sole=0 inert,
  CASE gate WHEN 'profit_factor' THEN o_pf WHEN 'drawdown' THEN o_dd WHEN 'trades' THEN o_tr END
   observed,
  CASE gate WHEN 'profit' THEN 0 WHEN 'profit_factor' THEN 1.2 WHEN 'drawdown' THEN 20 ELSE mt END
   limit_,
  CASE WHEN gate='trades' AND has_forward THEN o_tro END observed_oos,
  CASE WHEN gate='trades' AND has_forward THEN mt_oos END limit_oos
 FROM (SELECT study_id, gate, count(*) FILTER (list_contains({_hit}, gate)) fails,
   count(*) FILTER (list_contains({_hit}, gate) AND len({_hit})=1) sole
  FROM scored, (VALUES ('profit'),('profit_factor'),('drawdown'),('trades')) g(gate) GROUP BY ALL) k
 JOIN studies USING (study_id) LEFT JOIN (
  SELECT study_id, median({_both('least', 'profit_factor')}) o_pf,
   median({_both('greatest', 'drawdown')}) o_dd, median(is_trades) o_tr, median(oos_trades) o_tro
  FROM scored WHERE CASE WHEN has_forward THEN passes_joint ELSE passes END GROUP BY 1) o
 USING (study_id)""", chain("scored"))
def c11(spark, sf):
    a = audit(spark, sf)
    return Q.gate_influence(a.scored, a.studies).withColumnRenamed("limit", "limit_")


@register("c12_evidence_density", "study_id:s trades_is:d trades_oos:d per_param:d "
          "trials_per_trade:d based_on:s", """
 SELECT study_id, ti trades_is, CASE WHEN hf THEN t2 END trades_oos,
  CASE WHEN hf THEN t2 ELSE ti END / 3 per_param,
  n / CASE WHEN hf THEN t2 ELSE ti END trials_per_trade,
  CASE WHEN hf THEN 'forward' ELSE 'in_sample' END based_on FROM (
  SELECT study_id, median(is_trades) ti, median(oos_trades) t2, bool_or(has_forward) hf, count(*) n
  FROM scored GROUP BY 1)""", chain("scored"))
def c12(spark, sf):
    a = audit(spark, sf)
    return Q.evidence_density(a.scored, a.coverage.select("study_id", "optimised_dims"))


# ------------------------------------------------------------------ space
@register("d1_coordinates", f"{R} coords:s",
          "SELECT study_id, row_idx, z0||','||z1||','||z2 coords FROM rows_", chain("rows_"))
def d1(spark, sf):
    a = audit(spark, sf)
    return S.coordinates(a.passes, a.levels).withColumn("coords", join("coords"))


@register("d2_observed_coverage", "study_id:s total:i cartesian:d coverage:d sampling:s", """
 SELECT study_id, total, cartesian, total/cartesian coverage,
  CASE WHEN total/cartesian >= 0.95 THEN 'grid' WHEN total/cartesian >= 0.02 THEN 'partial'
   ELSE 'sparse' END sampling
 FROM (SELECT study_id, count(*) total FROM passes GROUP BY 1)
 JOIN (SELECT study_id, product(n_levels) cartesian FROM lc GROUP BY 1) USING (study_id)""",
          chain("lc"))
def d2(spark, sf):
    return audit(spark, sf).coverage


def search_space(spark, sf):
    """Ranges declared for the sweep: p0 matches, p1 is wider, p2 is an enumeration."""
    ids = audit(spark, sf).studies.select("study_id")
    rng = lambda n, a, s, z, en=True: F.struct(
        F.lit(n).alias("name"), F.lit(float(a)).alias("start"), F.lit(float(s)).alias("step"),
        F.lit(float(z)).alias("stop"), F.lit(None).cast("boolean").alias("bool_start"),
        F.lit(None).cast("boolean").alias("bool_stop"), F.lit(en).alias("enabled"),
        F.lit(True).alias("has_range"))
    return ids.select("study_id", F.inline(F.array(
        rng("p0", 0, 1, 10), rng("p1", 0, 2, 16), rng("p2", 0, 0, 4))))


@register("d3_declared_coverage", "study_id:s search_cartesian:d unique_observed:i "
          "coverage_search:d outside_any:b", """
 SELECT study_id, 11*9*5 search_cartesian, count(*) unique_observed, count(*)/495.0 coverage_search,
  bool_or(p1 % 2 = 1) outside_any FROM passes GROUP BY 1""", chain("passes"))
def d3(spark, sf):
    return S.declared_coverage(audit(spark, sf).passes, search_space(spark, sf))[1]


@register("d3_declared_parameters", "study_id:s name:s role:s search_levels:i "
          "observed_distinct:i outside:i on_grid:i", """
 SELECT study_id, name, 'optimised' AS role, CASE name WHEN 'p0' THEN 11 WHEN 'p1' THEN 9 ELSE 5 END
  search_levels, count(DISTINCT val) observed_distinct,
  count(*) FILTER (name='p1' AND val % 2 = 1) outside,
  count(*) FILTER (NOT (name='p1' AND val % 2 = 1)) on_grid FROM long GROUP BY ALL""",
          chain("long"))
def d3b(spark, sf):
    return S.declared_coverage(audit(spark, sf).passes, search_space(spark, sf))[0]


@register("d4_marginal_sensitivity", "study_id:s dim:i n_levels:i marginal:d",
          "SELECT * FROM marg", chain("marg"))
def d4(spark, sf):
    return audit(spark, sf).marginal


@register("d5_conditional_sensitivity", "study_id:s dim:i conditional_groups:i conditional:d",
          "SELECT * FROM cond", chain("cond"))
def d5(spark, sf):
    return audit(spark, sf).conditional


@register("d6_dimension_roles", "study_id:s dim:i name:s effective:d role:s rescued:b",
          "SELECT * FROM roles", chain("roles"))
def d6(spark, sf):
    return audit(spark, sf).roles


@register("d7_topology_cells", f"{R} cell:s cell_rows:i", """
 SELECT cells.study_id, row_idx, cell_rows, array_to_string(list_filter([CASE WHEN a0 THEN z0 END,
  CASE WHEN a1 THEN z1 END, CASE WHEN a2 THEN z2 END], lambda x: x IS NOT NULL), ',') cell
 FROM cells JOIN act USING (study_id)""", chain("cells"))
def d7(spark, sf):
    return audit(spark, sf).cells.withColumn("cell", join("cell"))


@register("d8_ball_offsets", "study_id:s radius:i offsets:i", """
 SELECT study_id, r AS radius, count(*) offsets FROM radius, range(1,4) q(r), range(-3,4) x(a),
  range(-3,4) y(b), range(-3,4) z(c) WHERE abs(a)+abs(b)+abs(c) = r AND
  (study_id NOT IN (SELECT study_id FROM act WHERE NOT a2) OR c = 0) GROUP BY ALL""",
          chain("radius"))
def d8(spark, sf):
    n = audit(spark, sf).cells.groupBy("study_id").agg(F.max(F.size("cell")).alias("d"))
    return n.select("study_id", "d", F.explode(F.array(*[F.struct(
        F.lit(r).alias("radius"), (2 * F.size(S.ball(F.col("d"), r))).alias("offsets"))
        for r in (1, 2, 3)])).alias("x")).select("study_id", "x.*")


@register("d9_neighbours", "study_id:s src:i dst:i dist:i", "SELECT * FROM edges", chain("edges"))
def d9(spark, sf):
    return audit(spark, sf).edges


_Z = [f"z{i}" for i in range(10)]
_CODE = "CAST(flag AS BIGINT)"
for _z, _n in zip(_Z, RL.SPARSE_LEVELS):
    _CODE = f"({_CODE}*{_n}+{_z})"
_SPARSE = f"""WITH pts AS (SELECT *, {_CODE} id FROM (SELECT DISTINCT
  instr('ANR', l_returnflag) flag, CAST(round(l_discount*100) AS INT) z0,
  CAST(round(l_tax*100) AS INT) z1, CAST(floor((l_quantity-1)/10) AS INT) z2, l_linenumber-1 z3,
  quarter(l_shipdate)-1 z4, isodow(l_shipdate)-1 z5, year(l_shipdate)%7 z6, l_suppkey%5 z7,
  l_partkey%5 z8, CAST(least(floor(l_extendedprice/20000), 5) AS INT) z9 FROM lineitem)),
 moves AS (SELECT -1 axis, 0 by_ UNION ALL SELECT * FROM range(0,5) a(axis), (VALUES (-1),(1)) b(by_)),
"""


def _near_half(axes: list[str]) -> str:
    """Pairs whose points differ by one step at most on five of the axes."""
    moved = " AND ".join(f"b.{z} = a.{z} + CASE WHEN axis={i} THEN by_ ELSE 0 END"
                         for i, z in enumerate(axes))
    dist = "+".join(f"abs(a.{z}-b.{z})" for z in _Z)
    return (f"SELECT a.flag, a.id src, b.id dst, {dist} dist FROM pts a CROSS JOIN moves "
            f"JOIN pts b ON a.flag=b.flag AND {moved} WHERE a.id <> b.id AND {dist} <= 3")


@register("d9_sparse_neighbours", "block:i src:i dst:i dist:i",
          "SELECT flag AS block, src, dst, dist FROM near", _SPARSE
          + f"near AS ({_near_half(_Z[:5])} UNION {_near_half(_Z[5:])})\n")
def d9_sparse(spark, sf):
    from plateauscope.plans.stages import stage
    cells = RL.sparse_cells(spark, sf).withColumn("flag", F.get("block", F.lit(0)))
    rings = [S.edges_at(cells, r, 10, stage, "flag") for r in (1, 2, 3)]
    return rings[0].unionByName(rings[1]).unionByName(rings[2]).withColumn("block", F.col("src_flag"))


@register("d10_adaptive_radius", "study_id:s cells:i radius:i median_support:d locality_cap:i",
          "SELECT * FROM radius", chain("radius"))
def d10(spark, sf):
    return audit(spark, sf).radius


@register("d11_slots_and_gaps", "study_id:s component:i row_idx:i slots:i support:i gaps:i", """
 SELECT r.study_id, component, r.row_idx, slots, support, greatest(0, slots-support) gaps FROM (
  SELECT r.study_id, component, r.row_idx, count(*) slots FROM reps r
   JOIN cells c ON c.study_id=r.study_id AND c.row_idx=r.row_idx
   JOIN radius rd ON rd.study_id=r.study_id, range(-3,4) x(a), range(-3,4) y(b), range(-3,4) z(d)
   WHERE abs(a)+abs(b)+abs(d) BETWEEN 1 AND radius AND z0+a BETWEEN 0 AND 10
    AND z1+b BETWEEN 0 AND 8 AND z2+d BETWEEN 0 AND 4 GROUP BY ALL) r
 JOIN rob ON rob.study_id=r.study_id AND rob.row_idx=r.row_idx""", chain("reps"))
def d11(spark, sf):
    return audit(spark, sf).slots()


def _uneven(spark, sf):
    """Order totals as a parameter with uneven steps: the distinct quantity x line levels."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    v = li.select(F.lit("lines").alias("study_id"), F.lit(0).alias("dim"), F.lit("q").alias("name"),
                  F.lit("number").alias("type"),
                  F.floor(F.pow(F.lit(1.25), F.col("l_quantity"))).alias("num")).distinct()
    from pyspark.sql import Window
    w = Window.partitionBy("study_id", "dim").orderBy("num")
    return v.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


@register("d12_grid_regularity", "ratio:d min_step:d max_step:d from_pos:i to_pos:i from_value:d "
          "to_value:d", """
 WITH v AS (SELECT DISTINCT floor(pow(1.25, l_quantity)) num FROM lineitem),
 s AS (SELECT num, row_number() OVER (ORDER BY num)-1 pos, lag(num) OVER (ORDER BY num) p FROM v),
 t AS (SELECT min(num-p) lo, max(num-p) hi FROM s WHERE num > p)
 SELECT hi/lo ratio, lo min_step, hi max_step, pos-1 from_pos, pos to_pos, p from_value, num to_value
 FROM s, t WHERE hi/lo >= 3 AND num-p >= 3*lo""")
def d12(spark, sf):
    return S.grid_regularity(_uneven(spark, sf))


@register("d13_axis_smoothness", "study_id:s dim:i smoothness:d lines:i", """
 SELECT study_id, dim, list_sort(list(r))[CAST(floor(count(*)/2.0) AS INT)+1] smoothness,
  count(*) lines FROM (
  SELECT study_id, dim, rest, (max(score)-min(score))/avg(j) r, count(*) n, avg(j) mj FROM (
   SELECT study_id, dim, rest, score, abs(score - lag(score) OVER (
     PARTITION BY study_id, dim, rest ORDER BY pos)) j FROM long WHERE viable AND score IS NOT NULL)
  GROUP BY ALL) WHERE n >= 3 AND mj > 1e-9 GROUP BY ALL HAVING count(*) >= 5""", chain("long"))
def d13(spark, sf):
    return S.axis_smoothness(audit(spark, sf).rows)


_pair = """(SELECT study_id, max(CASE WHEN k=1 THEN dim END) dim_a, max(CASE WHEN k=2 THEN dim END)
 dim_b FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY effective DESC, dim) k
 FROM roles WHERE n_levels > 1) WHERE k <= 2 GROUP BY 1)"""


@register("d14_top_pair", "study_id:s dim_a:i dim_b:i", f"SELECT * FROM {_pair}", chain("roles"))
def d14(spark, sf):
    return S.top_pair(audit(spark, sf).roles)


@register("d15_plane_slice", "study_id:s dim_a:i dim_b:i a:i b:i quality:d quality_oos:d", f"""
 SELECT c.study_id, dim_a, dim_b, [c.z0,c.z1,c.z2][dim_a+1] a, [c.z0,c.z1,c.z2][dim_b+1] b,
  c.quality_is quality, c.quality_oos
 FROM rows_ c JOIN {_pair} p ON p.study_id=c.study_id
 JOIN ranked r ON r.study_id=c.study_id AND r.rank=1
 JOIN cells q ON q.study_id=c.study_id AND q.row_idx=r.representative
 WHERE c.quality_is IS NOT NULL AND (dim_a=0 OR dim_b=0 OR c.z0=q.z0) AND
  (dim_a=1 OR dim_b=1 OR c.z1=q.z1) AND (dim_a=2 OR dim_b=2 OR c.z2=q.z2)""", chain("ranked"))
def d15(spark, sf):
    a = audit(spark, sf)
    first = a.plateaus.filter("rank = 1").select(
        "study_id", F.col("representative").alias("row_idx"))
    anchor = first.join(a.cells.select("study_id", "row_idx", "coords"), P.NODE)
    return S.plane_slice(a.rows, S.top_pair(a.roles), anchor)


@register("d15_plane_coverage", "study_id:s filled:i total:i coverage:d", f"""
 SELECT study_id, count(*) filled, any_value(la.n_levels*lb.n_levels) total,
  count(*)*1.0/any_value(la.n_levels*lb.n_levels) coverage
 FROM (SELECT c.study_id, dim_a, dim_b FROM rows_ c JOIN {_pair} p ON p.study_id=c.study_id
  JOIN ranked r ON r.study_id=c.study_id AND r.rank=1
  JOIN cells q ON q.study_id=c.study_id AND q.row_idx=r.representative
  WHERE c.quality_is IS NOT NULL AND (dim_a=0 OR dim_b=0 OR c.z0=q.z0) AND
   (dim_a=1 OR dim_b=1 OR c.z1=q.z1) AND (dim_a=2 OR dim_b=2 OR c.z2=q.z2)) s
 JOIN lc la USING (study_id) JOIN lc lb USING (study_id)
 WHERE la.dim=dim_a AND lb.dim=dim_b GROUP BY 1""", chain("ranked"))
def d15b(spark, sf):
    return S.plane_coverage(d15(spark, sf), audit(spark, sf).level_counts)


@register("d16_heat_grid", "study_id:s a:i b:i median_score:d n:i", f"""
 SELECT r.study_id, [z0,z1,z2][dim_a+1] a, [z0,z1,z2][dim_b+1] b, median(score) median_score,
  count(*) n FROM rows_ r JOIN {_pair} p ON p.study_id=r.study_id
 WHERE score IS NOT NULL GROUP BY ALL""", chain("roles"))
def d16(spark, sf):
    a = audit(spark, sf)
    return S.heat_grid(a.rows, S.top_pair(a.roles))


@register("d17_parameter_profile", "study_id:s dim:i pos:i q25:d median_score:d q75:d n:i", """
 SELECT study_id, dim, pos, quantile_cont(score,0.25) q25, median(score) median_score,
  quantile_cont(score,0.75) q75, count(*) n FROM long WHERE passes AND score IS NOT NULL
 GROUP BY ALL""", chain("long"))
def d17(spark, sf):
    return S.parameter_profile(audit(spark, sf).rows)


@register("d18_period_scatter", f"{R} layer:s quality_is:d quality_oos:d degrades:b", """
 SELECT c.study_id, c.row_idx, CASE WHEN m.row_idx IS NOT NULL THEN 'plateau'
  WHEN c.passes THEN 'pass' ELSE 'fail' END layer, quality_is, quality_oos,
  quality_oos < quality_is degrades FROM cells c
 LEFT JOIN members m ON m.study_id=c.study_id AND m.row_idx=c.row_idx
 WHERE quality_is IS NOT NULL AND quality_oos IS NOT NULL""", chain("members"))
def d18(spark, sf):
    a = audit(spark, sf)
    return S.period_scatter(a.cells, a.members)


@register("d18_degrading_share", "study_id:s degrading_share:d points:i", """
 SELECT study_id, avg(CASE WHEN quality_oos < quality_is THEN 1.0 ELSE 0 END) degrading_share,
  count(*) points FROM cells WHERE quality_is IS NOT NULL AND quality_oos IS NOT NULL GROUP BY 1""",
          chain("cells"))
def d18b(spark, sf):
    return S.degrading_share(audit(spark, sf).cells)


# ------------------------------------------------------------------ plateaus
@register("e1_local_stability", f"{R} support:i pass_count:i fail_count:i frac_pass:d q25:d q10:d "
          "median_nb:d worst:d cliff:d peak_z:d", "SELECT * FROM stab", chain("stab"))
def e1(spark, sf):
    a = audit(spark, sf)
    return P.local_stability(a.cells, a.edges, a.scale)


@register("e2_robustness", f"{R} robust:d", "SELECT * FROM rob", chain("rob"))
def e2(spark, sf):
    a = audit(spark, sf)
    return P.robustness(P.local_stability(a.cells, a.edges, a.scale), a.radius)


@register("e3_candidates", f"{R} robust:d core:b", "SELECT * FROM cand", chain("cand"))
def e3(spark, sf):
    t = P.threshold_columns(P.Thresholds())
    return audit(spark, sf).stability.filter(P.is_candidate(t)).withColumn("core", P.is_core(t))


@register("e4_plateau_members", f"{R} component:i size:i", "SELECT * FROM members",
          chain("members"))
def e4(spark, sf):
    return audit(spark, sf).members


@register("e5_core_members", f"{R} component:i q25:d robust:d", "SELECT * FROM members WHERE core",
          chain("members"))
def e5(spark, sf):
    return audit(spark, sf).members.filter("core")


_around = """(SELECT m.study_id, m.row_idx, m.component, any_value(m.robust) rb,
  least(any_value(m.score), coalesce(min(e.dst_score), any_value(m.score))) wa,
  (any_value(m.score) + coalesce(sum(e.dst_score),0)) / (count(e.dst)+1) ma,
  coalesce(count(*) FILTER (o.component = m.component)*1.0 / nullif(count(e.dst),0), 0) it
 FROM members m LEFT JOIN edges e ON e.study_id=m.study_id AND e.src=m.row_idx
 LEFT JOIN members o ON o.study_id=m.study_id AND o.row_idx=e.dst
 GROUP BY m.study_id, m.row_idx, m.component)"""


@register("e6_representative_maximin", "study_id:s component:i row_idx:i worst_around:d interior:d",
          f"""SELECT study_id, component, row_idx, wa worst_around, it interior FROM (SELECT *,
  row_number() OVER (PARTITION BY study_id, component ORDER BY wa DESC, it DESC, rb DESC, row_idx) k
  FROM {_around}) WHERE k=1""", chain("members"))
def e6(spark, sf):
    a = audit(spark, sf)
    return P.representative_maximin(a.members, a.edges)


@register("e7_representative_mean", "study_id:s component:i row_idx:i mean_around:d interior:d",
          f"""SELECT study_id, component, row_idx, ma mean_around, it interior FROM (SELECT *,
  row_number() OVER (PARTITION BY study_id, component ORDER BY ma DESC, it DESC, rb DESC, row_idx) k
  FROM {_around}) WHERE k=1""", chain("members"))
def e7(spark, sf):
    a = audit(spark, sf)
    return P.representative_mean(a.members, a.edges)


@register("e8_joint_rank", f"{R} joint_score:d", "SELECT * FROM joint", chain("joint"))
def e8(spark, sf):
    a = audit(spark, sf)
    return P.joint_rank(a.cells, a.edges)


@register("e8_representative_joint", "study_id:s component:i row_idx:i joint_score:d core_size:i",
          "SELECT * FROM reps", chain("reps"))
def e8b(spark, sf):
    return audit(spark, sf).representatives


@register("e9_extent", "study_id:s component:i volume:d typical_width:d occupancy:d "
          "effective_size:d widths:s", "SELECT * FROM ext", chain("ext"))
def e9(spark, sf):
    return audit(spark, sf).extent.withColumn("widths", join("widths"))


@register("e10_boundary_touch", "study_id:s component:i name:s at_min:b at_max:b", """
 SELECT study_id, component, name, at_min, at_max FROM (
  SELECT b.study_id, component, roles.name, bool_or(pos=0) at_min, bool_or(pos=n_levels-1) at_max
  FROM basis b JOIN long USING (study_id, row_idx) JOIN roles USING (study_id, dim)
  WHERE role <> 'flat' GROUP BY ALL) WHERE at_min OR at_max""", chain("basis"))
def e10(spark, sf):
    a = audit(spark, sf)
    sizes = a.members.groupBy("study_id", "component").agg(F.count_if("core").alias("cs"))
    basis = a.members.join(sizes, ["study_id", "component"]).filter("cs < 3 OR core")
    return P.boundary_touch(basis, a.cells, a.roles)


@register("e11_parameter_span", "study_id:s component:i name:s lo:d hi:d", """
 SELECT m.study_id, component, name, min(val) lo, max(val) hi FROM members m
 JOIN long USING (study_id, row_idx) GROUP BY ALL""", chain("members"))
def e11(spark, sf):
    a = audit(spark, sf)
    return P.parameter_span(a.members, a.passes)


@register("e12_plateau_summary", "study_id:s component:i size:i core_size:i worst_score:d "
          "q10_score:d median_score:d coherence:d median_is:d median_oos:d median_retention:d",
          "SELECT * FROM summ", chain("summ"))
def e12(spark, sf):
    a = audit(spark, sf)
    return P.plateau_summary(a.members, a.cells)


@register("e13_forward_validation", "study_id:s component:i with_forward:i pass_frac:d "
          "validated_frac:d", "SELECT * FROM fwd", chain("fwd"))
def e13(spark, sf):
    a = audit(spark, sf)
    return P.forward_validation(a.members, a.cells)


@register("e14_plateau_rank", "study_id:s component:i rank_score:d rank:i inverted:b",
          "SELECT * FROM ranked", chain("ranked"))
def e14(spark, sf):
    return audit(spark, sf).plateaus


@register("e16_ties", "study_id:s component:i rank:i tied:i", """
 SELECT * FROM (SELECT study_id, component, rank, count(*) OVER (PARTITION BY study_id) tied FROM (
  SELECT *, max(rank_score) OVER (PARTITION BY study_id) b FROM ranked)
  WHERE b > 0 AND rank_score >= b*0.95) WHERE tied > 1""", chain("ranked"))
def e16(spark, sf):
    return P.ties(audit(spark, sf).plateaus)


_peaks = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id
  ORDER BY criterion_rank) pk FROM (
  SELECT p.*, rob.support, rob.q25, rob.frac_pass, rob.cliff, rob.peak_z, rob.robust, rob.passes
  FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY key DESC, row_idx)
    criterion_rank FROM (SELECT study_id, row_idx, fails_oos, CASE WHEN has_forward
     THEN oos_profit ELSE is_profit END AS key,
     CASE WHEN has_forward THEN 'oos' ELSE 'is' END ranking_by FROM cells
     WHERE NOT has_forward OR known)) p
  JOIN rob USING (study_id, row_idx)
  ANTI JOIN members USING (study_id, row_idx) WHERE criterion_rank <= 80)) WHERE pk <= 12)"""


@register("e17_rejected_peaks", f"{R} ranking_by:s criterion_rank:i robust:d",
          f"SELECT * FROM {_peaks}", chain("members"))
def e17(spark, sf):
    return audit(spark, sf).peaks


@register("e18_rejection_reasons", f"{R} tags:s", f"""
 SELECT study_id, row_idx, CASE WHEN len(t) > 0 THEN array_to_string(t, ',')
  WHEN robust >= 50 THEN 'zone_too_small' ELSE 'low_robustness' END tags FROM (
 SELECT *, list_filter([CASE WHEN support < 4 THEN 'few_neighbours' END,
  CASE WHEN peak_z > 2 THEN 'isolated_peak' END, CASE WHEN cliff > 1.5 THEN 'cliff' END,
  CASE WHEN NOT passes OR len(fails_oos) > 0 THEN 'misses_limits' END,
  CASE WHEN frac_pass < 0.9 THEN 'failing_neighbours' END,
  CASE WHEN q25 < 0.42 THEN 'weak_neighbours' END], lambda x: x IS NOT NULL) t FROM {_peaks})""",
          chain("members"))
def e18(spark, sf):
    return audit(spark, sf).peaks.withColumn("tags", join("tags"))


@register("e19_period_inversions", "study_id:s dim:i rho:d regret:d swing_is:d swing_oos:d "
          "best_is:i", "SELECT * FROM inv", chain("inv"))
def e19(spark, sf):
    a = audit(spark, sf)
    return P.period_inversions(a.cells, a.levels, a.scale)


@register("e22_irregular_span", "study_id:s component:i irregular_names:s", """
 WITH j AS (SELECT study_id, dim, name, pos, val - lag(val) OVER (PARTITION BY study_id, dim
   ORDER BY pos) s FROM lv),
 k AS (SELECT study_id, dim, min(s) lo FROM j WHERE s > 0 GROUP BY ALL HAVING max(s) >= 3*min(s)),
 b AS (SELECT j.* FROM j JOIN k USING (study_id, dim) WHERE s >= 3*lo),
 o AS (SELECT DISTINCT m.study_id, component, dim, pos FROM members m
   JOIN long USING (study_id, row_idx))
 SELECT o.study_id, o.component, string_agg(DISTINCT b.name, ',') irregular_names FROM o
 JOIN b ON b.study_id=o.study_id AND b.dim=o.dim AND b.pos=o.pos
 JOIN o o2 ON o2.study_id=o.study_id AND o2.component=o.component AND o2.dim=o.dim
  AND o2.pos=o.pos-1 GROUP BY ALL""", chain("members"))
def e22(spark, sf):
    a = audit(spark, sf)
    return P.irregular_span(a.members, a.cells, a.jumps).withColumn(
        "irregular_names", join("irregular_names"))


@register("e23_fallback", f"{R} joint_score:d passes_joint:b", """
 SELECT * FROM (SELECT c.study_id, c.row_idx, joint_score, passes_joint, row_number() OVER (
  PARTITION BY c.study_id ORDER BY passes_joint DESC, joint_score DESC, c.row_idx) k
  FROM cells c JOIN joint USING (study_id, row_idx)
  WHERE has_forward AND (passes_joint OR (known AND passes)) AND study_id NOT IN
   (SELECT study_id FROM members)) WHERE k=1""", chain("joint"))
def e23(spark, sf):
    a = audit(spark, sf)
    return P.fallback(a.cells, a.joint, a.plateaus)


@register("e24_power_check", "study_id:s total:i gate_pass:i search_pass:i viable_needed:i "
          "underpowered:b", """
 SELECT *, NOT hasp AND search_pass > 0 AND search_pass < viable_needed underpowered FROM (
 SELECT c.study_id, count(*) total, count(*) FILTER (passes_joint) gate_pass,
  count(*) FILTER (passes) search_pass,
  ceil(3*(1+greatest(4, any_value(median_support))*0.9)) viable_needed,
  c.study_id IN (SELECT study_id FROM members) hasp
 FROM cells c JOIN radius USING (study_id) GROUP BY 1)""", chain("members"))
def e24(spark, sf):
    return audit(spark, sf).power


@register("e27_effective_trials", "study_id:s effective_trials:i", """
 SELECT study_id, greatest(2, count(DISTINCT [CASE WHEN a0 THEN z0//(radius+1) ELSE 0 END,
  CASE WHEN a1 THEN z1//(radius+1) ELSE 0 END, CASE WHEN a2 THEN z2//(radius+1) ELSE 0 END]))
  effective_trials FROM cells JOIN act USING (study_id) JOIN radius USING (study_id)
 GROUP BY 1""", chain("radius"))
def e27(spark, sf):
    return P.effective_trials(audit(spark, sf).coarse)


@register("e28_period_comparison", "study_id:s median_quality_is:d median_quality_oos:d pass_is:d "
          "pass_oos:d", """
 SELECT study_id, median(quality_is) median_quality_is, median(quality_oos) median_quality_oos,
  avg(CASE WHEN len(fails_is)=0 THEN 1.0 ELSE 0 END) pass_is,
  avg(CASE WHEN len(fails_oos)=0 THEN 1.0 ELSE 0 END) pass_oos FROM cells WHERE known
 GROUP BY 1""", chain("cells"))
def e28(spark, sf):
    return P.period_comparison(audit(spark, sf).cells)


@register("e29_alternatives", "study_id:s component:i rank:i size:i safe_alternative:b",
          "SELECT *, false safe_alternative FROM ranked WHERE rank <= 3", chain("ranked"))
def e29(spark, sf):
    return P.alternatives(audit(spark, sf).plateaus)


@register("e29_stable_ranges", "study_id:s component:i name:s lo:d hi:d influence_rank:i", """
 SELECT r.study_id, r.component, q.name, min(val) lo, max(val) hi, any_value(k) influence_rank
 FROM ranked r JOIN members m ON m.study_id=r.study_id AND m.component=r.component
 JOIN long l ON l.study_id=m.study_id AND l.row_idx=m.row_idx
 JOIN (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY effective DESC, dim) k FROM roles)
  q ON q.study_id=r.study_id AND q.dim=l.dim WHERE r.rank=1 GROUP BY ALL""", chain("ranked"))
def e29b(spark, sf):
    a = audit(spark, sf)
    return P.stable_ranges(a.plateaus, P.parameter_span(a.members, a.passes), a.roles)
