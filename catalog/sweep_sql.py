"""The audit of the derived sweep as a chain of SQL common table expressions."""

METRICS = ("profit", "profit_factor", "recovery_factor", "sharpe", "drawdown", "trades",
           "expected_payoff")

_STEPS: list[tuple[str, str]] = []


def step(name: str, body: str) -> None:
    _STEPS.append((name, body))


def chain(last: str) -> str:
    """WITH clause up to and including ``last``."""
    names = [n for n, _ in _STEPS]
    upto = _STEPS[:names.index(last) + 1]
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS MATERIALIZED ({b})" if not n.startswith("r_") else f"{n.split(':')[0]} AS ({b})"
        for n, b in upto) + "\n"


step("cfg", """
 SELECT count(*) AS n, CAST(round(800000 * sqrt(count(*))) AS BIGINT) AS capital,
        CAST(greatest(4, count(*) // 1500) AS DOUBLE) AS mt FROM lineitem""")
step("t", """
 SELECT CAST(round(l_discount*100) AS INT) p0, CAST(round(l_tax*100) AS INT) p1,
  CAST(floor((l_quantity-1)/10) AS INT) p2,
  CASE WHEN l_shipdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'is' ELSE 'oos' END period,
  l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  CAST(round(l_extendedprice*100) AS BIGINT) px FROM lineitem""")
step("u", """
 SELECT v.study_id, t.*, px - v.offs + v.bump * greatest(0, 6-abs(p0-5)-abs(p1-4)-abs(p2-2)) pnl
 FROM t, (VALUES ('bump', 6000000, 500000), ('noise', 6000000, 0), ('loser', 9000000, 0))
   v(study_id, offs, bump)
 UNION ALL SELECT 'flip', t.*, px - 6000000 + 600000 * greatest(0, 6-abs(p0 -
  CASE WHEN period='is' THEN 3 ELSE 9 END)) FROM t""")
step("e", """
 SELECT *, sum(pnl) OVER (PARTITION BY study_id,p0,p1,p2,period
   ORDER BY l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,pnl
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) eq FROM u""")
step("f", """
 SELECT *, greatest(0, max(eq) OVER (PARTITION BY study_id,p0,p1,p2,period
   ORDER BY l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,pnl
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) pk FROM e""")
step("m0", """
 SELECT study_id, p0, p1, p2, period, CAST(count(*) AS DOUBLE) trades, sum(pnl)/100.0 profit,
  coalesce(CAST(sum(greatest(pnl,0)) AS DOUBLE) / nullif(-sum(least(pnl,0)),0), 99) profit_factor,
  max(100 * CAST(pk-eq AS DOUBLE) / (pk + (SELECT capital FROM cfg))) drawdown,
  coalesce(CAST(sum(pnl) AS DOUBLE) / nullif(max(pk-eq),0), 99) recovery_factor,
  avg(pnl) / nullif(stddev_samp(pnl),0) * sqrt(count(*)) sharpe,
  avg(pnl)/100.0 expected_payoff
 FROM f GROUP BY ALL""")
step("m", """
 SELECT * FROM m0 UNION ALL
 SELECT * REPLACE ('solo' AS study_id) FROM m0 WHERE study_id='bump' AND period='is' UNION ALL
 SELECT * REPLACE ('partial' AS study_id) FROM m0
  WHERE study_id='bump' AND (period='is' OR (p0+p1+p2) % 3 <> 0)""")
_wide = ", ".join(f"max({k}) FILTER (period='{p}') {p}_{k}" for p in ("is", "oos")
                  for k in METRICS)
step("passes", f"""
 SELECT study_id, p0*45+p1*5+p2 row_idx, CAST(p0*45+p1*5+p2+1 AS VARCHAR) pass_id, p0, p1, p2,
  {_wide}, count(*) FILTER (period='oos') > 0 oos_known
 FROM m GROUP BY study_id, p0, p1, p2 HAVING count(*) FILTER (period='is') > 0""")
step("ratio", """
 SELECT study_id, CASE WHEN count(*) >= 10
   THEN list_sort(list(oos_trades/is_trades))[CAST(floor(count(*)/2.0) AS INT)+1] END pr
 FROM passes WHERE oos_trades IS NOT NULL AND is_trades > 0 GROUP BY 1""")
step("studies", """
 SELECT s.*, pr, mt, CASE WHEN has_forward AND pr IS NOT NULL
   THEN ceil(greatest(30, mt*pr)) ELSE mt END mt_oos,
  CASE WHEN has_forward THEN 'is_then_oos' ELSE 'is_only' END mode
 FROM (SELECT study_id, count(*) total, bool_or(oos_known) has_forward FROM passes GROUP BY 1) s
 LEFT JOIN ratio USING (study_id), cfg""")


def quality(p: str, ratio: str, dd: str, rf: str) -> str:
    """SQL of the period score with the anchors of the default limits (PF 1.2, DD 20)."""
    lin = lambda v, z, f: f"least(1.0, greatest(0.0, ({v} - {z}) / ({f} - {z})))"
    zero = f"(greatest(5, mt*0.5) * {ratio})"
    full = f"(mt*5 * {ratio})"
    tr = (f"CASE WHEN {p}_trades IS NULL OR {p}_trades <= 0 THEN 0.0 ELSE least(1.0, greatest("
          f"0.0, ln({p}_trades/{zero}) / ln({full}/{zero}))) END")
    lf = lambda s: f"ln(greatest(0.02, {s}))"
    parts = [(0.30, [(1.0, f"{p}_profit_factor", lin(f"{p}_profit_factor", 1.0, 1.5))]),
             (0.35, [(1.0, dd, lin(dd, 30.0, 5.0))]),
             (0.25, [(0.6, rf, lin(rf, 0.0, 3.0)),
                     (0.4, f"{p}_sharpe", lin(f"{p}_sharpe", 0.0, 2.5))])]
    w, s = ["0.1"], [f"0.1 * {lf(tr)}"]
    for aw, ms in parts:
        there = " OR ".join(f"{c} IS NOT NULL" for _, c, _ in ms)
        iw = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {x} ELSE 0 END" for x, c, _ in ms)
        il = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {x} * {lf(e)} ELSE 0 END"
                        for x, c, e in ms)
        w.append(f"CASE WHEN {there} THEN {aw} ELSE 0 END")
        s.append(f"CASE WHEN {there} THEN {aw} * ({il}) / ({iw}) ELSE 0 END")
    return (f"CASE WHEN {p}_profit <= 0 THEN 0.0 ELSE exp(({' + '.join(s)}) / "
            f"({' + '.join(w)})) END")


def gates(p: str, mt: str) -> str:
    return (f"list_filter([CASE WHEN {p}_profit <= 0 THEN 'profit' END, "
            f"CASE WHEN {p}_profit_factor < 1.2 THEN 'profit_factor' END, "
            f"CASE WHEN {p}_drawdown > 20 THEN 'drawdown' END, "
            f"CASE WHEN {p}_trades < {mt} THEN 'trades' END], lambda x: x IS NOT NULL)")


_rc = "least(20.0, greatest(0.05, pr))"
step("scored0", f"""
 SELECT *, has_forward AND oos_known AS known,
  {quality('is', '1.0', 'is_drawdown', 'is_recovery_factor')} quality_is,
  CASE WHEN has_forward AND oos_known THEN
   {quality('oos', f"coalesce({_rc}, 1.0)", 'oos_drawdown', 'oos_recovery_factor')} END quality_oos,
  CASE WHEN has_forward AND oos_known THEN
   {quality('oos', f"coalesce({_rc}, 1.0)",
            f"(CASE WHEN pr IS NULL THEN oos_drawdown ELSE least(100.0, oos_drawdown/sqrt({_rc})) END)",
            f"(CASE WHEN pr IS NULL THEN oos_recovery_factor ELSE oos_recovery_factor/sqrt({_rc}) END)")}
   END quality_oos_adjusted,
  {gates('is', 'mt')} fails_is,
  CASE WHEN has_forward AND oos_known THEN {gates('oos', 'mt_oos')} ELSE [] END fails_oos
 FROM passes JOIN studies USING (study_id)""")
step("scored", """
 SELECT *, CASE WHEN has_forward THEN least(quality_is, quality_oos) ELSE quality_is END
   quality_combined,
  quality_is AS score,
  CASE WHEN known AND quality_is > 0 THEN quality_oos/quality_is END retention,
  len(fails_is)=0 AS passes_discover,
  len(fails_is)=0 AND (NOT has_forward OR (known AND len(fails_oos)=0)) AS passes_joint,
  CASE WHEN has_forward THEN len(fails_is)=0
       ELSE len(fails_is)=0 END AS passes
 FROM scored0""")
step("popn", """
 SELECT study_id, CASE WHEN count(*) FILTER (passes AND score IS NOT NULL) >= 30 THEN 'passing'
  WHEN count(*) FILTER (score > 0) >= 30 THEN 'positive' ELSE 'all' END population
 FROM scored GROUP BY 1""")
step("rows_", """
 SELECT *, coalesce(CASE population WHEN 'passing' THEN passes WHEN 'positive' THEN score > 0
   ELSE true END, false) viable,
  dense_rank() OVER (PARTITION BY study_id ORDER BY p0)-1 z0,
  dense_rank() OVER (PARTITION BY study_id ORDER BY p1)-1 z1,
  dense_rank() OVER (PARTITION BY study_id ORDER BY p2)-1 z2
 FROM scored JOIN popn USING (study_id)""")
step("vmed", """SELECT study_id, median(score) md, count(*) n,
  quantile_cont(score, 0.75) - quantile_cont(score, 0.25) iq
 FROM rows_ WHERE viable AND score IS NOT NULL GROUP BY 1""")
step("scale", """
 SELECT study_id, greatest(0.02, any_value(iq)) iqr, any_value(n) population_n,
  greatest(0.01, CASE WHEN any_value(n) >= 2 THEN 1.4826*median(abs(score-md)) ELSE 0 END) mad
 FROM rows_ JOIN vmed USING (study_id) WHERE viable AND score IS NOT NULL GROUP BY 1""")
step("long", """
 SELECT study_id, row_idx, score, passes, viable, known, has_forward, quality_is, quality_oos,
  passes_discover, d.dim, ['p0','p1','p2'][d.dim+1] AS name,
  [z0,z1,z2][d.dim+1] pos, [p0,p1,p2][d.dim+1] val,
  CASE d.dim WHEN 0 THEN [z1,z2] WHEN 1 THEN [z0,z2] ELSE [z0,z1] END rest
 FROM rows_, (VALUES (0),(1),(2)) d(dim)""")
step("lv", "SELECT DISTINCT study_id, dim, name, pos, val FROM long")
step("lc", "SELECT study_id, dim, name, count(*) n_levels FROM lv GROUP BY ALL")
step("marg", """
 SELECT lc.study_id, lc.dim, lc.name, n_levels, coalesce(swing, 0)/iqr marginal FROM lc
 JOIN scale USING (study_id) LEFT JOIN (
  SELECT study_id, dim, CASE WHEN count(*)>=2 THEN max(md)-min(md) ELSE 0 END swing FROM (
   SELECT study_id, dim, pos, median(score) md, count(*) c FROM long
   WHERE viable AND score IS NOT NULL GROUP BY ALL) WHERE c >= 3 GROUP BY ALL) s
 ON s.study_id=lc.study_id AND s.dim=lc.dim""")
step("cond", """
 SELECT lc.study_id, lc.dim, coalesce(g, 0) conditional_groups,
  CASE WHEN g >= 5 THEN md/iqr END conditional FROM lc JOIN scale USING (study_id) LEFT JOIN (
  SELECT study_id, dim, median(swing) md, count(*) g FROM (
   SELECT study_id, dim, rest, max(score)-min(score) swing, count(*) c FROM long
   WHERE viable AND score IS NOT NULL GROUP BY ALL) WHERE c >= 2 GROUP BY ALL) s
 ON s.study_id=lc.study_id AND s.dim=lc.dim""")
step("roles", """
 SELECT *, CASE WHEN effective >= 0.12 THEN 'distance'
   WHEN NOT bool_or(effective >= 0.12) OVER (PARTITION BY study_id) AND
     row_number() OVER (PARTITION BY study_id ORDER BY effective DESC, dim) <= 2 THEN 'distance'
   ELSE 'flat' END AS role,
  marginal < 0.12 AND effective >= 0.12 AS rescued FROM (
  SELECT marg.*, conditional, conditional_groups, greatest(marginal, coalesce(conditional,0))
   effective FROM marg JOIN cond USING (study_id, dim))""")
step("act", """SELECT study_id, bool_or(dim=0 AND role='distance') a0,
  bool_or(dim=1 AND role='distance') a1, bool_or(dim=2 AND role='distance') a2
 FROM roles GROUP BY 1""")
step("cells", """
 SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY study_id,c0,c1,c2) cell_rows,
  row_number() OVER (PARTITION BY study_id,c0,c1,c2
   ORDER BY passes DESC, oos_known DESC, coalesce(score,0) DESC, row_idx) rn FROM (
  SELECT rows_.*, CASE WHEN a0 THEN z0 ELSE 0 END c0, CASE WHEN a1 THEN z1 ELSE 0 END c1,
   CASE WHEN a2 THEN z2 ELSE 0 END c2 FROM rows_ JOIN act USING (study_id))) WHERE rn = 1""")
step("pairs", """
 SELECT a.study_id, a.row_idx src, b.row_idx dst, b.score dst_score, b.passes dst_passes,
  abs(a.c0-b.c0)+abs(a.c1-b.c1)+abs(a.c2-b.c2) dist
 FROM cells a JOIN cells b ON a.study_id=b.study_id AND a.row_idx<>b.row_idx
 WHERE abs(a.c0-b.c0)+abs(a.c1-b.c1)+abs(a.c2-b.c2) <= 3""")
step("sup", """
 SELECT c.study_id, c.row_idx, count(dst) FILTER (dist<=1) s1, count(dst) FILTER (dist<=2) s2,
  count(dst) FILTER (dist<=3) s3 FROM cells c LEFT JOIN pairs ON pairs.study_id=c.study_id
  AND src=row_idx GROUP BY ALL""")
step("medsup", """SELECT study_id, count(*) cells, greatest(4, floor(count(*)*0.05)) cap,
  median(s1) m1, median(s2) m2, median(s3) m3 FROM sup GROUP BY 1""")
step("radius", """
 SELECT study_id, cells, CAST(cap AS BIGINT) locality_cap, radius,
  CASE radius WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END median_support FROM (
  SELECT *, CASE WHEN m1 >= 8 OR m2 > cap THEN 1 WHEN m2 >= 8 OR m3 > cap THEN 2 ELSE 3 END radius
  FROM medsup)""")
step("edges", """SELECT pairs.* FROM pairs JOIN radius USING (study_id) WHERE dist <= radius""")
step("nb", """
 SELECT study_id, src row_idx, count(*) support, count(*) FILTER (dst_passes) pass_count,
  quantile_cont(dst_score,0.25) q25, quantile_cont(dst_score,0.1) q10, median(dst_score) median_nb,
  min(dst_score) worst, count(dst_score) k FROM edges GROUP BY ALL""")
step("nbmad", """
 SELECT edges.study_id, src row_idx, CASE WHEN count(dst_score)>=2
  THEN 1.4826*median(abs(dst_score-median_nb)) ELSE 0 END lm
 FROM edges JOIN nb ON nb.study_id=edges.study_id AND nb.row_idx=src GROUP BY ALL""")
step("stab", """
 SELECT c.study_id, c.row_idx, c.score, c.passes, coalesce(support,0) support,
  coalesce(pass_count,0) pass_count, coalesce(support,0)-coalesce(pass_count,0) fail_count,
  pass_count*1.0/support frac_pass, q25, q10, median_nb, worst,
  greatest(0, c.score-worst)/iqr cliff,
  (c.score-median_nb)/greatest(lm, 0.5*mad) peak_z
 FROM cells c LEFT JOIN nb ON nb.study_id=c.study_id AND nb.row_idx=c.row_idx
 LEFT JOIN nbmad ON nbmad.study_id=c.study_id AND nbmad.row_idx=c.row_idx
 JOIN scale ON scale.study_id=c.study_id""")
step("rob", """
 SELECT stab.*, CASE WHEN score IS NOT NULL AND q25 IS NOT NULL THEN CASE WHEN passes THEN
  100 * pow(greatest(0,score),0.3) * pow(greatest(0,q25),0.4) * pow(coalesce(frac_pass,0),0.3)
  / (1+greatest(0, coalesce(cliff,0)-1.5)) / (1+greatest(0, coalesce(peak_z,0)-2))
  * least(1, support/(CASE WHEN median_support>0 THEN least(8.0, greatest(4.0, median_support))
     ELSE 8.0 END)) ELSE 0 END END robust
 FROM stab JOIN radius USING (study_id)""")
step("cand", """
 SELECT *, coalesce(q25 >= 0.58 AND robust >= 65, false) core FROM rob
 WHERE passes AND support >= 4 AND q25 >= 0.42 AND frac_pass >= 0.9 AND robust >= 50""")
step("ce", """SELECT e.study_id, src, dst FROM edges e
 JOIN cand a ON a.study_id=e.study_id AND a.row_idx=src
 JOIN cand b ON b.study_id=e.study_id AND b.row_idx=dst""")
step("r_reach", """
 SELECT study_id, row_idx AS node, row_idx AS root FROM cand
 UNION SELECT ce.study_id, ce.dst, r_reach.root FROM r_reach
  JOIN ce ON ce.study_id=r_reach.study_id AND ce.src=r_reach.node""")
step("comp", "SELECT study_id, node row_idx, min(root) component FROM r_reach GROUP BY ALL")
step("members", """
 SELECT * FROM (SELECT cand.*, component, count(*) OVER (PARTITION BY cand.study_id, component)
  size FROM cand JOIN comp USING (study_id, row_idx)) WHERE size >= 3""")
step("fr", """
 SELECT study_id, row_idx,
  CASE WHEN quality_is IS NULL THEN 0 ELSE ((rank() OVER w1 - 1) + (count(*) OVER
    (PARTITION BY study_id, quality_is) - 1)/2.0)
    / nullif(count(quality_is) OVER (PARTITION BY study_id) - 1, 0) END r_is,
  CASE WHEN quality_oos IS NULL OR NOT known THEN 0 ELSE ((rank() OVER w2 - 1) + (count(*) OVER
    (PARTITION BY study_id, quality_oos) - 1)/2.0)
    / nullif(count(quality_oos) OVER (PARTITION BY study_id) - 1, 0) END r_oos
 FROM cells WINDOW w1 AS (PARTITION BY study_id ORDER BY quality_is NULLS LAST),
  w2 AS (PARTITION BY study_id ORDER BY quality_oos NULLS LAST)""")
step("joint", """
 SELECT x.study_id, x.row_idx, avg(r_is + r_oos) joint_score FROM (
  SELECT study_id, src row_idx, dst FROM edges
  UNION ALL SELECT study_id, row_idx, row_idx FROM cells) x
 JOIN fr ON fr.study_id=x.study_id AND fr.row_idx=x.dst GROUP BY ALL""")
step("basis", """
 SELECT m.*, known, joint_score, core_size FROM members m
 JOIN (SELECT study_id, component, count(*) FILTER (core) core_size FROM members GROUP BY ALL) k
  USING (study_id, component)
 JOIN joint USING (study_id, row_idx)
 JOIN (SELECT study_id, row_idx, known FROM cells) c USING (study_id, row_idx)
 WHERE core_size < 3 OR core""")
step("reps", """
 SELECT * FROM (SELECT study_id, component, row_idx, joint_score, core_size,
  row_number() OVER (PARTITION BY study_id, component
   ORDER BY known DESC, joint_score DESC, row_idx) rn FROM basis) WHERE rn=1""")
step("summ", """
 SELECT m.study_id, component, count(*) size, count(*) FILTER (core) core_size,
  min(m.score) worst_score, quantile_cont(m.score,0.1) q10_score, median(m.score) median_score,
  quantile_cont(m.score,0.75)-quantile_cont(m.score,0.25) coherence,
  median(quality_is) median_is, median(quality_oos) median_oos, median(retention) median_retention
 FROM members m JOIN cells c ON c.study_id=m.study_id AND c.row_idx=m.row_idx GROUP BY ALL""")
step("ext0", """
 SELECT m.study_id, component, dim, min(pos) lo, max(pos) hi, count(DISTINCT pos) levels,
  count(*) size FROM members m JOIN long USING (study_id, row_idx)
 JOIN roles USING (study_id, dim) WHERE role='distance' GROUP BY ALL""")
step("ext", """
 SELECT study_id, component, least(product(hi-lo+1), 1e12) volume,
  exp(avg(ln(hi-lo+1))) typical_width, max(size) size, max(size)/product(hi-lo+1) occupancy,
  greatest(1, least(max(size), product(hi-lo+1))) effective_size,
  string_agg(hi-lo+1, ',' ORDER BY dim) widths
 FROM ext0 GROUP BY ALL""")
step("fwd", """
 SELECT m.study_id, component, count(*) FILTER (known) with_forward,
  CASE WHEN bool_or(has_forward) THEN coalesce(count(*) FILTER (known AND len(fails_oos)=0)
    / nullif(count(*) FILTER (known), 0), 0) END pass_frac,
  CASE WHEN bool_or(has_forward) THEN count(*) FILTER (known AND len(fails_oos)=0)
    / count(*) END validated_frac
 FROM members m JOIN cells c ON c.study_id=m.study_id AND c.row_idx=m.row_idx GROUP BY ALL""")
step("inv0", """
 SELECT study_id, dim, pos, median(CASE WHEN known THEN quality_is END) m_is,
  median(quality_oos) m_oos, count(CASE WHEN known THEN quality_is END) n_is,
  count(quality_oos) n_oos
 FROM long JOIN (SELECT study_id, row_idx FROM cells) USING (study_id, row_idx)
 WHERE has_forward GROUP BY ALL HAVING n_is >= 10 AND n_oos >= 10""")
step("invunit", """
 SELECT study_id, CASE WHEN n >= 30 THEN greatest(0.02, iq) ELSE iqr END unit FROM scale
 LEFT JOIN (SELECT study_id, count(*) n,
   quantile_cont(quality_is,0.75)-quantile_cont(quality_is,0.25) iq
  FROM cells WHERE known AND passes_discover GROUP BY 1) q USING (study_id)""")
step("inv", """
 SELECT * FROM (SELECT study_id, dim, max(m_is)-min(m_is) swing_is, max(m_oos)-min(m_oos) swing_oos,
  max_by(pos, m_is) best_is, max(m_oos) - max_by(m_oos, m_is) regret,
  count(*) levels, coalesce(corr(r1, r2), 0) rho
 FROM (SELECT *, row_number() OVER (PARTITION BY study_id, dim ORDER BY m_is, pos) r1,
   row_number() OVER (PARTITION BY study_id, dim ORDER BY m_oos, pos) r2 FROM inv0)
 GROUP BY ALL) JOIN invunit USING (study_id)
 WHERE levels >= 2 AND swing_is >= 0.25*unit AND regret >= 0.25*unit""")
step("invrep", """
 SELECT DISTINCT r.study_id, r.component FROM reps r JOIN cells c ON c.study_id=r.study_id
  AND c.row_idx=r.row_idx JOIN inv i ON i.study_id=r.study_id
 WHERE [c.z0,c.z1,c.z2][i.dim+1]=i.best_is""")
step("ranked", """
 SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY rank_score DESC, component) AS rank
 FROM (SELECT s.*, r.row_idx representative, rob.support, rob.robust, effective_size, with_forward,
  pass_frac, validated_frac, v.component IS NOT NULL inverted,
  greatest(0,q10_score) * ln(1+effective_size)
   * (0.6+0.4*least(1, ln(1+rob.support)/ln(25)))
   * (CASE WHEN v.component IS NOT NULL THEN 0.75 ELSE 1 END)
   * (CASE WHEN validated_frac IS NULL THEN 1 ELSE 0.35+0.65*validated_frac END) rank_score
 FROM summ s JOIN reps r USING (study_id, component) JOIN ext USING (study_id, component)
 JOIN fwd USING (study_id, component)
 JOIN rob ON rob.study_id=s.study_id AND rob.row_idx=r.row_idx
 LEFT JOIN invrep v ON v.study_id=s.study_id AND v.component=s.component)""")


def draw_steps(p: str, draws: str, cand: str) -> None:
    """Steps ``{p}*`` from perturbed candidates to the tally of the draws.

    ``draws``: (draw_id, ...). ``cand``: (study_id, draw_id, row_idx, score, support, core, ok, min_size).
    """
    k = "study_id, draw_id, component"
    step(f"{p}draws", draws)
    step(f"{p}cand", cand)
    step(f"{p}ce", f"""SELECT a.draw_id, e.study_id, src, dst FROM edges e
 JOIN {p}cand a ON a.study_id=e.study_id AND a.row_idx=src
 JOIN {p}cand b ON b.study_id=e.study_id AND b.row_idx=dst AND b.draw_id=a.draw_id""")
    step(f"r_{p}reach", f"""
 SELECT study_id, draw_id, row_idx AS node, row_idx AS root FROM {p}cand
 UNION SELECT c.study_id, c.draw_id, c.dst, r.root FROM r_{p}reach r
  JOIN {p}ce c ON c.study_id=r.study_id AND c.draw_id=r.draw_id AND c.src=r.node""")
    step(f"{p}comp", f"""SELECT study_id, draw_id, node row_idx, min(root) component
 FROM r_{p}reach GROUP BY ALL""")
    step(f"{p}mem", f"""
 SELECT * FROM (SELECT c.*, component, count(*) OVER (PARTITION BY c.study_id, c.draw_id, component)
  size FROM {p}cand c JOIN {p}comp USING (study_id, draw_id, row_idx)) WHERE size >= min_size""")
    step(f"{p}basis", f"""
 SELECT m.*, known, joint_score FROM {p}mem m
 JOIN (SELECT {k}, count(*) FILTER (core) core_size FROM {p}mem GROUP BY ALL) q USING ({k})
 JOIN joint USING (study_id, row_idx)
 JOIN (SELECT study_id, row_idx, known FROM cells) c USING (study_id, row_idx)
 WHERE core_size < 3 OR core""")
    step(f"{p}reps", f"""
 SELECT * FROM (SELECT {k}, row_idx, support, row_number() OVER (PARTITION BY {k}
   ORDER BY known DESC, joint_score DESC, row_idx) rn FROM {p}basis) WHERE rn=1""")
    step(f"{p}ext", f"""
 SELECT {k}, greatest(1, least(max(size), product(hi-lo+1))) effective_size FROM (
  SELECT {k}, dim, min(pos) lo, max(pos) hi, count(*) size FROM {p}mem JOIN long USING (study_id, row_idx)
  JOIN roles USING (study_id, dim) WHERE role='distance' GROUP BY ALL) GROUP BY ALL""")
    step(f"{p}summ", f"""
 SELECT {k}, quantile_cont(m.score,0.1) q10_score, CASE WHEN bool_or(has_forward)
   THEN count(*) FILTER (ok) / count(*) END validated_frac
 FROM {p}mem m JOIN (SELECT study_id, row_idx, has_forward FROM cells) c USING (study_id, row_idx)
 GROUP BY ALL""")
    step(f"{p}inv", f"""
 SELECT DISTINCT r.study_id, r.draw_id, r.component FROM {p}reps r JOIN cells c
  ON c.study_id=r.study_id AND c.row_idx=r.row_idx JOIN inv i ON i.study_id=r.study_id
 WHERE [c.z0,c.z1,c.z2][i.dim+1]=i.best_is""")
    step(f"{p}win", f"""
 SELECT study_id, draw_id, row_idx FROM (SELECT s.study_id, s.draw_id, r.row_idx, row_number() OVER (
   PARTITION BY s.study_id, s.draw_id ORDER BY greatest(0,q10_score) * ln(1+effective_size)
   * (0.6+0.4*least(1, ln(1+support)/ln(25))) * (CASE WHEN v.component IS NOT NULL THEN 0.75 ELSE 1 END)
   * (CASE WHEN validated_frac IS NULL THEN 1 ELSE 0.35+0.65*validated_frac END) DESC, s.component) rk
  FROM {p}summ s JOIN {p}reps r USING ({k}) JOIN {p}ext USING ({k})
  LEFT JOIN {p}inv v USING ({k})) WHERE rk = 1""")
    step(f"{p}tally", f"""
 SELECT b.study_id, n AS draws, count(w.draw_id) with_plateau, count(m.row_idx) same_region,
  count(*) FILTER (w.row_idx = b.representative) same_representative, count(w.draw_id)/n plateau_rate,
  count(m.row_idx)/n region_rate, count(*) FILTER (w.row_idx = b.representative)/n representative_rate
 FROM (SELECT study_id, component, representative FROM ranked WHERE rank=1) b
 CROSS JOIN (SELECT count(*) n FROM {p}draws)
 LEFT JOIN {p}win w ON w.study_id=b.study_id
 LEFT JOIN members m ON m.study_id=b.study_id AND m.component=b.component AND m.row_idx=w.row_idx
 GROUP BY b.study_id, n""")
