"""Ingest, integrity and export queries over exports written from the derived sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateauscope.functions import parsing as X
from plateauscope.operators import integrity as I
from plateauscope.operators import quality as Q
from plateauscope.operators import refine
from plateauscope.operators import space as S
from plateauscope.operators import verdict as V
from plateauscope.plans import relations as R
from plateauscope.plans.stages import memo, scratch_path
from plateauscope.sources import export as E
from plateauscope.sources import ingest as G

from .base import audit, register
from .evidence import simple_metrics
from .sweep_sql import chain

HEADERS = ("Pass", "Result", "Profit", "Profit Factor", "Equity DD %", "Trades", "Comment",
           "p0", "p1", "p2", "Mode", "Flag")
FORWARD = ("Pass", "Forward Result", "Profit", "Profit Factor", "Equity DD %", "Trades",
           "Back Result", "p0", "p1", "p2", "Mode", "Flag")

# Exported rows with planted defects: duplicate and missing ids, damaged numbers, a changed
# Result, a table loaded twice, losers left out of the optimised table.
_EX = chain("passes").rstrip() + """,
px AS MATERIALIZED (SELECT *, CAST(round(is_profit*100) AS BIGINT) a, CAST(round(oos_profit*100) AS BIGINT) b,
  CAST(round(is_profit_factor*10000) AS BIGINT) apf, CAST(round(oos_profit_factor*10000) AS BIGINT) bpf,
  CAST(round(is_drawdown*100) AS BIGINT) ad, CAST(round(oos_drawdown*100) AS BIGINT) bd FROM passes),
st AS MATERIALIZED (SELECT study_id sid, * EXCLUDE (study_id) FROM px
  UNION ALL SELECT 'twin', * EXCLUDE (study_id) FROM px WHERE study_id='bump'
  UNION ALL SELECT 'winners', * EXCLUDE (study_id) FROM px WHERE study_id='bump'),
isr AS MATERIALIZED (SELECT sid study_id, row_idx, CASE WHEN sid='flip' AND row_idx % 100 = 7 THEN row_idx ELSE row_idx+1 END id,
  a profit, apf pf, ad dd, CASE WHEN sid='noise' AND row_idx=3 OR sid='loser' AND row_idx % 50 = 0
   THEN 9000000000000000 ELSE CAST(is_trades AS BIGINT) END trades, p0, p1, p2 FROM st WHERE sid <> 'winners' OR a > 0),
oosr AS MATERIALIZED (SELECT sid study_id, row_idx, CASE WHEN sid='winners' AND a <= 0 THEN NULL ELSE row_idx+1 END id,
  CASE WHEN sid='twin' THEN a ELSE b END profit, CASE WHEN sid='twin' THEN apf ELSE bpf END pf,
  CASE WHEN sid='twin' THEN ad ELSE bd END dd, CAST(CASE WHEN sid='twin' THEN is_trades ELSE oos_trades END AS BIGINT) trades,
  CASE WHEN sid='partial' AND row_idx % 100 = 5 THEN a+100 ELSE a END back, p0, p1, p2 FROM st WHERE oos_known),
ids AS MATERIALIZED (SELECT study_id, 'is' AS period, row_idx, id FROM isr UNION ALL SELECT study_id, 'oos', row_idx, id FROM oosr)
"""


def cells(spark, sf):
    """Long cells of every exported table of the sweep."""
    def build():
        p = R.sweep(spark, sf)
        p = p.unionByName(p.filter("study_id = 'bump'").withColumn("study_id", F.lit("twin"))
                          ).unionByName(p.filter("study_id = 'bump'").withColumn(
            "study_id", F.lit("winners")))
        sid, row = F.col("study_id"), F.col("row_idx")
        par = [F.col("params")[i]["txt"] for i in range(3)]
        num = [F.col("params")[i]["num"] for i in range(3)]
        cents = lambda m: F.round(F.col(m)["profit"] * 100).cast("long")
        figures = lambda m: [cents(m), F.round(F.col(m)["profit_factor"] * 10000).cast("long"),
                             F.round(F.col(m)["drawdown"] * 100).cast("long"),
                             F.col(m)["trades"].cast("long")]
        tail = par + [F.when(num[2] < 2, "fast").otherwise("slow"),
                      F.when(num[0] % 2 == 0, "true").otherwise("false")]
        ident = F.when((sid == "flip") & (row % 100 == 7), row).otherwise(row + 1)
        broken = ((sid == "noise") & (row == 3)) | ((sid == "loser") & (row % 50 == 0))
        a = figures("is")
        a[3] = F.when(broken, F.lit(9000000000000000)).otherwise(a[3])
        one = [ident, a[0], *a, F.concat(F.lit("note "), row), *tail]
        left = p.filter((sid != "winners") | (cents("is") > 0)).select(
            "study_id", F.lit("is").alias("period"), "row_idx",
            F.array(*[c.cast("string") for c in one]).alias("texts"))
        twin = sid == "twin"
        b = [F.when(twin, x).otherwise(y) for x, y in zip(figures("is"), figures("oos"))]
        back = cents("is") + F.when((sid == "partial") & (row % 100 == 5), 100).otherwise(0)
        oid = F.when((sid == "winners") & (cents("is") <= 0), None).otherwise(row + 1)
        two = [oid, b[0], *b, back, *tail]
        right = p.filter("oos_known").select(
            "study_id", F.lit("oos").alias("period"), "row_idx",
            F.array(*[c.cast("string") for c in two]).alias("texts"))
        heads = F.when(F.col("period") == "is", F.array(*[F.lit(h) for h in HEADERS])).otherwise(
            F.array(*[F.lit(h) for h in FORWARD]))
        return left.unionByName(right).select(
            "study_id", "period", "row_idx", heads.alias("_h"),
            F.posexplode("texts").alias("col_idx", "text")).select(
            "study_id", "period", "row_idx", "col_idx",
            F.get("_h", F.col("col_idx")).alias("header"), "text")
    return memo(spark, (sf, "export_cells"), build)


def ids(spark, sf):
    return memo(spark, (sf, "export_ids"), lambda: I.pass_ids(cells(spark, sf)))


_tables = ("(SELECT DISTINCT study_id, period FROM ids) t")


@register("b1_metric_roles", "study_id:s period:s role:s header:s col_idx:i", f"""
 SELECT study_id, t.period, role, header, col_idx FROM {_tables} JOIN (VALUES
  ('is','result','Result',1),('is','profit','Profit',2),('is','profit_factor','Profit Factor',3),
  ('is','drawdown','Equity DD %',4),('is','trades','Trades',5),('oos','forward_result','Forward Result',1),
  ('oos','profit','Profit',2),('oos','profit_factor','Profit Factor',3),('oos','drawdown','Equity DD %',4),
  ('oos','trades','Trades',5),('oos','back_result','Back Result',6)) v(period, role, header, col_idx)
 ON v.period=t.period""", _EX)
def b1(spark, sf):
    return I.metric_columns(I.headers(cells(spark, sf)))


@register("b2_pass_ids", "study_id:s period:s source:s n:i ids:i", """
 SELECT study_id, period, CASE WHEN e > 0 THEN 'pass_incomplete' WHEN d <> n THEN 'pass_duplicated'
  ELSE 'pass' END AS source, n, CASE WHEN e > 0 OR d <> n THEN n ELSE d END ids FROM (
 SELECT study_id, period, count(*) n, count(*) FILTER (id IS NULL) e, count(DISTINCT id) d FROM ids
 GROUP BY ALL)""", _EX)
def b2(spark, sf):
    return ids(spark, sf).groupBy("study_id", "period", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pass_id").alias("ids"))


@register("b3_damage_report", "study_id:s period:s n_rows:i damaged:i rejected:b", """
 SELECT *, damaged > 0 AND damaged*1.0/n_rows >= 0.01 rejected FROM (
 SELECT study_id, 'is' AS period, count(*) n_rows, count(*) FILTER (trades > 1000000000000000) damaged
  FROM isr GROUP BY 1 UNION ALL SELECT study_id, 'oos', count(*), count(*) FILTER (id IS NULL)
  FROM oosr GROUP BY 1)""", _EX)
def b3(spark, sf):
    return I.damage_report(cells(spark, sf)).withColumnRenamed("rows", "n_rows")


@register("b4_hidden_losers", "study_id:s row_idx:i",
          "SELECT study_id, row_idx FROM oosr WHERE id IS NULL", _EX)
def b4(spark, sf):
    return I.hidden_losers(cells(spark, sf))


_pairing = """SELECT i.study_id, i.n is_rows, coalesce(o.n,0) oos_rows, m.matched, i.n-m.matched unmatched_is,
  d.dup duplicate_ids, coalesce(o.n,0)*1.0/i.n forward_row_ratio,
  coalesce(o.n,0)>0 AND i.n>=20 AND coalesce(o.n,0) < i.n-5 AND coalesce(o.n,0)*1.0/i.n < 0.95 forward_subset
 FROM (SELECT study_id, count(*) n FROM isr GROUP BY 1) i
 LEFT JOIN (SELECT study_id, count(*) n FROM oosr GROUP BY 1) o USING (study_id)
 JOIN (SELECT isr.study_id, count(*) FILTER (o.id IS NOT NULL) matched FROM isr LEFT JOIN
   (SELECT DISTINCT study_id, id FROM oosr) o ON o.study_id=isr.study_id AND o.id=isr.id GROUP BY 1) m USING (study_id)
 JOIN (SELECT study_id, sum(c-1) dup FROM (SELECT study_id, period, id, count(*) c FROM ids GROUP BY ALL)
   GROUP BY 1) d USING (study_id)"""


@register("b5_pairing", "study_id:s is_rows:i oos_rows:i matched:i unmatched_is:i duplicate_ids:i",
          _pairing, _EX)
def b5(spark, sf):
    return I.pairing_report(ids(spark, sf))


@register("b6_structural_parameters", "study_id:s header:s compared:i is_parameter:b", """
 SELECT study_id, header, n compared, true is_parameter FROM (SELECT i.study_id, count(*) n FROM isr i
  JOIN (SELECT study_id, id, min_by(p0*45+p1*5+p2, row_idx) v FROM oosr GROUP BY ALL) o
  ON o.study_id=i.study_id AND o.id=i.id GROUP BY 1),
  (VALUES ('p0'),('p1'),('p2'),('Mode'),('Flag')) h(header) WHERE study_id <> 'flip'
 UNION ALL SELECT 'flip', header, n, bad*1.0/n < 0.001 FROM (SELECT h.header, count(*) n, count(*) FILTER (
   CASE header WHEN 'p0' THEN i.p0<>o.p0 WHEN 'p1' THEN i.p1<>o.p1 WHEN 'p2' THEN i.p2<>o.p2
    WHEN 'Mode' THEN (i.p2<2)<>(o.p2<2) ELSE i.p0%2<>o.p0%2 END) bad
  FROM isr i JOIN oosr o ON o.study_id=i.study_id AND o.id=i.id,
   (VALUES ('p0'),('p1'),('p2'),('Mode'),('Flag')) h(header) WHERE i.study_id='flip' GROUP BY 1)""", _EX)
def b6(spark, sf):
    return I.structural_parameters(cells(spark, sf), ids(spark, sf))


@register("b7_provenance", "study_id:s compared:i mismatches:i ratio:d rejected:b ids:s", """
 SELECT *, 1-mismatches*1.0/compared ratio, compared >= 5 AND 1-mismatches*1.0/compared < 0.98 rejected FROM (
 SELECT study_id, count(*) compared, count(*) FILTER (bad) mismatches,
  coalesce(array_to_string((list(CAST(id AS VARCHAR) ORDER BY row_idx) FILTER (bad))[1:10], ','), '') ids FROM (
  SELECT i.study_id, i.row_idx, i.id, abs(i.profit-o.back) > 1e-6*greatest(1, abs(i.profit)) bad FROM isr i
  JOIN oosr o ON o.study_id=i.study_id AND o.id=i.id) GROUP BY 1)""", _EX)
def b7(spark, sf):
    return I.provenance(cells(spark, sf), ids(spark, sf)).withColumn("ids", F.concat_ws(",", "ids"))


@register("b8_single_table_parameters", "study_id:s header:s levels:i is_parameter:b reason:s", """
 SELECT study_id, header, CASE header WHEN 'p0' THEN 11 WHEN 'p1' THEN 9 WHEN 'p2' THEN 5 WHEN 'Mode' THEN 2
  WHEN 'Flag' THEN 2 ELSE n END levels, header <> 'Comment' is_parameter,
  CASE WHEN header='Comment' THEN 'useless_categories' END reason
 FROM (SELECT study_id, count(*) n FROM isr GROUP BY 1),
 (VALUES ('p0'),('p1'),('p2'),('Mode'),('Flag'),('Comment')) h(header)""", _EX)
def b8(spark, sf):
    return I.single_table_parameters(cells(spark, sf).filter("period = 'is'")).filter(
        "reason IS NULL OR reason <> 'metric'")


@register("b9_period_ratio", "study_id:s period_ratio:d",
          "SELECT study_id, pr period_ratio FROM ratio", chain("ratio"))
def b9(spark, sf):
    return Q.period_ratio(R.sweep(spark, sf))


@register("b10_forward_subset", "study_id:s forward_row_ratio:d forward_subset:b", _pairing, _EX)
def b10(spark, sf):
    return I.pairing_report(ids(spark, sf))


def _params(spark, sf):
    names = F.array(*[F.lit(h) for h in ("p0", "p1", "p2", "Mode", "Flag")])
    return cells(spark, sf).select("study_id").distinct().select(
        "study_id", F.explode(names).alias("header"))


def _built(spark, sf):
    c = cells(spark, sf)
    return memo(spark, (sf, "built_passes"), lambda: I.build_passes(
        c, ids(spark, sf), _params(spark, sf), I.hidden_losers(c)))


@register("b11_same_period_twice", "study_id:s compared:i identical:i repeated:b", """
 SELECT study_id, count(*) compared, count(*) FILTER (i.profit=o.profit AND i.pf=o.pf AND i.dd=o.dd AND i.trades=o.trades)
  identical, count(*) >= 10 AND count(*) FILTER (i.profit=o.profit AND i.pf=o.pf AND i.dd=o.dd AND i.trades=o.trades)
  *1.0/count(*) >= 0.95 repeated FROM isr i JOIN oosr o USING (study_id, id)
 GROUP BY 1""", _EX)
def b11(spark, sf):
    return I.same_period_twice(_built(spark, sf).filter("NOT lost_in_is"))


@register("b12_discovery_union", "study_id:s oos_known:b lost_in_is:b n:i profit:d", """
 SELECT study_id, oos_known, lost_in_is, count(*) n, coalesce(sum(profit)/1e4,0) profit FROM (
  SELECT i.study_id, o.id IS NOT NULL oos_known, false lost_in_is, i.profit FROM isr i
  LEFT JOIN oosr o ON o.study_id=i.study_id AND o.id=i.id
  UNION ALL SELECT study_id, true, true, NULL FROM oosr WHERE id IS NULL)
 GROUP BY ALL""", _EX)
def b12(spark, sf):
    return _built(spark, sf).groupBy("study_id", "oos_known", "lost_in_is").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("is.profit") / 1e4, F.lit(0.0)).alias("profit"))


@register("b13_parameter_types", "study_id:s name:s type:s n:i", """
 SELECT s.study_id, name, type, n FROM (SELECT study_id, count(*) n FROM (SELECT study_id FROM isr UNION ALL
  SELECT study_id FROM oosr WHERE id IS NULL) GROUP BY 1) s, (VALUES ('p0','number'),('p1','number'),
  ('p2','number'),('Mode','text'),('Flag','bool')) v(name, type)""", _EX)
def b13(spark, sf):
    b = _built(spark, sf)
    n = b.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    return S.param_types(S.param_rows(b)).join(n, "study_id")


def _narrow(spark, sf):
    """The sweep without its last parameter, so that vectors repeat."""
    return R.sweep(spark, sf).withColumn("params", F.slice("params", 1, 2))


@register("b14_first_of_duplicates", "study_id:s row_idx:i",
          "SELECT study_id, min(row_idx) row_idx FROM passes GROUP BY study_id, p0, p1",
          chain("passes"))
def b14(spark, sf):
    return I.first_of_duplicates(_narrow(spark, sf))


@register("b15_result_twins", "study_id:s row_idx:i twins:i", """
 SELECT study_id, row_idx, count(*) OVER (PARTITION BY study_id, is_profit, is_trades)-1 twins
 FROM passes""", chain("passes"))
def b15(spark, sf):
    return I.result_twins(R.sweep(spark, sf))


@register("b16_missing_metrics", "study_id:s period:s role:s", """
 SELECT study_id, period, 'trades' AS role FROM (SELECT DISTINCT study_id, period FROM ids)
 WHERE study_id='solo'""", _EX)
def b16(spark, sf):
    return I.missing_key_metrics(I.headers(cells(spark, sf).filter(
        "study_id <> 'solo' OR header <> 'Trades'")))


@register("b16_unrecognised_columns", "study_id:s header:s",
          "SELECT DISTINCT study_id, 'Comment' AS header FROM isr", _EX)
def b16b(spark, sf):
    return I.unrecognised_columns(I.headers(cells(spark, sf)), _params(spark, sf))


@register("b17_drop_unreadable", "study_id:s n:i", """
 SELECT study_id, count(*) n FROM passes WHERE p0 % 3 <> 0 GROUP BY 1 HAVING count(*) >= 10""",
          chain("passes"))
def b17(spark, sf):
    blank = F.transform("params", lambda p: F.when(
        (p["name"] == "p0") & (p["num"] % 3 == 0), p.withField("txt", F.lit(None).cast("string"))
    ).otherwise(p))
    return I.drop_unreadable(R.sweep(spark, sf).withColumn("params", blank)).groupBy(
        "study_id").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ files
def _figures(spark, sf):
    """Profit and factor of the planted study as an export writes them."""
    return R.sweep(spark, sf).select(
        "study_id", "row_idx", F.round(F.col("is.profit"), 2).alias("profit"),
        F.round(F.col("is.profit_factor"), 4).alias("pf"), F.col("is.trades").cast("long")
        .alias("trades"), F.col("params")[0]["num"].cast("int").alias("p0"))


def _write(df, path):
    E.write_lines(df.select("study_id", "line_no", "value"), path)
    return path


def _delimited(spark, sf):
    def build():
        money = F.translate(F.format_number("profit", 2), ",.", ".,")
        f = _figures(spark, sf).select("study_id", (F.col("row_idx") + 1).alias("line_no"), F.concat_ws(
            ";", (F.col("row_idx") + 1).cast("string"), money, F.translate(
                F.format_number("pf", 4), ",.", ".,"), F.col("trades").cast("string"),
            F.concat(F.lit('"cfg; '), F.col("p0").cast("string"), F.lit('"'))).alias("value"))
        head = f.select("study_id").distinct().select(
            "study_id", F.lit(0).cast("long").alias("line_no"),
            F.lit("Pass;Profit;Profit Factor;Trades;Label").alias("value"))
        path = _write(f.unionByName(head), scratch_path(spark, "delimited"))
        return G.finish_table(G.read_delimited(spark, path))
    return memo(spark, (sf, "read_delimited"), build)


def _study():
    return F.regexp_extract("file", "study_id=([^/]+)/", 1)
_fig = """figs AS (SELECT study_id, row_number() OVER (PARTITION BY study_id
  ORDER BY row_idx) AS line_no, round(is_profit,2) profit,
  round(is_profit_factor,4) pf, is_trades trades, p0 FROM passes)"""
_FIG = chain("passes").rstrip() + ",\n" + _fig + "\n"


def _table_query(read):
    def fn(spark, sf):
        c = read(spark, sf).withColumn("study_id", _study())
        pick = lambda h, v: F.max(F.when(F.col("header") == h, F.col(v)))
        return c.groupBy("study_id", "line_no").agg(
            pick("Profit", "num").alias("profit"), pick("Profit Factor", "num").alias("pf"),
            pick("Trades", "num").alias("trades"), pick("Label", "text").alias("label"))
    return fn


@register("a2_delimited_table", "study_id:s line_no:i profit:d pf:d trades:d label:s",
          "SELECT *, 'cfg; '||p0 AS label FROM figs", _FIG)
def a2(spark, sf):
    return _table_query(_delimited)(spark, sf)


@register("a4_decimal_marks", "study_id:s header:s decimal:s",
          "SELECT study_id, header, ',' AS decimal FROM (SELECT DISTINCT study_id FROM figs), "
          "(VALUES ('Pass'),('Profit'),('Profit Factor'),('Trades'),('Label')) h(header)", _FIG)
def a4(spark, sf):
    return _delimited(spark, sf).select(_study().alias("study_id"), "header", "decimal").distinct()


def _xml(spark, sf):
    def build():
        cell = lambda t, v: F.concat(F.lit(f'<Cell><Data ss:Type="{t}">'), v.cast("string"),
                                     F.lit("</Data></Cell>"))
        row = lambda *c: F.concat(F.lit("<Row>"), *c, F.lit("</Row>"))
        label = F.concat(F.lit('<Cell ss:Index="6"><Data ss:Type="String">cfg &amp; '),
                         F.col("p0").cast("string"), F.lit("</Data></Cell>"))
        f = _figures(spark, sf).select("study_id", (F.col("row_idx") + 2).alias("line_no"), row(
            cell("Number", F.col("row_idx") + 1), cell("Number", F.col("profit").cast("decimal(20,2)")),
            cell("Number", F.col("pf").cast("decimal(20,4)")), cell("Number", F.col("trades")),
            label).alias("value"))
        names = [cell("String", F.lit(h)) for h in ("Pass", "Profit", "Profit Factor", "Trades")]
        top = F.concat(F.lit('<?xml version="1.0"?><Workbook><Worksheet ss:Name="empty"><Table><Row/>'
                             '</Table></Worksheet><Worksheet ss:Name="sweep"><Table>'), row(
            *names, F.lit('<Cell/><Cell><Data ss:Type="String">Label</Data></Cell>')))
        ids = f.select("study_id").distinct()
        head = ids.select("study_id", F.lit(0).cast("long").alias("line_no"), top.alias("value"))
        foot = ids.select("study_id", F.lit(1 << 50).alias("line_no"),
                          F.lit("</Table></Worksheet></Workbook>").alias("value"))
        path = _write(f.unionByName(head).unionByName(foot), scratch_path(spark, "xml"))
        return G.finish_table(G.read_spreadsheet_xml(spark, path))
    return memo(spark, (sf, "read_xml"), build)


@register("a1_spreadsheet_xml", "study_id:s line_no:i profit:d pf:d trades:d label:s",
          "SELECT *, 'cfg & '||p0 AS label FROM figs", _FIG)
def a1(spark, sf):
    return _table_query(_xml)(spark, sf)


@register("a3_header_location", "study_id:s header_line:i", "SELECT DISTINCT study_id, 0 header_line FROM figs",
          _FIG)
def a3(spark, sf):
    c = _figures(spark, sf).select(
        F.col("study_id").alias("file"), F.lit(1) + F.col("row_idx"), F.col("profit"))
    rows = c.select("file", F.col(c.columns[1]).alias("line_no"), F.posexplode(F.array(
        F.col(c.columns[1]).cast("string"), F.col("profit").cast("string"), F.lit("x"))).alias(
        "col_idx", "text"), F.lit(True).alias("is_number"))
    head = c.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.posexplode(
        F.array(F.lit("Pass"), F.lit("Profit"), F.lit("Label"))).alias("col_idx", "text"),
        F.lit(False).alias("is_number"))
    return G.locate_header(rows.unionByName(head)).withColumnRenamed("file", "study_id")


@register("a5_number_parse", "study_id:s row_idx:i a:d b:d c:d d:d", """
 SELECT study_id, row_idx, round(is_profit,2) a, round(is_profit,2) b, is_trades c,
  CASE WHEN is_trades < 1000 AND is_trades >= 1 THEN is_trades*1000 + 7 END d FROM passes""", chain("passes"))
def a5(spark, sf):
    f = _figures(spark, sf)
    us = F.format_number("profit", 2)
    n = lambda c: X.to_number(c)
    return f.select("study_id", "row_idx", n(us).alias("a"), n(F.translate(us, ",.", ".,")).alias("b"),
                    n(F.concat(F.lit(" "), F.col("trades").cast("string"), F.lit(" %"))).alias("c"),
                    F.when((F.col("trades") < 1000) & (F.col("trades") >= 1), n(F.concat(
                        F.col("trades").cast("string"), F.lit(",007")))).alias("d"))


@register("a6_canonical_value", "study_id:s row_idx:i kind:s num:d txt:s", """
 SELECT study_id, row_idx, CASE p0 % 4 WHEN 0 THEN 'bool' WHEN 1 THEN 'number' WHEN 2 THEN 'text' END kind,
  CASE WHEN p0 % 4 = 1 THEN p1 + 0.5 END num, CASE p0 % 4 WHEN 0 THEN CASE WHEN p1 % 2 = 0 THEN 'true' ELSE 'false' END
  WHEN 1 THEN CAST(p1 AS VARCHAR)||'.5' WHEN 2 THEN 'mode'||p1 END txt FROM passes""", chain("passes"))
def a6(spark, sf):
    p = R.sweep(spark, sf)
    p0, p1 = [F.col("params")[i]["num"].cast("int") for i in (0, 1)]
    raw = (F.when(p0 % 4 == 0, F.when(p1 % 2 == 0, "Verdadero").otherwise("FALSE"))
           .when(p0 % 4 == 1, F.concat(p1.cast("string"), F.lit(",5")))
           .when(p0 % 4 == 2, F.concat(F.lit(" mode"), p1.cast("string"))).otherwise("  "))
    return p.select("study_id", "row_idx", X.canonical(raw).alias("v")).select(
        "study_id", "row_idx", "v.*")


_CHARSETS = ("UTF-8", "UTF-16LE", "UTF-16BE")


def _encoded(spark, sf):
    """Lines of every study in three encodings, with letters whose bytes look like line ends."""
    def build():
        path = scratch_path(spark, "encodings")
        f = _figures(spark, sf).select("study_id", (F.col("row_idx") + 1).alias("line_no"), F.concat_ws(
            ";", F.lit("Ċ ਅĀ Њ é"), (F.col("row_idx") + 1).cast("string"), F.col("p0").cast("string"))
            .alias("value"))
        mark = {"UTF-8": "", "UTF-16LE": "FFFE", "UTF-16BE": "FEFF"}
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))),
                                         lambda x: F.concat(x["value"], F.lit("\r\n"))), "")
        whole = f.groupBy("study_id").agg(lines.alias("t"))  # files of a test, of a study's size
        for c in _CHARSETS:
            part = whole.select(F.concat(F.unhex(F.lit(mark[c])), F.encode("t", c)).cast("string").alias(
                "value"), "study_id")
            part.write.partitionBy("study_id").option("lineSep", " ").text(f"{path}/{c}")
        return path
    return memo(spark, (sf, "encoded"), lambda: spark.createDataFrame([(build(),)], "path string"))


@register("a7_text_encodings", "charset:s study_id:s line_no:i value:s", f"""
 SELECT charset, study_id, line_no-1 line_no, 'Ċ ਅĀ Њ é;'||CAST(row_idx+1 AS VARCHAR)||';'||CAST(p0 AS VARCHAR) AS value
 FROM (SELECT study_id, row_idx, p0, row_number() OVER (PARTITION BY study_id ORDER BY row_idx) line_no FROM passes),
  (VALUES {', '.join(f"('{c}')" for c in _CHARSETS)}) c(charset)""", chain("passes"))
def a7(spark, sf):
    path = _encoded(spark, sf).first()["path"]
    lines = G.read_lines(spark, f"{path}/*/*/*.txt").filter("trim(value) <> ''")
    return lines.select("charset", _study().alias("study_id"), "line_no",
                        F.regexp_replace("value", "\\r$", "").alias("value"))


@register("a8_file_roles", "study_id:s row_idx:i role:s", """
 SELECT study_id, row_idx, CASE row_idx % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'report' WHEN 2 THEN 'oos'
  WHEN 3 THEN 'set' ELSE 'is' END AS role FROM passes""", chain("passes"))
def a8(spark, sf):
    k = F.col("row_idx") % 5
    head = (F.when(k == 1, "<html><b>Strategy Tester Report</b>").when(k == 2, "Pass;Forward Result;Back Result")
            .when(k == 3, "p0=1||0||1||9||Y").otherwise("Pass;Result;Profit"))
    f = R.sweep(spark, sf).select("study_id", "row_idx", F.concat_ws(
        "/", "study_id", F.concat(F.col("row_idx").cast("string"), F.when(k == 0, ".set").otherwise(".csv")))
        .alias("file"), head.alias("head"))
    return f.join(G.file_roles(f), "file")


def _range_lines(spark, sf):
    """Declared ranges of the sweep, as a tester writes them."""
    lv = audit(spark, sf).levels.groupBy("study_id", "dim", "name").agg(
        F.min("num").cast("int").alias("a"), F.max("num").cast("int").alias("b"))
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.col("name"), F.lit("="), s("a"), F.lit("||"), s("a"), F.lit("||1||"), s("b"),
                    F.lit("||"), F.when(F.col("dim") == 2, "N").otherwise("Y"))
    note = lv.select("study_id").distinct().select(
        "study_id", F.lit(-1).alias("line_no"), F.lit("; saved ranges").alias("value"))
    extra = lv.select("study_id").distinct().select(
        "study_id", F.lit(9).alias("line_no"), F.lit("Symbol=EURUSD").alias("value"))
    return lv.select("study_id", F.col("dim").alias("line_no"), line.alias("value")).unionByName(
        note).unionByName(extra)


@register("a9_declared_ranges", "study_id:s name:s start:d step:d stop:d enabled:b has_range:b", """
 SELECT study_id, name, min(val) AS start, 1 step, max(val) AS stop, dim <> 2 enabled, true has_range FROM lv
 GROUP BY study_id, name, dim UNION ALL SELECT DISTINCT study_id, 'Symbol', NULL, NULL, NULL, false, false
 FROM lv""", chain("lv"))
def a9(spark, sf):
    return G.parse_ranges(_range_lines(spark, sf))


def _reports(spark, sf):
    """One HTML report per supplier, its lines as deals."""
    def build():
        li = R.table(spark, sf, "lineitem")
        td = lambda *c: F.concat(*[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c])
        tr = lambda x: F.concat(F.lit("<tr>"), x, F.lit("</tr>"))
        s = lambda c: F.col(c).cast("string")
        deal = tr(td(F.date_format("l_shipdate", "yyyy.MM.dd HH:mm:ss"), s("l_orderkey"), F.lit("EURUSD"),
                     F.when(F.col("l_returnflag") == "R", "buy").otherwise("sell"), F.when(
            F.col("l_linenumber") % 2 == 0, "in").otherwise("out"),
            s("l_quantity"), F.round("l_extendedprice", 2).cast("decimal(20,2)").cast("string"),
            F.lit("0.00"), F.lit("0.00"), F.round("l_extendedprice", 2).cast("decimal(20,2)").cast("string"),
            F.lit("100 000.00")))
        g = li.groupBy(F.col("l_suppkey").alias("report_id")).agg(
            F.concat_ws("\n", F.sort_array(F.collect_list(deal))).alias("d"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"),
            F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
        day = lambda c: F.date_format(c, "yyyy.MM.dd")
        text = F.concat(
            F.lit("<html><title>Strategy Tester Report</title><table>"),
            tr(td(F.lit("Symbol:"), F.lit("<b>EURUSD</b>"))),
            tr(td(F.lit("Period:"), F.concat(F.lit("H1 ("), day("a"), F.lit(" - "), day("b"), F.lit(")")))),
            tr(td(F.lit("Inputs:"), F.lit("p0=7"))), tr(td(F.lit(""), F.lit("=== Exit ==="))),
            tr(td(F.lit(""), F.concat(F.lit("Lots="), s("report_id")))),
            tr(td(F.lit("Total Net Profit:"), F.format_number((F.col("c") / 100), 2),
                  F.lit("Equity Drawdown Relative:"), F.lit("12.50% (1 250.00)"))),
            tr(td(F.lit("Total Trades:"), s("n"), F.lit("Profit Factor:"), F.lit("1.25"))),
            tr(td(*[F.lit(h) for h in ("Time", "Deal", "Symbol", "Type", "Direction", "Volume", "Price",
                                       "Commission", "Swap", "Profit", "Balance")])),
            F.col("d"), F.lit("</table></html>"))
        return G.report_rows(g.select("report_id", text.alias("html")))
    return memo(spark, (sf, "report_rows"), build)


@register("a10_report_figures", "report_id:i symbol:s from_day:s to_day:s profit:d trades:i "
          "profit_factor:d drawdown:d", """
 SELECT l_suppkey report_id, 'EURUSD' symbol, CAST(min(l_shipdate) AS DATE) from_day,
  CAST(max(l_shipdate) AS DATE) to_day, sum(CAST(round(l_extendedprice*100) AS BIGINT))/100.0 profit,
  count(*) trades, 1.25 profit_factor, 12.5 drawdown FROM lineitem GROUP BY 1""")
def a10(spark, sf):
    return G.report_figures(_reports(spark, sf))


@register("a10_report_inputs", "report_id:i name:s text:s", """
 SELECT DISTINCT l_suppkey report_id, 'p0' AS name, '7' AS text FROM lineitem UNION ALL
 SELECT DISTINCT l_suppkey, 'Lots', CAST(l_suppkey AS VARCHAR) FROM lineitem""")
def a10b(spark, sf):
    return G.report_inputs(_reports(spark, sf))


@register("a10_report_deals", "report_id:i type:s direction:s n:i volume:d profit:d first_ts:s", """
 SELECT l_suppkey report_id, CASE WHEN l_returnflag='R' THEN 'buy' ELSE 'sell' END AS type,
  CASE WHEN l_linenumber % 2 = 0 THEN 'in' ELSE 'out' END direction, count(*) n, sum(l_quantity) volume,
  sum(round(l_extendedprice,2)) profit, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') first_ts
 FROM lineitem GROUP BY ALL""")
def a10c(spark, sf):
    return G.report_deals(_reports(spark, sf)).groupBy("report_id", "type", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.sum("profit").alias("profit"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@register("a11_preflight", "study_id:s period:s n_rows:i cols:i params:i param_names:s metrics:i missing:s", """
 SELECT study_id, period, count(*) n_rows, 12 cols, 5 params, 'p0,p1,p2,Mode,Flag' param_names,
  CASE period WHEN 'is' THEN 5 ELSE 6 END metrics, '' missing FROM ids GROUP BY ALL""", _EX)
def a11(spark, sf):
    c = I.preflight(cells(spark, sf))
    return c.withColumnRenamed("rows", "n_rows").withColumn("param_names", F.concat_ws(",", "param_names")).withColumn(
        "missing", F.concat_ws(",", "missing"))


@register("a12_pass_table", "study_id:s row_idx:i pass_id:s params:s quality_is:d robust:d support:i "
          "passes_is:i passes_oos:i plateau_rank:i profit:d", """
 SELECT c.study_id, c.row_idx, c.pass_id, 'p0='||p0||',p1='||p1||',p2='||p2 params, quality_is, rob.robust,
  rob.support, CAST(len(fails_is)=0 AS INT) passes_is, CASE WHEN known THEN CAST(len(fails_oos)=0 AS INT) END
  passes_oos, k.rank plateau_rank, is_profit profit FROM cells c
 JOIN rob ON rob.study_id=c.study_id AND rob.row_idx=c.row_idx
 LEFT JOIN (SELECT m.study_id, m.row_idx, r.rank FROM members m JOIN ranked r ON r.study_id=m.study_id
  AND r.component=m.component) k ON k.study_id=c.study_id AND k.row_idx=c.row_idx""", chain("ranked"))
def a12(spark, sf):
    a = audit(spark, sf)
    return E.pass_table(a.cells, a.stability, a.members, a.plateaus).withColumn(
        "params", F.replace("params", F.lit(".0"), F.lit("")))


def _levels(spark, sf):
    m = simple_metrics(spark, sf)
    f = V.findings(m)
    return f, V.evidence_level(f, m)


@register("a13_study_report", "study_id:s level:s plateaus:i bytes_ok:b")
def a13(spark, sf):
    a = audit(spark, sf)
    f, lv = _levels(spark, sf)
    prints = E.fingerprint(a.studies, a.coverage, a.plateaus, lv)
    r = E.study_report(a.studies, a.coverage, a.roles, a.plateaus, a.peaks, f, lv, prints)
    path = scratch_path(spark, "report")
    E.write_report(r, path)
    back = spark.read.text(path)
    return back.select("study_id", F.get_json_object("value", "$.level").alias("level"), F.size(
        F.from_json(F.get_json_object("value", "$.plateaus"), "array<struct<rank:int>>")).alias("plateaus"),
        (F.length("value") > 500).alias("bytes_ok"))


@register("a14_values_file", "study_id:s line_no:i value:s", """
 SELECT r.study_id, d.dim+1 line_no, ['p0','p1','p2'][d.dim+1]||'='||[c.p0,c.p1,c.p2][d.dim+1] AS value
 FROM ranked r JOIN cells c ON c.study_id=r.study_id AND c.row_idx=r.representative,
 (VALUES (0),(1),(2)) d(dim) WHERE r.rank=1""", chain("ranked"))
def a14(spark, sf):
    a = audit(spark, sf)
    return E.values_file(a.plateaus, a.passes)


def _ranges(spark, sf, finer=None):
    a = audit(spark, sf)
    return refine.refinement(a.representatives, a.cells, a.levels, a.roles, a.coverage, finer=finer)


RANGE = "study_id:s component:i dim:i center:d start:d stop:d step:d levels:i fixed:b finer:b"


@register("e20_refinement_range", RANGE)
def e20(spark, sf):
    return _ranges(spark, sf, False)


@register("e21_half_step_refinement", RANGE)
def e21(spark, sf):
    return _ranges(spark, sf, True)


@register("a15_refinement_file", "study_id:s line_no:i value:s")
def a15(spark, sf):
    a = audit(spark, sf)
    first = _ranges(spark, sf).join(a.plateaus.filter("rank = 1").select("study_id", "component"),
                                    ["study_id", "component"])
    return E.refinement_file(first)


@register("a16_merged_values", "study_id:s line_no:i value:s", """
 SELECT r.study_id, line_no, CASE line_no WHEN 4 THEN 'Symbol=EURUSD' ELSE
  ['p0','p1','p2'][line_no]||'='||[c.p0,c.p1,c.p2][line_no] END AS value
 FROM ranked r JOIN cells c ON c.study_id=r.study_id AND c.row_idx=r.representative,
 (VALUES (1),(2),(3),(4)) d(line_no) WHERE r.rank=1""", chain("ranked"))
def a16(spark, sf):
    a = audit(spark, sf)
    return E.values_file(a.plateaus, a.passes, G.parse_ranges(_range_lines(spark, sf)))


@register("a17_fingerprint", "study_id:s length:i", "SELECT study_id, 64 AS length FROM studies",
          chain("studies"))
def a17(spark, sf):
    a = audit(spark, sf)
    return E.fingerprint(a.studies, a.coverage, a.plateaus, _levels(spark, sf)[1]).select(
        "study_id", F.length("fingerprint").alias("length"))
