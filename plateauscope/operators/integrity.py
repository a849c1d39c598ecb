"""Integrity, pairing and schema inference over exported cells.

``cells``: study_id, period ('is' / 'oos'), row_idx, col_idx, header, text. A study is
one sweep with its optional forward table; every check runs on all studies at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import (KEY_METRICS, canonical, is_id_header, let, metric_role,
                                 to_number)
from .ordering import attach

TABLE = ["study_id", "period"]
ROW = [*TABLE, "row_idx"]
METRICS = ("profit", "profit_factor", "recovery_factor", "sharpe", "drawdown", "trades",
           "expected_payoff")
IDENTITY_RATIO = 0.999
DAMAGED_SHARE = 0.01
MIN_ROWS = 10


def headers(cells: DataFrame) -> DataFrame:
    h = F.trim("header")
    return cells.select(*TABLE, "col_idx", h.alias("header")).distinct().withColumn(
        "role", metric_role(F.col("header"))).withColumn("is_id", is_id_header(F.col("header")))


def metric_columns(heads: DataFrame) -> DataFrame:
    """First column of every metric role, per table."""
    return heads.filter("role IS NOT NULL").groupBy(*TABLE, "role").agg(
        F.min_by("header", "col_idx").alias("header"), F.min("col_idx").alias("col_idx"))


def missing_key_metrics(heads: DataFrame) -> DataFrame:
    expected = heads.select(*TABLE).distinct().withColumn(
        "role", F.explode(F.array(*[F.lit(k) for k in KEY_METRICS])))
    return expected.join(metric_columns(heads).select(*TABLE, "role"), [*TABLE, "role"],
                         "left_anti")


def unrecognised_columns(heads: DataFrame, params: DataFrame) -> DataFrame:
    """Headers that are neither a metric, an id nor a parameter."""
    return heads.filter("role IS NULL AND NOT is_id").join(
        params.select("study_id", "header"), ["study_id", "header"], "left_anti").select(
        "study_id", "header").distinct()


def pass_ids(cells: DataFrame) -> DataFrame:
    """Pass id of every row and where it came from (pass, row, incomplete, duplicated)."""
    rows = cells.select(*ROW).distinct()
    marked = cells.filter(is_id_header(F.col("header")))
    first = marked.groupBy(*TABLE).agg(F.min("col_idx").alias("col_idx"))
    ids = attach(marked, first, [*TABLE, "col_idx"], "inner", "row_idx").select(
        *ROW, F.trim("text").alias("id"))
    filled = F.when(F.coalesce("id", F.lit("")) != "", F.col("id"))
    state = ids.groupBy(*TABLE).agg(
        F.count_if(filled.isNull()).alias("_empty"), F.count(filled).alias("_n"),
        F.count_distinct(filled).alias("_d")).select(
        *TABLE, F.when(F.col("_empty") > 0, "pass_incomplete").when(
            F.col("_n") != F.col("_d"), "pass_duplicated").otherwise("pass").alias("source"))
    out = rows.join(ids, ROW, "left")
    out = attach(out, state, TABLE, "left", "row_idx").withColumn(
        "source", F.coalesce("source", F.lit("row")))
    return out.withColumn("pass_id", F.when(F.col("source") == "pass", F.col("id")).otherwise(
        (F.col("row_idx") + 1).cast("string"))).select(*ROW, "id", "pass_id", "source")


def impossible_number(text: Column) -> Column:
    """Subnormal or absurdly large integers: signs of a broken export."""
    return let(F.abs(to_number(text)), lambda v: F.coalesce(
        (v > 0) & ((v < 1e-300) | ((v == F.floor(v)) & (v > 1e15))), F.lit(False)))


def damaged_rows(cells: DataFrame) -> DataFrame:
    """Flag per row: missing id in a table with ids, or an impossible number."""
    id_col = is_id_header(F.col("header"))
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    return cells.groupBy(*ROW).agg(
        F.max(id_col & empty).alias("no_id"),
        F.max(impossible_number(F.col("text"))).alias("impossible")).withColumn(
        "damaged", F.col("no_id") | F.col("impossible"))


def damage_report(cells: DataFrame) -> DataFrame:
    d = damaged_rows(cells).groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("damaged").alias("damaged"))
    return d.withColumn("rejected", (F.col("damaged") > 0) & (
        F.col("damaged") / F.col("rows") >= DAMAGED_SHARE))


def screen_damaged(cells: DataFrame) -> DataFrame:
    """Cells without the damaged rows; tables with too many of them are dropped whole."""
    flags = damaged_rows(cells).select(*ROW, "damaged")
    bad = damage_report(cells).filter("rejected").select(*TABLE)
    return cells.join(flags.filter("damaged").select(*ROW), ROW, "left_anti").join(
        bad, TABLE, "left_anti")


def parameter_key(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """One string per row made of the texts of the columns both tables share."""
    c = cells.withColumn("_h", F.trim("header")).join(
        shared.withColumnRenamed("header", "_h"), ["study_id", "_h"])
    part = F.struct(F.col("_h"), F.coalesce(F.trim("text"), F.lit("")).alias("t"))
    return c.groupBy(*ROW).agg(F.to_json(F.sort_array(F.collect_list(part))).alias("key"))


def hidden_losers(cells: DataFrame) -> DataFrame:
    """Forward rows without id whose parameters the optimised table left out.

    They count as tested losers only when every condition holds for the study: all
    optimised rows are profitable, no unnumbered row is damaged, none is known.
    """
    heads = headers(cells)
    plain = heads.filter("role IS NULL AND NOT is_id")
    shared = plain.filter("period = 'is'").select("study_id", "header").join(
        plain.filter("period = 'oos'").select("study_id", "header"), ["study_id", "header"])
    d = damaged_rows(cells)
    lost = d.filter("period = 'oos' AND no_id")
    profit = cells.filter("period = 'is'").filter(metric_role(F.col("header")) == "profit").groupBy(
        "study_id").agg(F.min(F.coalesce(to_number(F.col("text")), F.lit(-1.0))).alias("worst"))
    keys = parameter_key(cells, shared)
    lost = lost.join(keys, ROW)
    known = keys.filter("period = 'is'").select("study_id", "key").distinct().withColumn(
        "_known", F.lit(True))
    lost = lost.join(known, ["study_id", "key"], "left")
    ok = lost.groupBy("study_id").agg(
        F.max("impossible").alias("_bad"), F.max(F.coalesce("_known", F.lit(False))).alias("_k"))
    ok = ok.join(profit, "study_id").filter("NOT _bad AND NOT _k AND worst > 0").select("study_id")
    return attach(lost.select(*ROW), ok, ["study_id"], "inner", "row_idx")


def pairs(ids: DataFrame) -> DataFrame:
    """Optimised rows with their forward row, on the first occurrence of each id."""
    first = ids.filter("id IS NOT NULL AND id <> ''").groupBy(*TABLE, "id").agg(
        F.min("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("copies"))
    a = ids.filter("period = 'is'").select("study_id", "row_idx", "id")
    b = first.filter("period = 'oos'").select("study_id", "id", F.col("row_idx").alias("oos_row"))
    return a.join(b, ["study_id", "id"], "left")


def pairing_report(ids: DataFrame) -> DataFrame:
    """Rows, matches, unmatched rows, duplicate ids and the forward-subset suspicion."""
    n = ids.groupBy("study_id").agg(
        F.count_if(F.col("period") == "is").alias("is_rows"),
        F.count_if(F.col("period") == "oos").alias("oos_rows"))
    m = pairs(ids).groupBy("study_id").agg(F.count("oos_row").alias("matched"))
    dup = (ids.groupBy(*TABLE, "id").agg((F.count(F.lit(1)) - 1).alias("_d"))
           .groupBy("study_id").agg(F.sum("_d").alias("duplicate_ids")))
    out = n.join(m, "study_id", "left").join(dup, "study_id", "left")
    ratio = F.try_divide("oos_rows", "is_rows")
    return out.select("study_id", "is_rows", "oos_rows", "matched",
                      (F.col("is_rows") - F.col("matched")).alias("unmatched_is"),
                      "duplicate_ids", ratio.alias("forward_row_ratio"),
                      ((F.col("oos_rows") > 0) & (F.col("is_rows") >= 20)
                       & (F.col("oos_rows") < F.col("is_rows") - 5) & (ratio < 0.95))
                      .alias("forward_subset"))


def _paired_cells(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Cells of matched rows side by side: study_id, id, header, a (IS), b (OOS)."""
    p = pairs(ids).filter("oos_row IS NOT NULL")
    key = F.lower(F.trim("header"))
    a = cells.filter("period = 'is'").select("study_id", "row_idx", key.alias("h"),
                                             F.trim("header").alias("header"),
                                             F.col("text").alias("a"))
    b = cells.filter("period = 'oos'").select("study_id", F.col("row_idx").alias("oos_row"),
                                              key.alias("h"), F.col("text").alias("b"))
    return a.join(p, ["study_id", "row_idx"]).join(b, ["study_id", "oos_row", "h"])


def structural_parameters(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Columns equal on both periods for more than 99.9 % of the matched rows."""
    both = _paired_cells(cells, ids).filter(
        metric_role(F.col("header")).isNull() & ~is_id_header(F.col("header")))
    both = both.withColumn("_x", to_number(F.col("a"))).withColumn("_y", to_number(F.col("b")))
    a, b = F.col("_x"), F.col("_y")
    numeric = a.isNotNull() & b.isNotNull()
    ta, tb = F.coalesce(F.trim("a"), F.lit("")), F.coalesce(F.trim("b"), F.lit(""))
    counts = numeric | (ta != "") | (tb != "")
    same = F.when(numeric, F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a))).otherwise(
        ta == tb)
    g = both.filter(counts).groupBy("study_id", "header").agg(
        F.count(F.lit(1)).alias("compared"), F.avg(same.cast("int")).alias("identity_ratio"))
    return g.withColumn("is_parameter", F.col("identity_ratio") > IDENTITY_RATIO)


def single_table_parameters(cells: DataFrame) -> DataFrame:
    """Parameters of a table without forward: low-cardinality columns, with reasons."""
    n = cells.select(*ROW).distinct().groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"))
    c = cells.withColumn("header", F.trim("header")).filter(~is_id_header(F.col("header")))
    num = to_number(F.col("text"))
    txt = F.when(F.coalesce(F.trim("text"), F.lit("")) != "", F.lower(F.trim("text")))
    g = c.groupBy(*TABLE, "col_idx", "header").agg(
        F.count(num).alias("numbers"), F.count_distinct(num).alias("number_levels"),
        F.count(txt).alias("texts"), F.count_distinct(txt).alias("text_levels"))
    g = g.join(n, TABLE)
    limit = F.greatest(F.lit(2), F.least(F.lit(80), F.floor(F.col("n") / 3)))
    numeric = F.col("numbers") >= F.col("n") * 0.9
    reason = (F.when(metric_role(F.col("header")).isNotNull(), "metric")
              .when(numeric & (F.col("number_levels") > limit), "too_many_values")
              .when(~numeric & (F.col("texts") < F.col("n") * 0.9), "not_numeric")
              .when(~numeric & ((F.col("text_levels") < 2)
                                | (F.col("text_levels") > F.least(F.lit(12), limit))),
                    "useless_categories"))
    return g.select(*TABLE, "col_idx", "header", F.when(numeric, F.col("number_levels"))
                    .otherwise(F.col("text_levels")).alias("levels"),
                    reason.isNull().alias("is_parameter"), reason.alias("reason"))


def provenance(cells: DataFrame, ids: DataFrame, keep: int = 10) -> DataFrame:
    """Does the optimised Result equal the forward's Back Result, pass by pass?"""
    p = pairs(ids).filter("oos_row IS NOT NULL")
    role = metric_role(F.col("header"))
    a = cells.filter((F.col("period") == "is") & (role == "result")).select(
        "study_id", "row_idx", to_number(F.col("text")).alias("a"))
    b = cells.filter((F.col("period") == "oos") & (role == "back_result")).select(
        "study_id", F.col("row_idx").alias("oos_row"), to_number(F.col("text")).alias("b"))
    j = p.join(a, ["study_id", "row_idx"]).join(b, ["study_id", "oos_row"]).filter(
        "a IS NOT NULL AND b IS NOT NULL")
    bad = F.abs(F.col("a") - F.col("b")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("a"))
    j = j.withColumn("bad", bad)
    # The first offending ids: cut per row block, then per study.
    from .plateau import _top_k
    ids10 = _top_k(j.filter("bad").select("study_id", "row_idx", "id"), keep, []).groupBy(
        "study_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "id"))),
                                    lambda x: x["id"]).alias("ids"))
    g = j.groupBy("study_id").agg(F.count(F.lit(1)).alias("compared"),
                                  F.count_if("bad").alias("mismatches"))
    ratio = 1 - F.col("mismatches") / F.col("compared")
    return g.join(ids10, "study_id", "left").select(
        "study_id", "compared", "mismatches", ratio.alias("ratio"), "ids",
        ((F.col("compared") >= 5) & (ratio < 0.98)).alias("rejected"))


def same_period_twice(passes: DataFrame) -> DataFrame:
    """Studies whose two tables carry the same figures."""
    keys = ("profit", "profit_factor", "drawdown", "trades")
    both = lambda k: F.col("is")[k].isNotNull() & F.col("oos")[k].isNotNull()
    n = sum((both(k).cast("int") for k in keys[1:]), both(keys[0]).cast("int"))
    equal = F.lit(True)
    for k in keys:
        equal = equal & (~both(k) | (F.col("is")[k] == F.col("oos")[k]))
    r = passes.filter("oos IS NOT NULL AND is IS NOT NULL").select(
        "study_id", n.alias("_n"), equal.alias("_e")).filter("_n >= 2")
    return r.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if("_e").alias("identical")).withColumn(
        "repeated", (F.col("compared") >= 10) & (F.col("identical") / F.col("compared") >= 0.95))


def build_passes(cells: DataFrame, ids: DataFrame, params: DataFrame,
                 losers: DataFrame | None = None, joint: bool = False) -> DataFrame:
    """Records of the audit from two tables: matched, unmatched and recovered rows.

    ``params``: study_id, header of the parameters. Unmatched optimised rows stay for
    discovery unless the joint mode asks for both periods.
    """
    p = pairs(ids)
    role = metric_role(F.col("header"))
    c = cells.withColumn("role", role).withColumn("header", F.trim("header"))
    num = to_number(F.col("text"))
    picks = [F.max(F.when(F.col("role") == m, num)).alias(m) for m in METRICS]
    extra = {"result": "result", "forward_result": "forward_result", "back_result": "back_result"}
    picks += [F.max(F.when(F.col("role") == r, num)).alias(r) for r in extra]
    wide = c.filter("role IS NOT NULL").groupBy(*ROW).agg(*picks)
    m = F.struct(*METRICS)
    ours = wide.filter("period = 'is'").select("study_id", "row_idx", m.alias("is"),
                                               F.col("result").alias("criterion_is"))
    theirs = wide.filter("period = 'oos'").select(
        "study_id", F.col("row_idx").alias("oos_row"), m.alias("oos"),
        F.col("forward_result").alias("criterion_oos"), F.col("back_result"))
    value = canonical(F.col("text"))
    vec = (c.join(params.select("study_id", "header"), ["study_id", "header"])
           .groupBy(*ROW).agg(F.transform(F.sort_array(F.collect_list(F.struct(
               "header", value.alias("v"))), True), lambda x: F.struct(
               x["header"].alias("name"), x["v"]["kind"].alias("kind"),
               x["v"]["num"].alias("num"), x["v"]["txt"].alias("txt"))).alias("params")))
    out = (p.join(ours, ["study_id", "row_idx"], "left")
           .join(vec.filter("period = 'is'").drop("period"), ["study_id", "row_idx"])
           .join(theirs.drop("back_result"), ["study_id", "oos_row"], "left"))
    out = out.select("study_id", "row_idx", F.col("id").alias("pass_id"), "params", "is", "oos",
                     "criterion_is", "criterion_oos", F.col("oos_row").isNotNull()
                     .alias("oos_known"), F.lit(False).alias("lost_in_is"))
    if joint:
        out = out.filter("oos_known")
    if losers is not None:
        lost = losers.select("study_id", F.col("row_idx").alias("oos_row")).join(
            theirs, ["study_id", "oos_row"]).join(
            vec.filter("period = 'oos'").select("study_id", F.col("row_idx").alias("oos_row"),
                                                "params"), ["study_id", "oos_row"])
        none = F.struct(*[F.lit(None).cast("double").alias(k) for k in METRICS])
        out = out.unionByName(lost.select(
            "study_id", (F.col("oos_row") + (1 << 40)).alias("row_idx"),
            F.concat(F.lit("lost-"), F.col("oos_row") + 1).alias("pass_id"), "params",
            none.alias("is"), "oos", F.col("back_result").alias("criterion_is"),
            "criterion_oos", F.lit(True).alias("oos_known"), F.lit(True).alias("lost_in_is")))
    return out


def drop_unreadable(passes: DataFrame) -> DataFrame:
    """Remove rows with an unreadable parameter, then studies with too few rows."""
    ok = passes.filter(F.forall("params", lambda p: p["txt"].isNotNull()))
    n = ok.groupBy("study_id").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= MIN_ROWS).select("study_id")
    return attach(ok, n, ["study_id"], "inner", "row_idx")


def parameter_vector(passes: DataFrame) -> Column:
    return F.transform("params", lambda p: p["txt"])


def first_of_duplicates(passes: DataFrame) -> DataFrame:
    """Keep the first row of every parameter vector (map-side combine, no window)."""
    v = passes.withColumn("_v", parameter_vector(passes))
    keep = [c for c in passes.columns if c != "study_id"]
    return v.groupBy("study_id", "_v").agg(
        F.min_by(F.struct(*keep), "row_idx").alias("_r")).select("study_id", "_r.*").select(
        *passes.columns)


def result_twins(passes: DataFrame) -> DataFrame:
    """Other distinct vectors with the same profit and trades, per row."""
    r = passes.select("study_id", "row_idx", F.col("is.profit").alias("profit"),
                      F.col("is.trades").alias("trades"), parameter_vector(passes).alias("v"))
    g = r.select("study_id", "profit", "trades", "v").distinct().groupBy(
        "study_id", "profit", "trades").agg((F.count(F.lit(1)) - 1).alias("twins"))
    out = attach(r.drop("v"), g, ["study_id", "profit", "trades"], "left", "row_idx")
    return out.select("study_id", "row_idx", F.coalesce("twins", F.lit(0)).alias("twins"))


def preflight(cells: DataFrame) -> DataFrame:
    """Rows, columns, parameters, metrics and missing key metrics of every table."""
    h = headers(cells)
    rows = cells.select(*ROW).distinct().groupBy(*TABLE).agg(F.count(F.lit(1)).alias("rows"))
    cols = h.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("cols"),
                                 F.count_distinct("role").alias("metrics"))
    par = single_table_parameters(cells).filter("is_parameter").groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("params"), F.transform(F.sort_array(F.collect_list(
            F.struct("col_idx", "header"))), lambda x: x["header"]).alias("param_names"))
    miss = missing_key_metrics(h).groupBy(*TABLE).agg(
        F.sort_array(F.collect_list("role")).alias("missing"))
    return rows.join(cols, TABLE).join(par, TABLE, "left").join(miss, TABLE, "left")
