"""Local stability, plateaus, representatives, ranking and rejected peaks."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import sorted_quantile
from .ordering import attach, medians, quantiles, row_block, with_ranks
from .space import TARGET_SUPPORT


@dataclass(frozen=True)
class Thresholds:
    """Default thresholds of plateau membership."""
    min_support: float = 4
    floor_quality: float = 0.42
    min_robust: float = 50
    min_frac_pass: float = 0.9
    min_size: float = 3
    core_quality: float = 0.58
    core_robust: float = 65


FORWARD_CRITICAL = 0.65
CORE_BASIS = 3
INVERTED_PENALTY = 0.75
IRREGULAR_PENALTY = 0.85
VOLUME_CAP = 1e12
TIE_TOLERANCE = 0.05
SPAN_VALUES = 20
PEAKS_LOOKED_AT, PEAKS_KEPT = 80, 12
NODE = ["study_id", "row_idx"]


def local_stability(cells: DataFrame, edges: DataFrame, scale: DataFrame) -> DataFrame:
    """Statistics of each cell's neighbours.

    A neighbour list is bounded by the ball of the radius, so it is gathered
    once, sorted once, and every quantile and the MAD are read from that array.
    """
    pass_col = F.col("dst_passes")
    lists = edges.groupBy("study_id", F.col("src").alias("row_idx")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(pass_col).alias("_pc"),
        F.sort_array(F.collect_list("dst_score")).alias("_s"))
    rows = cells.select(*NODE, "score", "passes").join(lists, NODE, "left")
    rows = attach(rows, scale.select("study_id", "iqr", F.col("mad").alias("_gm")),
                  ["study_id"], "inner", "row_idx")
    med = sorted_quantile(F.col("_s"), 0.5)
    rows = rows.withColumn("median_nb", med).withColumn(
        "_dev", F.sort_array(F.transform("_s", lambda x: F.abs(x - F.col("median_nb")))))
    has = F.size("_s") > 0
    local = F.greatest(F.when(F.size("_s") >= 2, 1.4826 * sorted_quantile(F.col("_dev"), 0.5))
                       .otherwise(0.0), 0.5 * F.greatest(F.lit(1e-6), F.col("_gm")))
    support = F.coalesce("support", F.lit(0))
    pc = F.when(has, F.col("_pc")).otherwise(0)
    return rows.select(
        *NODE, "score", "passes", support.alias("support"), pc.alias("pass_count"),
        (support - pc).alias("fail_count"),
        F.when(has, F.col("_pc") / F.col("support")).alias("frac_pass"),
        sorted_quantile(F.col("_s"), 0.25).alias("q25"),
        sorted_quantile(F.col("_s"), 0.1).alias("q10"), "median_nb",
        F.get("_s", F.lit(0)).alias("worst"),
        F.when(has & F.col("score").isNotNull(), F.greatest(
            F.lit(0.0), F.col("score") - F.get("_s", F.lit(0))) / F.col("iqr")).alias("cliff"),
        F.when(has, (F.col("score") - F.col("median_nb")) / local).alias("peak_z"))


def with_goal(stab: DataFrame, radius: DataFrame, target: int = TARGET_SUPPORT,
              min_support: float = 4) -> DataFrame:
    """Add ``goal``, the support that counts as enough in the study."""
    r = attach(stab, radius.select("study_id", "median_support"), ["study_id"], "left", "row_idx")
    goal = F.when(F.col("median_support") > 0, F.least(F.lit(float(target)), F.greatest(
        F.lit(float(min_support)), F.col("median_support")))).otherwise(float(target))
    return r.withColumn("goal", goal).drop("median_support")


def robust_value(frac_pass: Column, goal: Column) -> Column:
    """Score of a passing row from the columns score, q25, cliff, peak_z and support."""
    core = (F.pow(F.greatest(F.lit(0.0), F.col("score")), F.lit(0.3))
            * F.pow(F.greatest(F.lit(0.0), F.col("q25")), F.lit(0.4))
            * F.pow(F.coalesce(frac_pass, F.lit(0.0)), F.lit(0.3)))
    soften = lambda x, free: 1 / (1 + F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)) - free))
    value = (100 * core * soften(F.col("cliff"), 1.5) * soften(F.col("peak_z"), 2.0)
             * F.least(F.lit(1.0), F.col("support") / goal))
    return F.when(F.col("score").isNotNull() & F.col("q25").isNotNull(), value)


def robustness(stab: DataFrame, radius: DataFrame, target: int = TARGET_SUPPORT,
               min_support: float = 4) -> DataFrame:
    """0-100 score: own quality, floor and pass share of the surroundings, penalties."""
    r = with_goal(stab, radius, target, min_support)
    value = robust_value(F.col("frac_pass"), F.col("goal"))
    return r.withColumn("robust", F.when(value.isNotNull(), F.when(
        F.col("passes"), value).otherwise(0.0))).drop("goal")


def threshold_columns(t: Thresholds) -> dict[str, Column]:
    return {k: F.lit(float(v)) for k, v in asdict(t).items()}


def is_candidate(t: dict[str, Column]) -> Column:
    return F.coalesce(
        F.col("passes") & (F.col("support") >= t["min_support"])
        & (F.col("q25") >= t["floor_quality"]) & (F.col("frac_pass") >= t["min_frac_pass"])
        & (F.col("robust") >= t["min_robust"]), F.lit(False))


def is_core(t: dict[str, Column]) -> Column:
    return F.coalesce((F.col("q25") >= t["core_quality"]) & (F.col("robust") >= t["core_robust"]),
                      F.lit(False))


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], stage,
               max_rounds: int = 60) -> DataFrame:
    """Connected components: (keys, row_idx, component), component = smallest node.

    Alternating star contraction. Every round points a node's neighbours to the
    smallest one; the number of rounds is logarithmic in the size of a component.
    A hub is spread over row blocks, so no node gathers all its edges in one
    task. Each round is a written table, and only a count comes to the driver.
    """
    keys = list(keys)
    e = stage(edges.select(*keys, F.col("src").cast("long").alias("u"),
                           F.col("dst").cast("long").alias("v")).filter("u <> v").distinct(),
              "cc0")

    def smallest(df: DataFrame) -> DataFrame:
        """Attach to each (u, v) the smallest node around u, hub-safe."""
        df = df.withColumn("_blk", row_block("v"))
        part = df.groupBy(*keys, "u", "_blk").agg(F.min("v").alias("m"))
        best = part.groupBy(*keys, "u").agg(F.least(F.min("m"), F.col("u")).alias("m"))
        back = part.drop("m").join(best, [*keys, "u"])
        return df.join(back, [*keys, "u", "_blk"]).drop("_blk")

    def flip(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))

    for round_no in range(1, max_rounds + 1):
        if e.isEmpty():
            break
        both = e.unionByName(flip(e)).distinct()
        large = (smallest(both).filter("v > u").select(*keys, F.col("v").alias("u"),
                                                       F.col("m").alias("v")).distinct())
        down = large.filter("u > v")
        small = smallest(down)
        nxt = (small.select(*keys, F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select(*keys, "e.u", "e.v").filter("u <> v").distinct())
        nxt = stage(nxt, f"cc{round_no}")
        # A star forest is a fixed point: every node points to a root that points nowhere.
        loose = nxt.join(nxt.select(*keys, F.col("u").alias("v")).distinct(), [*keys, "v"],
                         "left_semi")
        several = nxt.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        e = nxt
        if loose.isEmpty() and several.isEmpty():
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    labels = e.select(*keys, F.col("u").alias("row_idx"), F.col("v").alias("component"))
    return (nodes.select(*keys, "row_idx").join(labels, [*keys, "row_idx"], "left")
            .withColumn("component", F.coalesce("component", "row_idx")))


def plateau_members(stab: DataFrame, edges: DataFrame, stage, keys: list[str] = ["study_id"],
                    thresholds: dict[str, Column] | None = None,
                    min_size: Column | None = None) -> DataFrame:
    """Members of components of candidates with at least the minimum size."""
    t = thresholds or threshold_columns(Thresholds())
    cand = stab.filter(is_candidate(t)).withColumn("core", is_core(t)).withColumn(
        "_min", min_size if min_size is not None else t["min_size"])
    cand = stage(cand, "candidates")
    ids = cand.select(*keys, "row_idx")
    e = edges.select(*[k for k in keys if k in edges.columns], "src", "dst").join(
        ids.withColumnRenamed("row_idx", "src"),
        [*[k for k in keys if k in edges.columns], "src"])
    e = e.join(ids.withColumnRenamed("row_idx", "dst"), [*keys, "dst"], "left_semi")
    comp = components(ids, e, keys, stage)
    size = comp.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    m = cand.join(comp, [*keys, "row_idx"])
    m = attach(m, size, [*keys, "component"], "inner", "row_idx")
    return m.filter(F.col("size") >= F.col("_min")).drop("_min")


def rank_fraction(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Mid-rank in [0, 1] among the rows with a value; 0 without one, 1 when alone."""
    r = with_ranks(rows, ["study_id"], value, "row_idx", "_f")
    mid = (F.col("_f_below") + (F.col("_f_ties") - 1) / 2) / (F.col("_f_n") - 1)
    return r.withColumn(out, F.when(F.col("_f_n").isNull(), 0.0).when(
        F.col("_f_n") == 1, 1.0).otherwise(mid)).drop("_f_n", "_f_below", "_f_ties")


def joint_rank(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean of the summed rank fractions of a cell and its neighbours."""
    base = cells.select(*NODE, "quality_is", F.when(
        F.col("known"), F.col("quality_oos")).alias("quality_oos"))
    r = rank_fraction(base, "quality_is", "r_is")
    r = rank_fraction(r, "quality_oos", "r_oos")
    r = r.select(*NODE, (F.col("r_is") + F.col("r_oos")).alias("joint"))
    around = edges.select("study_id", F.col("src").alias("to"), F.col("dst").alias("row_idx"))
    own = r.select("study_id", F.col("row_idx").alias("to"), "row_idx")
    return (around.unionByName(own).join(r, NODE).groupBy("study_id", "to")
            .agg(F.avg("joint").alias("joint_score"))
            .withColumnRenamed("to", "row_idx"))


def _first_best(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Best row per key with map-side combine; ties go to the smallest row."""
    best = F.max_by(F.struct(*keep), F.struct(*order, -F.col("row_idx")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def representative_joint(members: DataFrame, cells: DataFrame, joint: DataFrame,
                         keys: list[str] = ["study_id"]) -> DataFrame:
    """Best joint rank; core members when there are three, tested ones when any."""
    m = members.join(cells.select(*NODE, "known"), NODE).join(joint, NODE)
    core = m.groupBy(*keys, "component").agg(F.count_if("core").alias("core_size"))
    m = attach(m, core, [*keys, "component"], "inner", "row_idx")
    basis = m.filter((F.col("core_size") < CORE_BASIS) | F.col("core"))
    return _first_best(basis, [*keys, "component"],
                       [F.col("known").cast("int"), F.col("joint_score")],
                       ["row_idx", "joint_score", "core_size"])


def _around_members(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Per member: worst and mean quality around it and the share inside its plateau."""
    m = members.select(*NODE, "component", "score", "robust")
    near = m.select(*NODE, "component").join(
        edges.select("study_id", F.col("src").alias("row_idx"), "dst", "dst_score"), NODE)
    near = near.join(m.select("study_id", F.col("row_idx").alias("dst"),
                              F.col("component").alias("_c")), ["study_id", "dst"], "left")
    per = near.groupBy(*NODE).agg(
        F.min("dst_score").alias("_w"), F.sum(F.coalesce("dst_score", F.lit(0.0))).alias("_s"),
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_c") == F.col("component")).alias("_i"))
    own = F.coalesce("score", F.lit(0.0))
    return m.join(per, NODE, "left").select(
        *NODE, "component",
        F.least(own, F.coalesce("_w", own)).alias("worst_around"),
        ((own + F.coalesce("_s", F.lit(0.0))) / (F.coalesce("_n", F.lit(0)) + 1))
        .alias("mean_around"),
        F.coalesce(F.col("_i") / F.col("_n"), F.lit(0.0)).alias("interior"),
        F.coalesce("robust", F.lit(0.0)).alias("robust"))


def representative_maximin(members: DataFrame, edges: DataFrame) -> DataFrame:
    a = _around_members(members, edges)
    return _first_best(a, ["study_id", "component"],
                       [F.col("worst_around"), F.col("interior"), F.col("robust")],
                       ["row_idx", "worst_around", "interior", "robust"])


def representative_mean(members: DataFrame, edges: DataFrame) -> DataFrame:
    a = _around_members(members, edges)
    return _first_best(a, ["study_id", "component"],
                       [F.col("mean_around"), F.col("interior"), F.col("robust")],
                       ["row_idx", "mean_around", "interior", "robust"])


def extent(members: DataFrame, cells: DataFrame, dims: DataFrame,
           keys: list[str] = ["study_id"]) -> DataFrame:
    """Width per distance axis, bounding volume, occupancy and effective size."""
    m = members.select(*keys, "row_idx", "component").join(
        cells.select(*NODE, "coords"), NODE)
    axes = F.when(F.size("active_dims") > 0, F.col("active_dims")).otherwise(F.col("block_dims"))
    m = attach(m, dims.select("study_id", axes.alias("axes")), ["study_id"], "inner", "row_idx")
    long = m.select(*keys, "component", "row_idx", "coords", F.explode("axes").alias("dim"))
    long = long.withColumn("z", F.get("coords", F.col("dim"))).filter("z >= 0")
    per = long.groupBy(*keys, "component", "dim").agg(
        F.min("z").alias("lo"), F.max("z").alias("hi"), F.count_distinct("z").alias("levels"),
        F.count(F.lit(1)).alias("size"))
    width = F.col("hi") - F.col("lo") + 1
    out = per.groupBy(*keys, "component").agg(
        F.aggregate(F.collect_list(width.cast("double")), F.lit(1.0),
                    lambda a, w: F.least(a * w, F.lit(VOLUME_CAP))).alias("volume"),
        F.exp(F.avg(F.ln(F.greatest(F.lit(1), width)))).alias("typical_width"),
        F.max("size").alias("size"),
        F.transform(F.sort_array(F.collect_list(F.struct("dim", width.alias("w"), "levels"))),
                    lambda s: s["w"]).alias("widths"))
    return out.select(*keys, "component", "volume", "typical_width", "widths",
                      (F.col("size") / F.col("volume")).alias("occupancy"),
                      F.greatest(F.lit(1.0), F.least(F.col("size").cast("double"), "volume"))
                      .alias("effective_size"))


def boundary_touch(points: DataFrame, cells: DataFrame, roles: DataFrame) -> DataFrame:
    """Numeric, non-flat parameters whose first or last level the points touch."""
    m = points.join(cells.select(*NODE, "coords"), NODE).select(
        "study_id", "component", "row_idx", F.posexplode("coords").alias("dim", "z"))
    live = roles.filter("type = 'number' AND n_levels > 1 AND role <> 'flat'").select(
        "study_id", "dim", "name", "n_levels")
    m = attach(m, live, ["study_id", "dim"], "inner", "row_idx")
    return (m.groupBy("study_id", "component", "dim", "name").agg(
        F.max(F.col("z") == 0).alias("at_min"),
        F.max(F.col("z") == F.col("n_levels") - 1).alias("at_max"))
        .filter("at_min OR at_max"))


def parameter_span(members: DataFrame, passes: DataFrame) -> DataFrame:
    """Numeric range per parameter, or the value set (up to 20) of the others."""
    long = members.select(*NODE, "component").join(passes.select(*NODE, "params"), NODE).select(
        "study_id", "component", F.posexplode("params").alias("dim", "p")).select(
        "study_id", "component", "dim", "p.*")
    g = long.groupBy("study_id", "component", "dim", "name")
    values = g.agg(
        F.count_if(F.col("kind") != "number").alias("_other"), F.min("num").alias("lo"),
        F.max("num").alias("hi"), F.sort_array(F.collect_set("txt")).alias("_set"))
    number = F.col("_other") == 0
    return values.select("study_id", "component", "dim", "name",
                         F.when(number, F.col("lo")).alias("lo"),
                         F.when(number, F.col("hi")).alias("hi"),
                         F.when(~number & (F.size("_set") <= SPAN_VALUES), F.col("_set"))
                         .alias("values"))


def plateau_summary(members: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts, score spread and period medians of every plateau."""
    m = members.select(*NODE, "component", "core", "score").join(
        cells.select(*NODE, "quality_is", "quality_oos", "retention"), NODE)
    keys = ["study_id", "component"]
    base = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.count_if("core").alias("core_size"),
        F.min("score").alias("worst_score"))
    q = quantiles(m, keys, "score", {"q10_score": 0.1, "_a": 0.25, "median_score": 0.5,
                                     "_b": 0.75})
    med = medians(m, keys, {"median_is": "quality_is", "median_oos": "quality_oos",
                            "median_retention": "retention"})
    return base.join(q, keys, "left").join(med, keys, "left").select(
        *keys, "size", "core_size", "worst_score", "q10_score", "median_score",
        (F.col("_b") - F.col("_a")).alias("coherence"), "median_is", "median_oos",
        "median_retention")


def forward_validation(members: DataFrame, cells: DataFrame,
                       keys: list[str] = ["study_id"]) -> DataFrame:
    """Share of members that meet the forward limits, among tested and among all."""
    m = members.select(*keys, "row_idx", "component").join(
        cells.select(*NODE, "known", "has_forward", "fails_oos"), NODE)
    ok = F.col("known") & (F.size("fails_oos") == 0)
    return m.groupBy(*keys, "component").agg(
        F.max("has_forward").alias("has_forward"), F.count_if("known").alias("with_forward"),
        F.count_if(ok).alias("validated"), F.count(F.lit(1)).alias("members")).select(
        *keys, "component", "with_forward",
        F.when(F.col("has_forward"), F.coalesce(
            F.try_divide("validated", "with_forward"), F.lit(0.0))).alias("pass_frac"),
        F.when(F.col("has_forward"), F.col("validated") / F.col("members"))
        .alias("validated_frac"))


def evidence_factor(support: Column, target: int = TARGET_SUPPORT) -> Column:
    full = F.least(F.lit(1.0), F.log1p(support) / F.log1p(F.lit(3.0 * target)))
    return F.when(support > 0, 0.6 + 0.4 * full).otherwise(0.6)


def rank_score(q10: Column, size: Column, support: Column, inverted: Column, irregular: Column,
               validated: Column, rank_forward: str = "soft") -> Column:
    s = (F.greatest(F.lit(0.0), q10) * F.log1p(size) * evidence_factor(support)
         * F.when(inverted, INVERTED_PENALTY).otherwise(1.0)
         * F.when(irregular, IRREGULAR_PENALTY).otherwise(1.0))
    if rank_forward == "soft":
        return s * F.when(validated.isNotNull(), 0.35 + 0.65 * validated).otherwise(1.0)
    if rank_forward == "strong":
        return s * F.coalesce(validated, F.lit(1.0))
    return s


def period_inversions(cells: DataFrame, lv: DataFrame, scale: DataFrame,
                      min_per_level: int = 10, share: float = 0.25) -> DataFrame:
    """Parameters whose optimised best level costs quality in the forward."""
    known = cells.filter("known")
    spread = quantiles(known.filter("passes_discover"), ["study_id"], "quality_is",
                       {"_a": 0.25, "_b": 0.75}, count="_n")
    unit = (scale.select("study_id", "iqr").join(spread, "study_id", "left")
            .select("study_id", F.when(F.col("_n") >= 30, F.greatest(
                F.lit(0.02), F.col("_b") - F.col("_a"))).otherwise(F.col("iqr")).alias("unit")))
    long = cells.filter("has_forward").select(
        *NODE, F.when(F.col("known"), F.col("quality_is")).alias("quality_is"), "quality_oos",
        F.posexplode("coords").alias("dim", "pos")).filter("pos >= 0")
    keys = ["study_id", "dim", "pos"]
    a = quantiles(long, keys, "quality_is", {"m_is": 0.5}, count="n_is")
    b = quantiles(long, keys, "quality_oos", {"m_oos": 0.5}, count="n_oos")
    usable = a.join(b, keys).filter(
        (F.col("n_is") >= min_per_level) & (F.col("n_oos") >= min_per_level))
    # The levels of one parameter are few: ranks over them are small windows.
    by = lambda c: Window.partitionBy("study_id", "dim").orderBy(c, "pos")
    usable = (usable.withColumn("r_is", F.row_number().over(by("m_is")))
              .withColumn("r_oos", F.row_number().over(by("m_oos"))))
    first = lambda v, by_col: F.max_by(v, F.struct(by_col, -F.col("pos")))
    prof = usable.groupBy("study_id", "dim").agg(
        F.count(F.lit(1)).alias("levels"),
        (F.max("m_is") - F.min("m_is")).alias("swing_is"),
        (F.max("m_oos") - F.min("m_oos")).alias("swing_oos"),
        first("pos", F.col("m_is")).alias("best_is"), first("pos", F.col("m_oos"))
        .alias("best_oos"),
        (F.max("m_oos") - first("m_oos", F.col("m_is"))).alias("regret"),
        F.coalesce(F.corr("r_is", "r_oos"), F.lit(0.0)).alias("rho"))
    names = lv.select("study_id", "dim", F.col("pos"), "name", "txt")
    out = prof.filter("levels >= 2").join(unit, "study_id").filter(
        (F.col("swing_is") >= share * F.col("unit")) & (F.col("regret") >= share * F.col("unit")))
    out = out.join(names.select("study_id", "dim", F.col("pos").alias("best_is"), "name",
                                F.col("txt").alias("best_is_value")),
                   ["study_id", "dim", "best_is"])
    out = out.join(names.select("study_id", "dim", F.col("pos").alias("best_oos"),
                                F.col("txt").alias("best_oos_value")),
                   ["study_id", "dim", "best_oos"])
    return out.select("study_id", "dim", "name", "rho", "regret",
                      F.when(F.col("swing_oos") > 0, F.col("regret") / F.col("swing_oos"))
                      .otherwise(0.0).alias("regret_share"), "swing_is", "swing_oos",
                      "best_is", "best_is_value", "best_oos_value")


def irregular_span(members: DataFrame, cells: DataFrame, jumps: DataFrame,
                   keys: list[str] = ["study_id"]) -> DataFrame:
    """Plateaus that occupy both ends of an oversized grid jump, per parameter."""
    m = members.select(*keys, "row_idx", "component").join(cells.select(*NODE, "coords"), NODE)
    j = jumps.select("study_id", "dim", F.col("name").alias("jump_name"), "from_pos", "to_pos")
    long = m.select(*keys, "component", "row_idx", F.posexplode("coords").alias("dim", "z"))
    long = long.groupBy(*keys, "component", "dim", "z").agg(F.count(F.lit(1)).alias("c"))
    hit = long.join(j, ["study_id", "dim"]).groupBy(
        *keys, "component", "dim", "jump_name", "from_pos", "to_pos").agg(
        F.max(F.col("z") == F.col("from_pos")).alias("a"),
        F.max(F.col("z") == F.col("to_pos")).alias("b")).filter("a AND b")
    return hit.groupBy(*keys, "component").agg(
        F.sort_array(F.collect_set("jump_name")).alias("irregular_names"))


def inverted_risk(reps: DataFrame, cells: DataFrame, inversions: DataFrame,
                  keys: list[str] = ["study_id"]) -> DataFrame:
    """Representatives that sit on the optimised best level of an inverted parameter."""
    r = reps.select(*keys, "component", "row_idx").join(
        cells.select(*NODE, "coords"), NODE)
    hit = r.join(inversions.select("study_id", F.col("dim").alias("_d"), F.col("name"),
                                   "best_is"), "study_id").filter(
        F.get("coords", F.col("_d")) == F.col("best_is"))
    return hit.groupBy(*keys, "component").agg(
        F.sort_array(F.collect_set("name")).alias("inverted_names"))


def rank_plateaus(summary: DataFrame, reps: DataFrame, stab: DataFrame, ext: DataFrame,
                  forward: DataFrame, irregular: DataFrame, inverted: DataFrame,
                  rank_forward: str = "soft", keys: list[str] = ["study_id"]) -> DataFrame:
    """Rank score and place of every plateau of a study."""
    k = [*keys, "component"]
    support = reps.select(*k, "row_idx").join(
        stab.select(*[c for c in keys if c in stab.columns], "row_idx", "support", "robust"),
        [*[c for c in keys if c in stab.columns], "row_idx"])
    p = (summary.join(support.withColumnRenamed("row_idx", "representative"), k)
         .join(ext.select(*k, "effective_size"), k, "left")
         .join(forward, k, "left").join(irregular, k, "left").join(inverted, k, "left"))
    p = (p.withColumn("irregular", F.col("irregular_names").isNotNull())
         .withColumn("inverted", F.col("inverted_names").isNotNull()))
    p = p.withColumn("rank_score", rank_score(
        F.col("q10_score"), F.coalesce("effective_size", F.lit(1.0)), F.col("support"),
        F.col("inverted"), F.col("irregular"), F.col("validated_frac"), rank_forward))
    # Plateaus of a study are few; ties keep the order of their first row.
    w = Window.partitionBy(*keys).orderBy(F.desc("rank_score"), "component")
    return p.withColumn("rank", F.row_number().over(w))


def ties(ranked: DataFrame) -> DataFrame:
    """Plateaus within 5 % of the best of their study (two or more)."""
    w = Window.partitionBy("study_id")
    near = ranked.withColumn("_best", F.max("rank_score").over(w)).filter(
        (F.col("_best") > 0) & (F.col("rank_score") >= F.col("_best") * (1 - TIE_TOLERANCE)))
    return near.withColumn("tied", F.count(F.lit(1)).over(w)).filter("tied > 1").drop("_best")


def reject_tags(t: Thresholds = Thresholds()) -> Column:
    """Why a row that looks good is not part of a plateau."""
    tags = F.filter(F.array(
        F.when(F.col("support") < t.min_support, "few_neighbours"),
        F.when(F.col("peak_z") > 2, "isolated_peak"),
        F.when(F.col("cliff") > 1.5, "cliff"),
        F.when(~F.col("passes") | (F.size("fails_oos") > 0), "misses_limits"),
        F.when(F.col("frac_pass") < t.min_frac_pass, "failing_neighbours"),
        F.when(F.col("q25") < t.floor_quality, "weak_neighbours")), lambda x: x.isNotNull())
    last = F.when(F.col("robust") >= t.min_robust, "zone_too_small").otherwise("low_robustness")
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(last))


def _top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """First ``k`` rows per study, cut inside each row block before the study window."""
    inner = Window.partitionBy("study_id", row_block("row_idx")).orderBy(*order, "row_idx")
    outer = Window.partitionBy("study_id").orderBy(*order, "row_idx")
    return (df.withColumn("_in", F.row_number().over(inner)).filter(F.col("_in") <= k)
            .withColumn("place", F.row_number().over(outer)).filter(F.col("place") <= k)
            .drop("_in"))


def rejected_peaks(cells: DataFrame, stab: DataFrame, members: DataFrame,
                   thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Rows the user's own criterion puts on top and no plateau contains."""
    has = cells.groupBy("study_id").agg(
        F.max(F.col("known") & F.col("criterion_oos").isNotNull()).alias("_oos"),
        F.max(F.col("criterion_is").isNotNull()).alias("_is"))
    r = attach(cells, has, ["study_id"], "inner", "row_idx")
    key = (F.when(F.col("_oos"), F.when(F.col("known"), F.col("criterion_oos")))
           .when(F.col("_is"), F.col("criterion_is")).otherwise(F.col("score")))
    basis = F.when(F.col("_oos"), "oos").when(F.col("_is"), "is").otherwise("quality")
    r = r.select(*NODE, "fails_oos", key.alias("key"), basis.alias("ranking_by")).filter("key IS NOT NULL")
    top = _top_k(r, PEAKS_LOOKED_AT, [F.desc("key")]).withColumnRenamed("place", "criterion_rank")
    out = top.join(members.select(*NODE), NODE, "left_anti").join(
        stab.select(*NODE, "score", "passes", "support", "q25", "frac_pass", "cliff", "peak_z",
                    "robust"), NODE)
    w = Window.partitionBy("study_id").orderBy("criterion_rank")
    return (out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= PEAKS_KEPT)
            .withColumn("tags", reject_tags(thresholds)).drop("_n"))


def fallback(cells: DataFrame, joint: DataFrame, plateaus: DataFrame) -> DataFrame:
    """Best joint rank of studies without a plateau: meeting both periods, else tested."""
    pool = (cells.filter(F.col("has_forward") & (F.col("passes_joint")
                                                 | (F.col("known") & F.col("passes"))))
            .join(plateaus.select("study_id").distinct(), "study_id", "left_anti")
            .join(joint, NODE))
    return _first_best(pool, ["study_id"], [F.col("passes_joint").cast("int"),
                                            F.col("joint_score")],
                       ["row_idx", "pass_id", "joint_score", "passes_joint"])


def coarse_cells(cells: DataFrame, dims: DataFrame, radius: DataFrame) -> DataFrame:
    """Block key of every cell at the grain of its neighbourhood (radius + 1)."""
    side = dims.select("study_id", "active_dims").join(radius.select("study_id", "radius"),
                                                       "study_id")
    r = attach(cells.select(*NODE, "coords"), side, ["study_id"], "inner", "row_idx")
    z = F.when(F.size("active_dims") > 0, F.transform(
        "active_dims", lambda d: F.get("coords", d))).otherwise(F.col("coords"))
    return r.select(*NODE, F.transform(z, lambda v: F.floor(v / (F.col("radius") + 1)))
                    .alias("coarse"))


def effective_trials(coarse: DataFrame) -> DataFrame:
    return coarse.select("study_id", "coarse").distinct().groupBy("study_id").agg(
        F.greatest(F.lit(2), F.count(F.lit(1))).alias("effective_trials"))


def period_comparison(cells: DataFrame) -> DataFrame:
    k = cells.filter("known")
    med = medians(k, ["study_id"], {"median_quality_is": "quality_is",
                                    "median_quality_oos": "quality_oos"})
    share = k.groupBy("study_id").agg(
        F.avg((F.size("fails_is") == 0).cast("int")).alias("pass_is"),
        F.avg((F.size("fails_oos") == 0).cast("int")).alias("pass_oos"))
    return med.join(share, "study_id")


def power_check(cells: DataFrame, radius: DataFrame, plateaus: DataFrame,
                t: Thresholds = Thresholds()) -> DataFrame:
    """Whether a study without plateaus had enough passing rows to show one."""
    n = cells.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passes_joint").alias("gate_pass"),
        F.count_if("passes").alias("search_pass"))
    found = plateaus.groupBy("study_id").agg(F.count(F.lit(1)).alias("plateaus"))
    need = F.ceil(t.min_size * (1 + F.greatest(
        F.lit(float(t.min_support)), F.coalesce("median_support", F.lit(0.0)))
        * t.min_frac_pass))
    out = (n.join(radius.select("study_id", "median_support"), "study_id")
           .join(found, "study_id", "left").withColumn("plateaus", F.coalesce(
               "plateaus", F.lit(0))))
    return out.select("study_id", "total", "gate_pass", "search_pass", "plateaus",
                      need.alias("viable_needed"),
                      ((F.col("plateaus") == 0) & (F.col("search_pass") > 0)
                       & (F.col("search_pass") < need)).alias("underpowered"))


def alternatives(ranked: DataFrame) -> DataFrame:
    """Top three plateaus, and the best one without inverted risk when the first has it."""
    w = Window.partitionBy("study_id")
    first = F.max(F.when(F.col("rank") == 1, F.col("inverted"))).over(w)
    safe = F.min(F.when((F.col("rank") > 1) & ~F.col("inverted"), F.col("rank"))).over(w)
    r = ranked.withColumn("_f", first).withColumn("_s", safe)
    return r.withColumn("safe_alternative", F.coalesce(
        F.col("_f") & (F.col("rank") == F.col("_s")), F.lit(False))).filter(
        "rank <= 3 OR safe_alternative").drop("_f", "_s")


def stable_ranges(ranked: DataFrame, spans: DataFrame, roles: DataFrame) -> DataFrame:
    """Span of the first plateau per parameter, ordered by influence."""
    first = ranked.filter("rank = 1").select("study_id", "component")
    w = Window.partitionBy("study_id").orderBy(F.desc("effective"), "dim")
    infl = roles.filter("n_levels > 1").withColumn("influence_rank", F.row_number().over(w))
    return spans.join(first, ["study_id", "component"]).join(
        infl.select("study_id", "dim", "effective", "influence_rank", "role"),
        ["study_id", "dim"], "left")
