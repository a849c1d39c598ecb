"""Does the recommendation survive other thresholds and other gates? All draws at once, as bits.

A BIGINT per cell holds one bit a draw. Passing neighbours are counted for all draws by one pass over
the edges: bits are spread over lanes of a BIGINT and lanes are added (``LANE_BITS`` bits hold the
counts of more neighbours than a cell can have). Candidates and core are bits again; draws of one
study with the same candidates, core, forward results and least size have the same plateaus, so
each such set is joined, grown into plateaus and ranked once and counted as often as it was drawn.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import uniform
from . import plateau as P
from .ordering import attach, quantiles
from .quality import gate_failures

# Seeds and numbers of the draws.
THRESHOLD_SEED = 20260920
GATE_SEED = 20260921
PERTURBATION = 0.2
KEYS = ("floor_quality", "min_robust", "min_frac_pass", "core_quality", "core_robust",
        "min_support", "min_size")
JOINT_DRAWS = 36
GATE_DRAWS = 24
LANES, LANE_BITS = 3, 21


def threshold_draws(spark, base: P.Thresholds = P.Thresholds(), seed: int = THRESHOLD_SEED,
                    joint: int = JOINT_DRAWS) -> DataFrame:
    """One row per draw: 14 one-at-a-time moves of 20 % and the joint random moves.

    The pass share moves on its distance to 1, so it can never leave [0, 1].
    """
    lo, hi = 1 - PERTURBATION, 1 + PERTURBATION
    d = F.col("draw_id")
    n_single = 2 * len(KEYS)
    cols = []
    for i, key in enumerate(KEYS):
        single = (F.when(d == 2 * i, F.lit(lo)).when(d == 2 * i + 1, F.lit(hi)).otherwise(1.0))
        rnd = lo + 2 * PERTURBATION * uniform(seed, (d - n_single) * len(KEYS) + i + 1)
        factor = F.when(d < n_single, single).otherwise(rnd)
        value = float(getattr(base, key))
        cols.append((1 - (1 - value) * factor if key == "min_frac_pass" else value * factor)
                    .alias(key))
    return spark.range(n_single + joint).withColumnRenamed("id", "draw_id").select("draw_id", *cols)


def gate_draws(spark, seed: int = GATE_SEED, total: int = GATE_DRAWS) -> DataFrame:
    """One row per draw of the gate factors (profit factor, drawdown, trades)."""
    lo, hi = 1 - PERTURBATION, 1 + PERTURBATION
    d = F.col("draw_id")
    cols = []
    for i, name in enumerate(("f_pf", "f_dd", "f_tr")):
        single = F.when(d == i, F.lit(lo)).when(d == 3 + i, F.lit(hi)).otherwise(1.0)
        rnd = lo + 2 * PERTURBATION * uniform(seed, (d - 6) * 3 + i + 1)
        cols.append(F.when(d < 6, single).otherwise(rnd).alias(name))
    return spark.range(total).withColumnRenamed("id", "draw_id").select("draw_id", *cols)


# ------------------------------------------------------------------------- bits
def bit(mask: Column, i: int | Column) -> Column:
    return F.call_function("shiftright", mask, F.lit(i) if isinstance(i, int) else i).bitwiseAND(
        F.lit(1).cast("long")) == 1


def bits(draws: list[dict], rule: Callable[[Column], Column]) -> Column:
    """A BIGINT whose bit i says whether ``rule`` holds for the i-th of at most 63 draws.

    A draw is a few constants; inside ``rule`` it is a struct with one more field, its place ``at``.
    """
    if len(draws) > 63:
        raise ValueError("a BIGINT has bits for 63 draws")
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in d.items()], F.lit(i).alias("at"),
                               F.lit(1 << i).cast("long").alias("bit")) for i, d in enumerate(draws)])
    return F.aggregate(table, F.lit(0).cast("long"), lambda mask, d: F.when(
        F.coalesce(rule(d), F.lit(False)), mask.bitwiseOR(d["bit"])).otherwise(mask))


def lane_sums(mask: Column, draws: int) -> list[Column]:
    """Sums that count the set bits of every draw: ``LANES`` counters in each BIGINT."""
    out = []
    for lo in range(0, draws, LANES):
        spread = F.lit(0).cast("long")
        for k in range(min(LANES, draws - lo)):
            one = F.shiftright(mask, lo + k).bitwiseAND(F.lit(1).cast("long"))
            spread = spread.bitwiseOR(F.shiftleft(one, k * LANE_BITS))
        out.append(F.sum(spread).alias(f"lanes{lo // LANES}"))
    return out


def lane_counts(draws: int) -> Column:
    """The counts of all draws, from the columns of :func:`lane_sums`."""
    return F.array(*[F.shiftright(F.col(f"lanes{i // LANES}"), LANE_BITS * (i % LANES)).bitwiseAND(
        F.lit((1 << LANE_BITS) - 1).cast("long")) for i in range(draws)])


# ---------------------------------------------------------------------- winners
def _apart(rows: DataFrame, min_sizes: list[float]) -> DataFrame:
    """(study_id, draw_id, weight): one draw of each set of draws with the same plateaus."""
    marks = []
    for i in range(len(min_sizes)):
        h = F.xxhash64("row_idx", bit(F.col("core"), i), bit(F.col("ok"), i))
        marks.append(F.bit_xor(F.when(bit(F.col("cand"), i), h)).alias(f"m{i}"))
    per = rows.groupBy("study_id").agg(*marks)
    long = per.select("study_id", F.explode(F.array(*[F.struct(
        F.lit(i).alias("draw_id"), F.col(f"m{i}").alias("mark"), F.lit(float(s)).alias("least"))
        for i, s in enumerate(min_sizes)])).alias("d")).select("study_id", "d.*")
    # A draw without candidates has no plateau.
    return (long.filter("mark IS NOT NULL").groupBy("study_id", "mark", "least")
            .agg(F.min("draw_id").alias("draw_id"), F.count(F.lit(1)).alias("weight"))
            .select("study_id", "draw_id", "weight"))


def _winners(rows: DataFrame, min_sizes: list[float], audit, stage) -> DataFrame:
    """(study_id, representative, weight): first plateau of every set of draws.

    ``rows``: study_id, row_idx, score, support, has_forward and the bits cand, core and ok.
    """
    keys = ["study_id", "draw_id"]
    rows = stage(rows.filter("cand <> 0"), "draw_bits")
    apart = stage(_apart(rows, min_sizes), "draws_apart")
    kept = apart.groupBy("study_id").agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("draw_id"))).alias("kept"))
    rows = attach(rows, kept, ["study_id"], "inner", "row_idx").withColumn(
        "cand", F.col("cand").bitwiseAND(F.col("kept")))
    each = lambda mask: F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(len(min_sizes) - 1)), lambda i: bit(mask, i)))
    ends = rows.select("study_id", "row_idx", "cand")
    e = (audit.edges.select("study_id", "src", "dst")
         .join(ends.select("study_id", F.col("row_idx").alias("src"), F.col("cand").alias("a")),
               ["study_id", "src"])
         .join(ends.select("study_id", F.col("row_idx").alias("dst"), F.col("cand").alias("b")),
               ["study_id", "dst"])
         .withColumn("both", F.col("a").bitwiseAND(F.col("b"))).filter("both <> 0")
         .select("study_id", each(F.col("both")).alias("draw_id"), "src", "dst"))
    cand = rows.withColumn("draw_id", each(F.col("cand")))
    cand = stage(cand.select(*keys, "row_idx", "score", "support", "has_forward",
                             bit(F.col("core"), F.col("draw_id")).alias("core"),
                             bit(F.col("ok"), F.col("draw_id")).alias("ok")), "draw_rows")
    comp = P.components(cand.select(*keys, "row_idx"), e, keys, stage)
    k = [*keys, "component"]
    least = F.element_at(F.array(*[F.lit(float(s)) for s in min_sizes]), F.col("draw_id") + 1)
    size = (comp.groupBy(*k).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
            .select(*k, "size"))
    m = stage(attach(cand.join(comp, [*keys, "row_idx"]), size, k, "inner", "row_idx"), "draw_members")
    reps = stage(P.representative_joint(m, audit.cells, audit.joint, keys), "draw_reps")
    fwd = m.groupBy(*k).agg(F.when(F.max("has_forward"), F.avg(F.col("ok").cast("int")))
                            .alias("validated_frac"))
    ranked = P.rank_plateaus(
        quantiles(m, k, "score", {"q10_score": 0.1}), reps,
        m.select(*keys, "row_idx", "support", F.lit(None).cast("double").alias("robust")),
        P.extent(m, audit.cells, audit.dims, keys), fwd,
        P.irregular_span(m, audit.cells, audit.jumps, keys),
        P.inverted_risk(reps, audit.cells, audit.inversions, keys), audit.rank_forward, keys)
    return (ranked.filter("rank = 1").select(*keys, "representative").join(apart, keys)
            .select("study_id", "representative", "weight"))


def _tally(winners: DataFrame, draws: int, audit) -> DataFrame:
    """Share of draws that keep a plateau, the region and the representative."""
    base = audit.plateaus.filter("rank = 1").select("study_id", "component",
                                                    F.col("representative").alias("_rep"))
    inside = audit.members.join(base, ["study_id", "component"]).select(
        "study_id", F.col("row_idx").alias("representative"), F.lit(1).alias("_in"))
    w = (winners.join(base.select("study_id", "_rep"), "study_id")
         .join(inside, ["study_id", "representative"], "left"))
    count = lambda ok: F.sum(F.when(ok, F.col("weight")).otherwise(0))
    t = w.groupBy("study_id").agg(
        F.sum("weight").alias("with_plateau"), count(F.col("_in").isNotNull()).alias("same_region"),
        count(F.col("representative") == F.col("_rep")).alias("same_representative"))
    out = base.select("study_id").join(t, "study_id", "left")
    cols = ("with_plateau", "same_region", "same_representative")
    rate = {"with_plateau": "plateau_rate", "same_region": "region_rate",
            "same_representative": "representative_rate"}
    return out.select("study_id", F.lit(draws).alias("draws"), *[
        F.coalesce(c, F.lit(0)).alias(c) for c in cols], *[
        (F.coalesce(c, F.lit(0)) / draws).alias(rate[c]) for c in cols])


# ----------------------------------------------------------------------- audits
def threshold_stability(audit, stage, joint: int = JOINT_DRAWS) -> DataFrame:
    """Does the recommendation survive moving our own thresholds by 20 %?"""
    draws = [r.asDict() for r in threshold_draws(audit.cells.sparkSession, audit.thresholds,
                                                 joint=joint).collect()]
    found = audit.plateaus.select("study_id").distinct()
    forward = audit.cells.select(*P.NODE, "has_forward", F.when(
        F.col("known") & (F.size("fails_oos") == 0), -1).otherwise(0).cast("long").alias("ok"))
    t = lambda d: {k: d[k] for k in (f.name for f in fields(P.Thresholds)) if k in KEYS}
    rows = (audit.stability.filter("passes").join(found, "study_id", "left_semi")
            .select(*P.NODE, "score", "support",
                    bits(draws, lambda d: P.is_candidate(t(d))).alias("cand"),
                    bits(draws, lambda d: P.is_core(t(d))).alias("core"))
            .filter("cand <> 0").join(forward, P.NODE))
    sizes = [d["min_size"] for d in draws]
    return _tally(_winners(rows, sizes, audit, stage), len(draws), audit)


def gate_stability(audit, stage, total: int = GATE_DRAWS) -> DataFrame:
    """Does the recommendation survive moving the user's limits by 20 %?"""
    draws = [r.asDict() for r in gate_draws(audit.cells.sparkSession, total=total).collect()]
    found = audit.plateaus.select("study_id").distinct()
    pol = audit.studies.select("study_id", "require_profit", "min_profit_factor",
                               "max_drawdown_pct")
    c = attach(audit.cells.join(found, "study_id", "left_semi"), pol, ["study_id"], "inner",
               "row_idx")

    def clean(period: str, trades: str) -> Column:
        return bits(draws, lambda d: F.size(gate_failures(
            F.col(period), F.col("require_profit"),
            1 + (F.col("min_profit_factor") - 1) * d["f_pf"], F.col("max_drawdown_pct") * d["f_dd"],
            F.col(trades) * d["f_tr"])) == 0)

    none = F.lit(0).cast("long")
    is_ok = F.when(F.col("lost_in_is"), none).otherwise(clean("is", "min_trades"))
    oos_ok = F.when(F.col("known"), clean("oos", "min_trades_oos")).otherwise(none)
    flags = c.select(*P.NODE, "score", "has_forward", "mode", is_ok.alias("is_ok"), oos_ok.alias("ok"))
    alone = (F.col("mode") == "is_then_oos") | ~F.col("has_forward")
    flags = stage(flags.select(*P.NODE, "score", "has_forward", "ok", F.when(
        alone, F.col("is_ok")).otherwise(F.col("is_ok").bitwiseAND(F.col("ok"))).alias("passes")),
        "gate_bits")
    # Quantiles of the neighbours do not depend on the gates: only pass counts move.
    counts = (audit.edges.select("study_id", "src", F.col("dst").alias("row_idx"))
              .join(flags.select(*P.NODE, "passes"), P.NODE)
              .groupBy("study_id", F.col("src").alias("row_idx"))
              .agg(*lane_sums(F.col("passes"), len(draws))))
    keep = audit.stability.select(*P.NODE, "support", "q25", "cliff", "peak_z")
    st = (flags.filter("passes <> 0").join(keep, P.NODE).join(counts, P.NODE)
          .withColumn("counts", lane_counts(len(draws))))
    st = P.with_goal(st, audit.radius)
    t = P.threshold_columns(audit.thresholds)

    def judged(rule: Callable[[dict], Column]) -> Column:
        def one(d: Column) -> Column:
            share = F.get("counts", d["at"]) / F.nullif(F.col("support"), F.lit(0))
            return bit(F.col("passes"), d["at"]) & rule(
                {"frac_pass": share, "robust": P.robust_value(share, F.col("goal"))})
        return bits(draws, one)

    rows = st.filter((F.col("support") >= t["min_support"]) & (F.col("q25") >= t["floor_quality"])).select(
        *P.NODE, "score", "support", "has_forward", "ok",
        judged(lambda v: (v["frac_pass"] >= t["min_frac_pass"]) & (v["robust"] >= t["min_robust"]))
        .alias("cand"),
        judged(lambda v: (F.col("q25") >= t["core_quality"]) & (v["robust"] >= t["core_robust"]))
        .alias("core"))
    sizes = [float(audit.thresholds.min_size)] * len(draws)
    return _tally(_winners(rows, sizes, audit, stage), len(draws), audit)
