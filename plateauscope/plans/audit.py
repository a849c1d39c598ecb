"""The audit of many sweeps as one chain of staged relations.

Each attribute is built on first use and written once; later operators read the
written table. The order follows the data: passes, studies, scored rows, space,
cells, edges, stability, plateaus.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import perturbation as B
from ..operators import plateau as P
from ..operators import quality as Q
from ..operators import space as S
from ..operators.ordering import attach
from .stages import stage

EDGE_PAYLOAD = ("score", "passes")


class Audit:
    """Lazily staged relations of one set of passes under one policy."""

    def __init__(self, passes: DataFrame, policy: DataFrame, rank_forward: str = "soft",
                 thresholds: P.Thresholds = P.Thresholds()):
        self.passes = passes
        self.policy = policy
        self.rank_forward = rank_forward
        self.thresholds = thresholds

    @cached_property
    def studies(self) -> DataFrame:
        return stage(Q.study_frame(self.passes, self.policy), "studies")

    @cached_property
    def scored(self) -> DataFrame:
        return stage(Q.score_rows(self.passes, self.studies), "scored")

    @cached_property
    def levels(self) -> DataFrame:
        return stage(S.levels(S.param_rows(self.passes)), "levels")

    @cached_property
    def level_counts(self) -> DataFrame:
        return S.level_counts(self.levels)

    @cached_property
    def coverage(self) -> DataFrame:
        return S.observed_coverage(self.passes, self.level_counts)

    @cached_property
    def rows(self) -> DataFrame:
        """Scored rows with the viable flag and coordinates."""
        viable = Q.viable_rows(self.scored)
        coords = S.coordinates(self.passes, self.levels)
        return stage(viable.join(coords, P.NODE), "rows")

    @cached_property
    def scale(self) -> DataFrame:
        return stage(Q.viable_scale(self.rows), "scale")

    @cached_property
    def marginal(self) -> DataFrame:
        return S.marginal_sensitivity(self.rows, self.level_counts, self.scale)

    @cached_property
    def conditional(self) -> DataFrame:
        return S.conditional_sensitivity(self.rows, self.level_counts, self.scale)

    @cached_property
    def roles(self) -> DataFrame:
        return stage(S.dimension_roles(self.marginal, self.conditional), "roles")

    @cached_property
    def dims(self) -> DataFrame:
        return stage(S.dims_by_role(self.roles), "dims")

    @cached_property
    def cells(self) -> DataFrame:
        return stage(S.collapse(self.rows, self.dims), "cells")

    @cached_property
    def _edges(self) -> tuple[DataFrame, DataFrame]:
        return S.neighbourhood(self.cells, stage, *EDGE_PAYLOAD)

    @property
    def edges(self) -> DataFrame:
        return self._edges[0]

    @property
    def radius(self) -> DataFrame:
        return self._edges[1]

    @cached_property
    def stability(self) -> DataFrame:
        local = stage(P.local_stability(self.cells, self.edges, self.scale), "local")
        return stage(P.robustness(local, self.radius), "stability")

    @cached_property
    def joint(self) -> DataFrame:
        return stage(P.joint_rank(self.cells, self.edges), "joint")

    @cached_property
    def members(self) -> DataFrame:
        return stage(P.plateau_members(self.stability, self.edges, stage), "members")

    @cached_property
    def representatives(self) -> DataFrame:
        return stage(P.representative_joint(self.members, self.cells, self.joint), "reps")

    @cached_property
    def inversions(self) -> DataFrame:
        return stage(P.period_inversions(self.cells, self.levels, self.scale), "inversions")

    @cached_property
    def jumps(self) -> DataFrame:
        return S.grid_regularity(self.levels)

    @cached_property
    def extent(self) -> DataFrame:
        return P.extent(self.members, self.cells, self.dims)

    @cached_property
    def plateaus(self) -> DataFrame:
        m, c = self.members, self.cells
        return stage(P.rank_plateaus(
            P.plateau_summary(m, c), self.representatives, self.stability, self.extent,
            P.forward_validation(m, c), P.irregular_span(m, c, self.jumps),
            P.inverted_risk(self.representatives, c, self.inversions),
            self.rank_forward), "plateaus")

    @cached_property
    def peaks(self) -> DataFrame:
        return P.rejected_peaks(self.cells, self.stability, self.members, self.thresholds)

    @cached_property
    def coarse(self) -> DataFrame:
        return P.coarse_cells(self.cells, self.dims, self.radius)

    @cached_property
    def power(self) -> DataFrame:
        return P.power_check(self.cells, self.radius, self.plateaus, self.thresholds)

    @cached_property
    def threshold_stability(self) -> DataFrame:
        return stage(B.threshold_stability(self, stage), "threshold_stability")

    @cached_property
    def gate_stability(self) -> DataFrame:
        return stage(B.gate_stability(self, stage), "gate_stability")

    def slots(self) -> DataFrame:
        """Observed neighbours, free slots and gaps around every representative."""
        r = self.representatives.select("study_id", "component", "row_idx").join(
            self.cells.select(*P.NODE, "cell", "active_dims", "level_sizes"), P.NODE)
        r = attach(r, self.radius.select("study_id", "radius"), ["study_id"], "inner", "row_idx")
        r = S.possible_slots(r).join(self.stability.select(
            *P.NODE, "support", "pass_count", "fail_count"), P.NODE)
        return r.select("study_id", "component", "row_idx", "radius", "support", "pass_count",
                        "fail_count", "slots",
                        F.greatest(F.lit(0), F.col("slots") - F.col("support")).alias("gaps"))
