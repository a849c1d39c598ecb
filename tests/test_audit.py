import math
import random

from pyspark.sql import functions as F

from conftest import SF
from plateauscope.operators import plateau as P
from plateauscope.operators import quality as Q
from plateauscope.operators import refine
from plateauscope.operators import space as S
from plateauscope.plans import relations as R
from plateauscope.plans.audit import Audit
from plateauscope.plans.stages import stage


def test_components_match_union_find(spark, both_forms):
    rng = random.Random(4)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(180)]
    links += [(0, i) for i in range(200, 230)]  # a hub
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    both = [(1, a, b) for a, b in links if a != b] + [(1, b, a) for a, b in links if a != b]
    e = spark.createDataFrame(both, "study_id int, src long, dst long")
    v = spark.createDataFrame([(1, i) for i in range(n)], "study_id int, row_idx long")
    got = {r.row_idx: r.component for r in P.components(v, e, ["study_id"], stage).collect()}
    assert got == {i: find(i) for i in range(n)}


def grid(spark, fn, sizes=(9, 9, 3)):
    """A full sweep whose two periods follow ``fn`` of the coordinates."""
    cells = [(a, b, c) for a in range(sizes[0]) for b in range(sizes[1]) for c in range(sizes[2])]
    rows = []
    for i, z in enumerate(cells):
        g = fn(z)
        m = (1000.0 * (g - 0.2), 1 + g, 4 * g, 3 * g, 30 - 28 * g, 300.0, 3.0 * g)
        rows.append(("s", i, str(i), [(f"p{j}", "number", float(v), str(v)) for j, v in enumerate(z)],
                     m, m, m[0], m[0], True, False))
    metric = ("struct<profit:double,profit_factor:double,recovery_factor:double,sharpe:double,"
              "drawdown:double,trades:double,expected_payoff:double>")
    return spark.createDataFrame(rows, (
        "study_id string, row_idx long, pass_id string, params array<struct<name:string,kind:string,"
        f"num:double,txt:string>>, `is` {metric}, oos {metric}, criterion_is double, "
        "criterion_oos double, oos_known boolean, lost_in_is boolean"))


def hump(z):
    return max(0.05, 1 - 0.12 * (abs(z[0] - 4) + abs(z[1] - 4) + abs(z[2] - 1)))


def audit_of(df, trades=50.0):
    return Audit(df, Q.policy_frame(df, min_trades=trades))


def test_planted_plateau_is_found_whatever_the_partitions(spark, both_forms):
    df = grid(spark, hump)
    a = audit_of(df)
    best = a.plateaus.filter("rank = 1").first()
    centre = a.cells.filter(F.col("row_idx") == best.representative).first().coords
    assert abs(centre[0] - 4) + abs(centre[1] - 4) + abs(centre[2] - 1) <= 1
    again = audit_of(df.orderBy(F.rand(7)).repartition(7)).plateaus.filter("rank = 1").first()
    assert (again.representative, again["size"]) == (best.representative, best["size"])


def test_loser_has_no_plateau(spark):
    a = audit_of(grid(spark, lambda z: 0.05))
    assert a.members.count() == 0 and a.power.first().search_pass == 0


def test_text_levels_never_become_neighbours(spark):
    df = grid(spark, hump).withColumn("params", F.transform("params", lambda p: F.when(
        p["name"] == "p2", p.withField("kind", F.lit("text")).withField(
            "num", F.lit(None).cast("double"))).otherwise(p)))
    a = audit_of(df)
    z = a.cells.select("row_idx", F.get("coords", F.lit(2)).alias("z"))
    e = a.edges.join(z.withColumnRenamed("row_idx", "src").withColumnRenamed("z", "za"), "src").join(
        z.withColumnRenamed("row_idx", "dst").withColumnRenamed("z", "zb"), "dst")
    assert e.count() > 0 and e.filter("za <> zb").count() == 0


def test_ball_sizes(spark):
    d = spark.range(1, 7).select(*[(2 * F.size(S.ball(F.col("id").cast("int"), r))).alias(f"r{r}")
                                   for r in (1, 2, 3)], "id").orderBy("id").collect()
    assert d[5].r1 + d[5].r2 + d[5].r3 == 376 and d[0].r1 == 2


def test_gates_are_monotone(spark):
    df = grid(spark, hump)
    counts = [Q.score_rows(df, Q.study_frame(df, Q.policy_frame(
        df, min_trades=50.0, min_profit_factor=pf))).filter("passes").count() for pf in (1.1, 1.4, 1.8)]
    assert counts == sorted(counts, reverse=True)


def _refined(spark, sizes, at, weights, budget, finer):
    rows = [("s", 0, 0, [at] * len(sizes))]
    reps = spark.createDataFrame(rows, "study_id string, component long, row_idx long, coords array<int>")
    levels = spark.createDataFrame(
        [("s", d, f"p{d}", "number", k, float(10 * k), str(10 * k)) for d, n in enumerate(sizes) for k in range(n)],
        "study_id string, dim int, name string, type string, pos int, num double, txt string")
    roles = spark.createDataFrame([("s", d, "distance", w) for d, w in enumerate(weights)],
                                  "study_id string, dim int, role string, marginal double")
    grid = spark.createDataFrame([("s", "grid")], "study_id string, sampling string")
    return refine.refinement(reps.drop("coords"), reps.drop("component"), levels, roles, grid,
                             budget, finer).orderBy("dim").collect()


def test_refinement_keeps_the_budget(spark):
    for finer in (False, True):
        rows = _refined(spark, [11] * 5, 5, [1.0 - 0.1 * i for i in range(5)], 2000, finer)
        assert math.prod(r.levels for r in rows) <= 2000
        assert all(r.start <= r.center <= r.stop for r in rows)
        # The heaviest axis is never narrower than a lighter one.
        assert [r.levels for r in rows] == sorted((r.levels for r in rows), reverse=True)


def test_refinement_widens_the_heaviest_axis_and_stops_the_lightest(spark):
    rows = _refined(spark, [11, 11, 11], 5, [0.2, 0.9, 0.5], 27, False)
    assert [(r.start, r.stop, r.levels) for r in rows] == [(40.0, 60.0, 3)] * 3
    rows = _refined(spark, [11, 11, 11], 5, [0.2, 0.9, 0.5], 26, False)
    assert [(r.levels, r.fixed) for r in rows] == [(1, True), (7, False), (3, False)]
    row = _refined(spark, [11], 0, [1.0], 100, True)[0]
    assert (row.start, row.stop, row.step, row.levels, row.finer) == (0.0, 30.0, 5.0, 7, True)


def test_sweep_of_the_given_tables(spark):
    p = R.sweep(spark, SF)
    assert p.select("study_id").distinct().count() == 6
    assert p.groupBy("study_id", "row_idx").count().filter("count > 1").count() == 0
