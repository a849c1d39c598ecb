"""Selection fragility: the best of random halves, at any number of rows and repeats.

A repeat samples without replacement the rows of the smallest draws. A draw is a pure function
of (seed, repeat, row), so it is made again wherever it is needed and never shuffled. The last
draw of each sample is found by counting: rows travel once, in blocks; every task counts the draws
of its blocks below and inside an interval, the counts are added up with map-side combine, and the
interval shrinks to the piece that holds the last draw until few enough are left to be compared. The
best of a sample is a maximum over blocks, and its place one more count. No row is sorted, and one
that is not in the last piece never leaves its block.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import DRAW_STEP, WORD

# The task functions below travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Seeds of the two directions.
FRAGILITY_SEED = 20260919
REVERSE_MASK = 0x5BF03635
REPEAT_STEP = 7919
MIN_PAIRS = 20
BLOCK_ROWS = 8192  # rows of a block
PIECES = 16  # an interval is cut into so many
COMPARED = 1024  # draws of an interval that are compared one by one
CELLS = 1 << 20  # draws a task makes at once


def draws(stream: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Draw number ``row + 1`` of every stream, as integers below 2^32: a row a stream."""
    u = np.uint32
    with np.errstate(over="ignore"):
        s = (stream.astype(np.uint64).astype(u)[:, None]
             + ((row.astype(np.uint64) + np.uint64(1)).astype(u) * u(DRAW_STEP))[None, :])
        t = (s ^ (s >> u(15))) * (s | u(1))
        t = (t + (t ^ (t >> u(7))) * (t | u(61))) ^ t
        return t ^ (t >> u(14))


def _streams(seed: int, repeats: int) -> np.ndarray:
    """Streams of both directions, repeat by repeat."""
    rep = np.arange(1, repeats + 1, dtype=np.int64) * REPEAT_STEP
    return np.concatenate([(s + rep) % WORD for s in (seed, seed ^ REVERSE_MASK)])


def _blocks(pairs: DataFrame, stage) -> DataFrame:
    """(study_id, blk, row_idx, a, b): rows of at most ``BLOCK_ROWS`` numbers in arrays."""
    spark = pairs.sparkSession
    at = pairs.withColumn("blk", F.floor(F.col("row_idx") / BLOCK_ROWS))
    rows = F.sort_array(F.collect_list(F.struct("row_idx", "a", "b")))
    packed = at.groupBy("study_id", "blk").agg(rows.alias("r")).select(
        "study_id", "blk", *[F.col("r")[c].alias(c) for c in ("row_idx", "a", "b")])
    # As many parts as there are cores: the draws outweigh the rows by far.
    return stage(packed.repartition(4 * spark.sparkContext.defaultParallelism, "study_id", "blk"),
                 "selection_blocks")


def _over_blocks(blocks: DataFrame, state: DataFrame, seed: int, repeats: int, work, names, schema):
    """Rows of ``work(block, state, streams)`` for every block, whose state is one row a study."""
    def run(batches):
        streams = _streams(seed, repeats)
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            keys = [f.name for f in batch.schema]
            for i in range(batch.num_rows):
                block = {}
                for name, column in zip(keys, columns):
                    one = column[i]
                    block[name] = (one.values.to_numpy(zero_copy_only=False)
                                   if pa.types.is_list(column.type) else one.as_py())
                wide = max(1, CELLS // max(1, len(block["row_idx"])))
                for lo in range(0, len(streams), wide):
                    out = work(block, slice(lo, lo + wide), streams[lo:lo + wide])
                    if len(out[0]):
                        n = len(out[0])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block["study_id"]] * n), *map(pa.array, out)],
                            names=["study_id", *names])

    return blocks.join(state, "study_id").mapInArrow(run, schema)


def _packed(state: DataFrame, *columns: str) -> DataFrame:
    """One row a study: an array a column, by stream. A study has as many streams as repeats ask for."""
    all_ = F.array_sort(F.collect_list(F.struct("k", *columns)))
    return state.groupBy("study_id").agg(all_.alias("s")).select(
        "study_id", *[F.col("s")[c].alias(c) for c in columns])


def _count(block, at, streams):
    """Per stream: draws below the interval, and in each of its pieces."""
    u = draws(streams, block["row_idx"]).astype(np.int64)
    lo, wide = block["lo"][at][:, None], (block["hi"] - block["lo"])[at][:, None]
    piece = np.where(u < lo, 0, np.minimum((u - lo) * PIECES // wide, PIECES) + 1)
    key = np.arange(len(streams))[:, None] * (PIECES + 2) + piece
    c = np.bincount(key.ravel(), minlength=len(streams) * (PIECES + 2)).reshape(-1, PIECES + 2)
    return [np.arange(at.start, at.start + len(streams)), *c[:, :PIECES + 1].T]


def _inside(block, at, streams):
    """(stream, draw, row) of the draws inside the interval."""
    u = draws(streams, block["row_idx"]).astype(np.int64)
    k, i = np.nonzero((u >= block["lo"][at][:, None]) & (u < block["hi"][at][:, None]))
    return [k + at.start, u[k, i], block["row_idx"][i]]


def _sampled(block, at, streams):
    u = draws(streams, block["row_idx"]).astype(np.int64)
    cut, last = block["cut"][at][:, None], block["last"][at][:, None]
    return (u < cut) | ((u == cut) & (block["row_idx"][None, :] <= last))


def _sides(block, at, n):
    """(train, test) of every stream: the first half of the streams goes from a to b."""
    back = np.arange(at.start, at.start + n) >= len(block["cut"]) // 2
    return (np.where(back[:, None], block["b"], block["a"]),
            np.where(back[:, None], block["a"], block["b"]))


def _best(block, at, streams):
    """(stream, train, row, test) of the best sampled row of the block."""
    took = _sampled(block, at, streams)
    train, test = _sides(block, at, len(streams))
    best = np.where(took, train, -np.inf).argmax(1)  # the first of equals has the smallest row
    k = np.flatnonzero(took[np.arange(len(streams)), best])
    best = best[k]
    return [k + at.start, train[k, best], block["row_idx"][best], test[k, best]]


def _below(block, at, streams):
    """(stream, sampled rows whose test is below that of the chosen row)."""
    _, test = _sides(block, at, len(streams))
    below = _sampled(block, at, streams) & (test < block["chosen"][at][:, None])
    return [np.arange(at.start, at.start + len(streams)), below.sum(1)]


def last_draws(blocks: DataFrame, sizes: DataFrame, seed: int, repeats: int, stage) -> DataFrame:
    """(study_id, k, cut, last): draw and row of the last sampled row of every stream.

    ``sizes``: study_id, n, take. The first interval is where the last draw lies all but surely;
    where it does not, the part outside is the next one.
    """
    spread = 8 * F.sqrt(F.col("take") / F.col("n") * (1 - F.col("take") / F.col("n")) / F.col("n"))
    share = F.col("take") / F.col("n")
    place = lambda x: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * WORD)
    state = sizes.select(
        "study_id", "take", place(share - spread).alias("lo"),
        F.least(F.lit(WORD), place(share + spread) + 1).alias("hi"),
        F.explode(F.sequence(F.lit(0), F.lit(2 * repeats - 1))).alias("k"))
    names = [f"c{j}" for j in range(PIECES + 1)]
    schema = "study_id string, k long, " + ", ".join(f"{c} long" for c in names)
    while True:
        got = (_over_blocks(blocks, _packed(state, "lo", "hi"), seed, repeats, _count,
                            ["k", *names], schema)
               .groupBy("study_id", "k").agg(*[F.sum(c).alias(c) for c in names]))
        at = state.withColumn("k", F.col("k").cast("long")).join(got, ["study_id", "k"])
        upto = [sum((F.col(c) for c in names[1:j + 1]), F.col(names[0])) for j in range(PIECES + 1)]
        edge = lambda j: F.col("lo") + F.ceil(F.lit(j) * (F.col("hi") - F.col("lo")) / PIECES)
        piece = F.lit(PIECES + 1)  # the piece of the last sampled draw; 0 below, PIECES + 1 above
        for j in range(PIECES, -1, -1):
            piece = F.when(upto[j] >= F.col("take"), j).otherwise(piece)
        at = at.withColumn("_j", piece)
        pick = lambda values, of: F.element_at(F.array(*values), of)
        edges = [F.lit(0), *[edge(j) for j in range(PIECES + 1)], F.lit(WORD)]
        edges = [e.cast("long") for e in edges]
        before = [F.lit(0).cast("long"), *upto]
        inside = [*[F.col(c) for c in names]]
        state = stage(at.select(
            "study_id", "take", "k", pick(edges, F.col("_j") + 1).alias("lo"),
            pick(edges, F.col("_j") + 2).alias("hi"), pick(before, F.col("_j") + 1).alias("before"),
            F.when(F.col("_j") <= PIECES, pick(inside, F.least(F.col("_j") + 1, F.lit(PIECES + 1))))
            .otherwise(F.lit(2 ** 62)).alias("c")), "selection_intervals")
        # Goes on while some interval holds many draws that are not all the same.
        if state.filter((F.col("c") > COMPARED) & (F.col("hi") > F.col("lo") + 1)).isEmpty():
            break
    rows = _over_blocks(blocks, _packed(state, "lo", "hi"), seed, repeats, _inside, ["k", "u", "row"],
                        "study_id string, k long, u long, row long")
    near = rows.groupBy("study_id", "k").agg(F.sort_array(F.collect_list(F.struct("u", "row"))).alias("r"))
    found = F.element_at("r", (F.col("take") - F.col("before")).cast("int"))
    return state.join(near, ["study_id", "k"]).select(
        "study_id", "k", found["u"].alias("cut"), found["row"].alias("last"))


def selection_fragility(pairs: DataFrame, stage, repeats: int = 2000, fraction: float = 0.5,
                        seed: int = FRAGILITY_SEED) -> DataFrame:
    """How often the best of a random half falls under the median on the other period.

    ``pairs``: study_id, row_idx, a, b. Every repeat samples the whole fraction without
    replacement, in both directions; studies of fewer than ``MIN_PAIRS`` pairs are left out.
    """
    ok = (pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(
        F.col("study_id").cast("string").alias("study_id"), F.col("row_idx").cast("long").alias("row_idx"),
        F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))
    n = ok.groupBy("study_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAIRS)
    take = F.greatest(F.lit(10), F.least(F.col("n") - 1, F.floor(F.col("n") * fraction))).cast("long")
    n = stage(n.select("study_id", "n", take.alias("take")), "selection_sizes")
    blocks = _blocks(ok, stage).join(n.select("study_id"), "study_id", "left_semi")
    cuts = stage(last_draws(blocks, n, seed, repeats, stage), "selection_cuts")
    packed = _packed(cuts, "cut", "last")
    best = (_over_blocks(blocks, packed, seed, repeats, _best, ["k", "train", "row", "test"],
                         "study_id string, k long, train double, row long, test double")
            .groupBy("study_id", "k").agg(F.max_by("test", F.struct("train", -F.col("row"))).alias("chosen")))
    cuts = stage(cuts.join(best, ["study_id", "k"]), "selection_chosen")
    below = (_over_blocks(blocks, _packed(cuts, "cut", "last", "chosen"), seed, repeats, _below,
                          ["k", "below"], "study_id string, k long, below long")
             .groupBy("study_id", "k").agg(F.sum("below").alias("below")))
    way = (below.join(n, "study_id").groupBy("study_id", "n", "take").agg(*[
        F.avg(F.when((F.col("k") >= repeats) == back, (F.col("below") / F.col("take") < 0.5).cast("int")))
        .alias(name) for back, name in ((F.lit(False), "is_to_oos"), (F.lit(True), "oos_to_is"))]))
    worst = F.greatest("is_to_oos", "oos_to_is")
    margin = 2 * F.sqrt(worst * (1 - worst) / repeats)
    return way.select("study_id", worst.alias("fragility"), margin.alias("margin"),
                      "is_to_oos", "oos_to_is",
                      F.abs(F.col("is_to_oos") - F.col("oos_to_is")).alias("asymmetry"),
                      F.when(F.col("is_to_oos") >= F.col("oos_to_is"), "is_to_oos")
                      .otherwise("oos_to_is").alias("worst_direction"), "n", "take",
                      F.lit(repeats).alias("repeats"))
