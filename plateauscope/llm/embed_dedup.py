"""Embedding near-duplicates: sign hashing by random hyperplanes, exact cosine, components.

Equal vectors of one label are one class. A class gets one sign code in each of several tables;
classes that share a code in some table are compared by exact cosine. The bits of a code grow
with the number of classes, so a bucket stays small, and the number of tables follows from the
bits so that a pair at the threshold is missed with probability ``MISS`` at any size.

A bucket of more than ``HELD`` classes is cut into blocks, and every two blocks meet in a task
of their own, so a bucket of any size is compared whole. A pair that shares codes in several
tables is counted in the first one only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from plateauscope.llm.components import connected
from plateauscope.llm.tables import written

THRESHOLD = 0.93
MISS = 0.002
BUCKET = 32  # classes a bucket, about
HELD = 1_024
SEED = 7_919


def plan(n_classes: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n_classes`` vectors."""
    bits = min(24, max(8, math.ceil(math.log2(max(2, n_classes) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(bits: int, tables: int, seed: int):
    """Task: the bucket of every class in every table."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            size = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([seed, int(d)])).normal(
                        size=(int(d), bits * tables))
                for lo in range(0, part.num_rows, 4096):
                    at = part.slice(lo, 4096)
                    side = (_matrix(at.column("vec")) @ planes[d]) >= 0
                    code = (side.reshape(at.num_rows, tables, bits) @ weights).astype(np.int32)
                    codes = pa.ListArray.from_arrays(
                        pa.array(np.arange(at.num_rows + 1, dtype=np.int32) * tables),
                        pa.array(code.ravel()))
                    yield pa.RecordBatch.from_arrays([*at.columns, codes],
                                                     names=[*at.schema.names, "codes"])
    return run


def _parts(matrix: np.ndarray) -> np.ndarray:
    """Smallest row of the part that each row of a symmetric boolean matrix belongs to."""
    label = np.arange(len(matrix))
    while True:
        low = np.minimum(label, np.where(matrix, label[None, :], len(matrix)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compared(threshold: float):
    """Task over rows sorted by (bucket, i, j): (id, n, root) of every class with a link there."""
    names = ["id", "n", "root"]

    def pairs(group: pa.RecordBatch):
        table = group.column("t")[0].as_py()
        ids, mult, block = (group.column(c).to_numpy(zero_copy_only=False)
                            for c in ("id", "mult", "b"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        codes = group.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x = _matrix(group.column("vec"))
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if i != j:  # both blocks meet their own rows elsewhere
            linked &= block[:, None] != block[None, :]
        u, v = np.nonzero(linked)
        if not len(u):
            return
        fresh = ~(codes[u, :table] == codes[v, :table]).any(axis=1)
        n = np.bincount(u[fresh], mult[v[fresh]], len(ids)).astype(np.int64)
        root = _parts(linked)
        has = linked.any(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[has]), pa.array(n[has]), pa.array(ids[root][has])], names=names)

    def run(batches):
        held = None
        for batch in batches:
            parts = [held, batch] if held is not None else [batch]
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()
            if not t:
                continue
            t = t[0]
            key = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j")])
            edge = np.flatnonzero(np.concatenate(
                [[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
            for lo, hi in zip(edge[:-2], edge[1:-1]):
                if hi - lo > 1:
                    yield from pairs(t.slice(lo, hi - lo))
            held = t.slice(edge[-2])
        if held is not None and held.num_rows > 1:
            yield from pairs(held)
    return run, "id long, n long, root long"


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS,
                    held: int = HELD, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``.

    Two vectors link when their labels are equal and not null, their lengths are equal and
    their cosine is ``threshold`` or more. A vector that is null, empty or zero or holds a null or
    non-finite number links with nothing. Rows that repeat a vec_id are vectors of their
    own that share a component; a row without vec_id links with nothing and keeps its null.
    Other columns are ignored.
    """
    # Single-precision vectors travel as such; cosines are computed in double precision.
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"),
                          F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
                          .alias("vec"))
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vec", lambda x: x != 0))
    fine = F.coalesce(fine, F.lit(False))
    classes = written(rows.filter(fine).groupBy("label", "vec").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("mult"))
        .withColumn("dim", F.size("vec")), "vectors")
    bits, tables = plan(classes.count(), threshold, miss)
    plain = classes.select("id", "mult", "vec", "dim", "label")
    schema = StructType([*plain.schema, StructField("codes", ArrayType(IntegerType()))])
    coded = written(plain.mapInArrow(_coded(bits, tables, seed), schema), "codes")
    at = coded.select("id", "mult", "label", "dim", "vec", "codes",
                      F.posexplode("codes").alias("t", "code"))
    at = at.withColumn("g", F.xxhash64("t", "code", "label", "dim"))
    buckets = (at.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
               .withColumn("blocks", F.ceil(F.col("m") / held).cast("int")))
    at = at.join(buckets, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    at = at.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # The hash of a bucket may meet another's; label, length and table keep them apart.
    at = at.select(F.xxhash64("g", "label", "dim", "t").alias("g"), "t", "b",
                   F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"),
                   "id", "mult", "vec", "codes")
    run, schema = _compared(threshold)
    found = written(at.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
                    .mapInArrow(run, schema), "links")
    label = connected(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    home = (classes.join(counts, "id", "left")
            .join(label, F.col("id") == F.col("node"), "left")
            .select("label", "vec", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                    F.coalesce("root", "id").alias("component_id")))
    good = rows.withColumn("fine", fine)
    # A class that holds a third of all rows is split by the optimiser: it is one row here.
    out = good.filter("fine").join(home, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(good.filter("NOT fine").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
