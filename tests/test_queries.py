"""Registered queries against their SQL on the smallest tables.

The default run takes a sample of every area; ``PLATEAU_ALL=1`` runs them all.
"""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = ("a2_delimited_table", "b6_structural_parameters", "c4_period_quality", "d5_conditional_sensitivity",
          "a7_text_encodings", "d9_neighbours", "d9_sparse_neighbours", "e2_robustness", "e25_threshold_stability",
          "e26_gate_stability", "f3_spearman", "f6_selection_fragility", "h2_fifo_matching", "h22_ljung_box",
          "h24_sample_curves", "j4_attempts", "k3_false_positives")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("PLATEAU_ALL") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(oracle_sql()[name])
    at = [d[0] for d in rel.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6))


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
