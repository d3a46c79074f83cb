import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import search as S
from ratingloom.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_against_sql(spark):
    found = QUERIES["op4_top_k_search"](spark, DATA).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = db.execute(ORACLE["op4_top_k_search"]).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert len(found) == len(want) > 0
    for c in want.columns:
        assert (found[c] == want[c]).all(), c


@pytest.mark.parametrize("dim,spread", [(1, 3), (7, 2), (64, 40), (16, 2**28)])
def test_block_search_is_exact(dim, spread):
    rng = np.random.default_rng(dim)
    q, c = rng.integers(-spread, spread, (30, dim)), rng.integers(-spread, spread, (200, dim))
    c[:30] = q
    q_ids, c_ids = np.arange(30), np.arange(200)
    rows, cols, scores = S.block_top(q_ids, q, c_ids, c, S.SearchParams())
    exact = q.astype(object) @ c.T.astype(object)
    for i in range(30):
        want = sorted((-int(exact[i, j]), j) for j in range(200) if j != i)[:20]
        assert [(-int(s), int(j)) for s, j in zip(scores[rows == i], cols[rows == i])] == want


def test_bounds_tighten():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 64)), rng.normal(size=(30, 64))
    last = np.full((20, 30), np.inf)
    for borders in S._segments(64, (1, 2, 4, 8, 16, 32)):
        bound = S.summaries(x, borders) @ S.summaries(y, borders).T
        assert (bound <= last + 1e-9).all() and (bound >= x @ y.T - 1e-9).all()
        last = bound


def test_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(50)] + [(0, [0.0, 1.0]), (60, None), (61, [None, 1.0])]
    rows += [(62, [float("nan"), 1.0]), (63, [float("inf"), 1.0]), (80, [1.0]), (None, [1.0, 1.0]), (100, []), (7, [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    small = S.top_k(frame, F.col("vec_id") % 20 == 0, S.SearchParams(k=3, block=8))
    by = {}
    for r in small.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    # vectors of another length, null or not finite, have nobody to meet
    assert set(by) == {0, 20, 40}
    assert by[0] == [(7, 64 * 9 * 64), (1, 4096), (2, 4096)]
    assert S.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert S.top_k(frame, F.col("vec_id") == -1).count() == 0
