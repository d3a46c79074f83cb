import duckdb
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import mixing as M
from ratingloom.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_against_sql(spark):
    found = QUERIES["op6_mixing"](spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = db.execute(ORACLE["op6_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (found[c] == want[c]).all(), c


def plain_targets(sizes, budget=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("hot", [0, 3000])
def test_targets_and_copies(spark, hot):
    rows = [(i, f"s{i % 7}" if i % 11 else None, (i * 37) % 90) for i in range(400)]
    rows += [(1000 + i, "hot", 1 + i % 50) for i in range(hot)] + [(9000, "", 3), (9001, "zero", 0), (9002, "é", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size int")
    got = M.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=0.51), s
    again = {r["doc_id"]: r["taken"] for r in M.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_newton_solves_the_dual(spark):
    rows = [(f"s{i % 3}", 1 + (i * i) % 40) for i in range(300)]
    sized = spark.createDataFrame(rows, "source string, size long")
    targets = M.source_targets(sized)
    for r in M.solve(sized, targets).join(targets.withColumn("key", F.to_json(F.struct("source"))), "key").collect():
        own = [n for s, n in rows if s == r["source"]]
        import math

        got = sum(min(2.0, math.exp(r["a"] + r["b"] * n / r["mean"])) * n for n in own)
        assert got == pytest.approx(r["source_size"] * 0 + targets.where(F.col("source") == r["source"]).first()["target"], rel=1e-6)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, "a b", "x"), (None, "s", "a b c", "x"), (2, "s", "", "x"), (2, "s", "", "x")]
    rows += [(3, "t", "w " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = M.mix_documents(docs).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) == pytest.approx(1.5 * 100_005, rel=0.01)
    assert M.mix_documents(docs.limit(0)).count() == 0
    nothing = M.mix_documents(docs.where("text = ''")).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in nothing] == [(0, 0, 0.0)] * 2
