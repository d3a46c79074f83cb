import random

import pytest
from pyspark.sql import functions as F

from ratingloom.llm import packing as P
from ratingloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_decreasing_against_a_scan(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 5, 16, 33, 100])
    sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 80))]
    rows = P.best_fit_decreasing(sizes, length)
    plain = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, k) for k, r in enumerate(plain) if r >= sizes[i]]
        if fits:
            space, k = min(fits)
            plain[k] = space - sizes[i]
        else:
            plain.append(length - sizes[i])
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(plain)


def rebuilt(packed, params):
    tokenizer = P._tokenizer(params.ranks_file)
    parts = {}
    for r in P.segments(packed, params).collect():
        parts.setdefault(r["doc_id"], []).append((r["doc_offset"], r["ids"]))
    found = {}
    for key, own in parts.items():
        ids = [i for _, x in sorted(own) for i in x]
        assert ids[-1] == params.end and sum(len(x) for _, x in own) == len(ids)
        found[key] = tokenizer.decode(ids[:-1])
    return found


def test_round_trip(spark):
    packed = QUERIES["op7_packing"](spark, DATA).cache()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert rebuilt(packed, P.PackParams()) == texts
    for r in packed.collect():
        assert len(r["ids"]) == 4096 and r["cu_seqlens"][-1] == r["n_tokens"] <= 2048
        assert r["position_resets"] == r["cu_seqlens"][:-1] and r["cu_seqlens"] == sorted(set(r["cu_seqlens"]))
        assert len(r["doc_ids"]) == len(r["doc_offsets"]) == len(r["position_resets"])
    positions = P.position_ids(packed).first()
    assert [i for i, p in enumerate(positions["positions"]) if p == 0] == positions["position_resets"]


def test_odd_rows(spark):
    params = P.PackParams(length=16, group=100)
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|> there"), (4, "long " * 20_000), (5, "日本 🙂"), (6, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit(0)).coalesce(1)
    packed = P.pack(docs, params)
    assert rebuilt(packed, params) == {k: t or "" for k, t in rows}
    assert P.pack(docs.limit(0), params).count() == 0
    twice = P.pack(docs.where("doc_id = 6").unionByName(docs.where("doc_id = 6")), params)
    assert P.segments(twice, params).count() == 2
    assert P.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), params).first()["doc_ids"] == [None]
