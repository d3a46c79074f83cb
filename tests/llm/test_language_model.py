import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import language_model as M
from ratingloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_arrays_survive():
    for x in ([], [0], [1, 255, 256], [2**64 - 1, 0], list(range(1000))):
        a = np.array(x, np.uint64)
        assert (M.dec(M.enc(a)) == a).all()
        assert (M.dec_sorted(M.enc_sorted(np.sort(a))) == np.sort(a)).all()


def test_stirling_and_tables():
    """Numbers of tables follow the restaurant process, simulated customer by customer."""
    d, theta, c, n = 0.6, 1.3, 5, 20_000
    table = M.log_stirling(d, 8)
    assert table[1, 1] == 0 and math.exp(table[2, 1]) == pytest.approx(1 - d)
    assert math.exp(table[3, 2]) == pytest.approx((1 - d) + (2 - 2 * d))
    rng = np.random.default_rng(1)
    drawn = M.draw_tables(np.full(n, c), np.zeros(n, int), np.ones(n), d, theta, rng)
    plain = Counter()
    for _ in range(n):
        t = 0
        for k in range(c):
            t += rng.random() < (theta + d * t) / (theta + k)
        plain[t] += 1
    for t in range(1, c + 1):
        assert (drawn == t).mean() == pytest.approx(plain[t] / n, abs=0.02)
    many = M.draw_tables(np.array([1, 40, 5000]), np.array([3, 0, 9]), np.full(3, 0.01), 0.8, 1.0, rng)
    assert many[0] == 1 and (many >= 1).all() and many[1] <= 40 and many[2] <= 5000


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_base_and_held_out(spark):
    found = QUERIES["op2_language_model"](spark, DATA).collect()
    docs = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    counts = Counter(w for k, t in docs.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(docs)
    for r in found:
        own = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    new = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in new) > 0.9 * sum(r["base_score"] for r in new)


def frame(spark, rows):
    rows = [(i, t, h, "x") for i, (t, h) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, score string")


def test_probabilities_of_texts_add_up(spark):
    """All texts of two words at most, an unknown word being one symbol, share less than the whole."""
    train = ["a b a c", "b a b", "c c a b d", "a b", "", "a", "a b a b a b a b"]
    symbols = ["a", "b", "c", "d", "unknown"]
    asked = ["", *symbols, *(f"{x} {y}" for x in symbols for y in symbols)]
    rows = frame(spark, [(t, False) for t in train] + [(t, True) for t in asked])
    p = [10 ** r["score"] for r in M.score(rows).where("held_out").orderBy("doc_id").collect()]
    assert 0 < p[0] < sum(p[:6]) < sum(p) < 1 and sum(p) > 0.2
    table = M.parent_probability(np.array([3, 2, 1]), np.array([1, 1, 1]), M.Totals(6, 3, 0.5), 3, M.ModelParams())
    assert table[0].sum() + table[1] == pytest.approx(1)


def test_blocks_and_buckets_do_not_change_counts(spark):
    rows = [(f"w{i % 7} w{i % 3} the end {i}", i % 5 == 1) for i in range(80)]
    docs = frame(spark, rows)
    one = M.score(docs.coalesce(1)).orderBy("doc_id").collect()
    many = M.score(docs.repartition(6), M.ModelParams(block=20, bucket_bytes=64)).orderBy("doc_id").collect()
    for a, b in zip(one, many):
        assert (a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["n_tokens"], b["n_known"], b["train_tokens"])
        assert a["base_score"] == pytest.approx(b["base_score"]) and a["score"] == pytest.approx(b["score"], rel=0.4)


def test_odd_rows(spark):
    rows = [(None, False), ("", True), ("same text", False), ("same text", False), ("new " * 60_000, True), ("A\tb\n", False)]
    docs = frame(spark, rows)
    both = docs.unionByName(docs.where("doc_id = 2")).withColumn("kind", F.lit(1))
    found = M.score(both).collect()
    assert len(found) == 7 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (0, 1)} == {1}
    assert M.score(docs.limit(0)).count() == 0
    unseen = M.score(docs.where("held_out")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in unseen)
    nameless = spark.createDataFrame([(None, "a b", False)], "doc_id long, text string, held_out boolean")
    assert M.score(nameless).first()["doc_id"] is None
