import numpy as np
import xxhash
from pyspark.sql import functions as F

from ratingloom.llm import simhash as S
from ratingloom.llm.components import components
from ratingloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(prints):
    label = dict(zip(range(len(prints)), range(len(prints))))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(prints))]


def test_against_brute_force(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r["text"]) for r in texts]
    roots = plain_components(prints)
    found = {r["doc_id"]: r for r in QUERIES["op9_simhash"](spark, DATA).collect()}
    assert len(found) == len(texts)
    for r, p, root in zip(texts, prints, roots):
        assert found[r["doc_id"]]["fingerprint"] == f"{p:016x}"
        assert found[r["doc_id"]]["component_id"] == texts[root]["doc_id"]


def test_planted_distances(spark):
    """Random fingerprints with neighbours at every distance: all links within three, none beyond."""
    rng = np.random.default_rng(5)
    values = []
    for _ in range(60):
        base = int(rng.integers(0, 1 << 63, dtype=np.int64)) * 2
        values.append(base)
        for d in (1, 2, 3, 3, 3, 4, 5):
            bits = rng.choice(64, d, replace=False)
            values.append(base ^ sum(1 << int(b) for b in bits))
    for block, _ in S.BLOCKS:  # three bits within one block
        values.append(values[0] ^ (0b111 << block))
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    close = components(S.close_links(fps)).withColumnRenamed("node", "fp")
    labelled = fps.join(close, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    far = components(S.far_links(labelled))
    first = {r["fp"]: r["label"] for r in labelled.collect()}
    second = {r["node"]: r["label"] for r in far.collect()}
    got = [second.get(first[s], first[s]) for s in signed]
    want = plain_components(values)
    assert len(set(got)) == len(set(want)) == len({*zip(got, want)})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None, 1), (3, "", 1), (9, " \t\n", 1), (7, "One two", 2), (8, "ONE  two", 2), (7, "One two", 2)]
    rows += [(11, long, 3), (12, long + " more", 3), (None, "alone here now", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (7, 7), (11, 11), (12, 11), (None, None)], key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0
