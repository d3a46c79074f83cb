import re
from collections import Counter

from pyspark.sql import functions as F

from ratingloom.llm import quality as Q
from ratingloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered, seen, dups = set(), set(), 0
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_statistics_against_brute_force(spark):
    odd = [None, "", " \n\t ", "a b c d e f g h", "x " * 30, "a b c d e f g h " * 3, "l\nl\n \nl\r\nl", "é🙂 #*$ <b>", "w " * 50_000]
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + odd
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows.select("doc_id", Q.statistics(F.col("text")).alias("s")).collect()
    for r in found:
        assert tuple(r["s"][k] for k in Q.STATISTICS) == plain(texts[r["doc_id"]])


def labelled(spark, n=400):
    good = [(i, "this is a fine text of some twenty different words and it goes on for a while until the end of it all") for i in range(n)]
    bad = [(n + i, "## %% && <> " * (1 + i % 2) + "and some more of the words that make it long enough to pass the base rule of the list") for i in range(n)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(2 * n)], "doc_id long, quality int")
    return docs, labels


def test_learned_list_tells_junk(spark):
    docs, labels = labelled(spark)
    rated, rules = Q.rate(docs, labels)
    assert 1 <= len(rules.rules) and "reject if" in str(rules)
    kept = {r["doc_id"]: r["kept"] for r in rated.collect()}
    assert all(kept[i] == (i < 400) for i in kept)


def test_main_path_has_no_python(spark):
    plan = QUERIES["op5_quality_rules"](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark):
    docs, labels = labelled(spark, 30)
    more = spark.createDataFrame([(900, None), (901, ""), (None, "short"), (902, "b " * 90_000), (902, "b " * 90_000)], docs.schema)
    both = docs.unionByName(more).withColumn("kept_before", F.lit(1)).withColumn("n_words", F.lit("x"))
    strange = labels.unionByName(spark.createDataFrame([(900, None), (None, 0), (5, 1), (777, 0)], labels.schema))
    rated, _ = Q.rate(both, strange.withColumn("s", F.lit(2)))
    kept = {}
    for r in rated.collect():
        kept.setdefault(r["doc_id"], []).append(r["kept"])
    assert kept[900] == kept[901] == kept[None] == [False] and kept[902] == [False, False]
    assert kept[3] == [True]
    rated, rules = Q.rate(docs, labels.limit(0))
    assert not rules.rules and rated.where("not kept").count() == 0
    assert Q.rate(docs.limit(0), labels)[0].count() == 0


def test_rare_junk_below_outliers(spark):
    """Two in a hundred rows are junk, between the clean rows and a few clean outliers."""
    kinds = [(1500, 0, 1), (30, 10, 0), (10, 60, 1)]  # rows, symbols, quality
    rows = [(symbols, quality) for n, symbols, quality in kinds for _ in range(n)]
    words = [f"w{j:02d}" for j in range(30)]
    texts = [" ".join(w + "#" * (k // 30 + (j < k % 30)) for j, w in enumerate(words)) for k, _ in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(rows)], "doc_id long, quality int")
    rated, rules = Q.rate(docs, labels)
    assert rules.rules and all(r["kept"] == bool(rows[r["doc_id"]][1]) for r in rated.collect()), str(rules)


def test_more_than_ten_kinds_of_junk(spark):
    """Clean rows and twelve kinds of junk take turns along the length of the text."""
    rows = [(20 + k, k % 2) for k in range(25) for _ in range(60)]
    rows = [(n, 1 - odd) for n, odd in rows]
    docs = spark.createDataFrame([(i, " ".join(f"{j:03d}" for j in range(n))) for i, (n, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(rows)], "doc_id long, quality int")
    rated, rules = Q.rate(docs, labels)
    assert len(rules.rules) == 12 and all(r["kept"] == bool(rows[r["doc_id"]][1]) for r in rated.collect()), str(rules)
