"""Every stage of the pipeline against a plain version of it, on the stage's own input."""

import re
from collections import Counter

from pyspark.sql import functions as F
from test_mixing import plain_targets
from test_quality import plain
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from ratingloom.llm import language_id, mixing, quality, segmentation
from ratingloom.session import write_shared

DATA = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before, tables = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        tables[name] = before, write_shared(stage(spark, before, DATA), name)
        before = tables[name][1]
    assert all(t.columns == columns for name, (_, t) in tables.items() if name != "sentencepiece")

    def texts(table):
        return {r["doc_id"]: r["text"] for r in table.collect()}

    given, kept = map(texts, tables["language_id"])
    lettered = {k for k, t in given.items() if any(c.isalpha() for c in t or "")}
    assert kept.keys() <= lettered and len(kept) >= 0.98 * len(lettered)

    given, kept = map(texts, tables["quality_rules"])
    facts = {k: plain(t) for k, t in given.items()}
    failed = {k for k, f in facts.items() if f[0] < 20 or 100 * f[4] > 30 * f[0]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = {k for k in given if k not in failed and labels.get(k) == 1}
    assert not kept.keys() & failed and len(kept.keys() & clean) >= 0.98 * len(clean)

    given, kept = map(texts, tables["near_duplicates"])
    ids = sorted(given)
    roots = plain_components([plain_fingerprint(given[k]) for k in ids])
    assert sorted(kept) == sorted({ids[r] for r in roots})

    source = {r["doc_id"]: r["source"] for r in tables["mixing"][0].collect()}
    sizes, taken = {}, {}
    for k, t in texts(tables["mixing"][0]).items():
        sizes[source[k]] = sizes.get(source[k], 0) + words(t)
    copies = tables["mixing"][1].collect()
    for r in copies:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
        assert r["n_chars"] == len(r["text"])
    given = texts(tables["mixing"][0])
    for s, want in plain_targets(sizes).items():
        # copies are whole, so a source is off by half of the document on the border of its target at most
        largest = max(words(t) for k, t in given.items() if source[k] == s)
        assert abs(taken.get(s, 0) - want) <= largest / 2 + 0.51, s

    pieces = tables["sentencepiece"][1]
    assert pieces.count() == 2 * len(copies)
    back = {(r["doc_id"], r["decoded"]) for r in segmentation.decode(pieces).select("doc_id", "decoded").collect()}
    assert back == {(r["doc_id"], r["text"]) for r in copies}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = write_shared(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_mixing_gives_whole_texts(spark):
    """Every row comes whole, by itself, and no source is off its target by more than half a document."""
    texts = [(1, "a", "one  two\n\tthree four"), (2, "b", "w  x\n" * 200), (3, "c", "y z\n" * 10), (3, "c", "other  words\n" * 10)]
    texts += [(None, "d", f"null {i}\n id") for i in range(40)] + [(None, "d", "null 0\n id")]
    rows = [(i, t, "en", s, len(t)) for i, s, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    assert {tuple(r) for r in found} <= set(rows)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    for r in found:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    for s, want in plain_targets(sizes).items():
        largest = max(words(r[1]) for r in rows if r[3] == s)
        assert abs(taken.get(s, 0) - want) <= largest / 2 + 0.51, s


def test_one_row_of_near_duplicates_stays(spark):
    """Repeated rows, copies with null ids, and an id shared by a copy and another text."""
    texts = {k: " ".join(f"{k}{i * i % 97}" for i in range(60)) for k in "abcd"}
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "b"), (3, "c"), (None, "d"), (None, "d"), (None, "a"), (7, "a")]
    docs = spark.createDataFrame([(i, texts[k], k) for i, k in rows], "doc_id long, text string, source string")
    found = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, DATA).collect()
    assert sorted((r["source"], r["doc_id"]) for r in found) == [("a", 1), ("b", 2), ("c", 3), ("d", None)]


# names that operators and stages use inside or give to their results
INNER = """s kept _row _copy _copies lang_pred score ambiguous rank taken size source_size target key salt late whole bin part
fp root component_id fingerprint given first bad pruning decoded ids rows row begin need n a.b""".split()


def test_columns_with_clashing_names(spark):
    """Extra columns come through every stage unchanged, and change nothing, whatever they are called."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [*INNER, "given column 5"]
    more = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        plain = stage(spark, docs, DATA)
        found = stage(spark, more, DATA)
        if name == "sentencepiece":
            assert found.columns == plain.columns and found.exceptAll(plain).count() == 0
            continue
        assert found.columns == more.columns
        rows = [tuple(r) for r in found.collect()]
        width = len(docs.columns)
        assert Counter(r[:width] for r in rows) == Counter(tuple(r) for r in plain.collect()), name
        assert all(r[width:] == tuple(f"{n}:{r[0]}" for n in names) for r in rows), name


def test_operators_with_clashing_names(spark):
    """Columns to carry that are named like a result give way to it; others keep their values."""
    docs = spark.createDataFrame([(1, "some plain words", "en", "x"), (2, None, None, "y")], "doc_id long, text string, lang string, source string")
    more = docs.withColumns({n: F.lit(n) for n in ("score", "salt", "late", "key", "taken", "size", "decoded", "s", "kept")})
    found = language_id.language_of_documents(more, columns=("doc_id", "score", "salt")).collect()
    assert [(r["doc_id"], r["salt"], isinstance(r["score"], float)) for r in found] == [(1, "salt", True), (2, "salt", True)]
    found = mixing.mix_documents(more, keep=("salt", "late", "key", "taken", "size")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["size"], r["salt"], r["late"], r["key"]) for r in found] == [(1, 3, *("salt", "late", "key")), (2, 0, "salt", "late", "key")]
    assert all(isinstance(r["taken"], int) for r in found)
    rated, _ = quality.rate(more, spark.createDataFrame([], "doc_id long, quality int"))
    assert [(r["salt"], r["s"]["n_words"], r["kept"]) for r in rated.orderBy("doc_id").collect()] == [("salt", 3, False), ("salt", 0, False)]
    ids = segmentation.sample_segmentations(docs).withColumn("decoded", F.lit("old"))
    back = {r["doc_id"]: r["decoded"] for r in segmentation.decode(ids).collect()}
    assert back == {1: "some plain words", 2: ""}
