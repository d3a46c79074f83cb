import numpy as np
import pytest

from ratingloom.llm import language_id as L
from ratingloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_codewords_split_and_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = L.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert (np.abs(code.astype(int).sum(0)) < n).all()
    assert L.codewords(1).shape == (1, 0) and L.codewords(0).shape == (0, 0)
    assert np.abs(L.codewords(4).astype(int) @ L.codewords(4).T.astype(int) - 8 * np.eye(4)).max() <= 1


def test_ngrams_do_not_depend_on_neighbours():
    params = L.LanguageParams()
    texts = ["Der Hund", "", "x", "été 12 là", "İstanbul"]
    together, counts = L.ngrams(texts, params)
    ends = np.cumsum(counts)
    for i, text in enumerate(texts):
        alone, n = L.ngrams([text], params)
        assert n[0] == counts[i] and (alone == together[ends[i] - counts[i] : ends[i]]).all()
    assert counts[1] == 0


def test_held_out_accuracy(spark):
    found = QUERIES["op8_language_id"](spark, DATA)
    lang = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = found.join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "the cat of the house and that", "en", "a") for i in range(12)]
    rows += [(20 + i, "der Hund und die Katze ist nicht", "de", "b") for i in range(12)]
    rows += [(50, None, "en", "c"), (51, "", "de", "c"), (52, "123 ...", "en", "c"), (53, "und der " * 40_000, None, "c")]
    rows += [(20, "der Hund und die Katze ist nicht", "de", "b"), (None, "the house", "en", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_odd_rows(odd):
    found = L.language_of_documents(odd).collect()
    assert len(found) == 30
    by_id = {r["doc_id"]: r for r in found}
    for i in (50, 51, 52):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["ambiguous"]) == ("und", 0.0, True)
    assert by_id[53]["lang_pred"] == "de" and by_id[None]["lang_pred"] == "en" and by_id[3]["lang_pred"] == "en"


def test_empty_and_single_language(spark, odd):
    none = L.identify(odd, L.fit(odd.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = L.identify(odd, L.fit(odd.where("lang = 'en'"))).collect()
    assert {r["lang_pred"] for r in one} == {"und", "en"}
    assert L.identify(odd.limit(0), L.fit(odd)).count() == 0
