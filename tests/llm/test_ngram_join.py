import random

import numpy as np
import pytest

from ratingloom.llm import ngram_join as J
from ratingloom.session import write_shared


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """(doc_id, n, component) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((k for k in ids if k is not None), default=None) for r, ids in members.items()}
    return sorted(((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, params=J.JoinParams()):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in J.near_duplicates(docs, params).collect()), key=str)


def corpus(seed, n):
    """Texts with near copies on either side of the threshold, chains, and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=25)
    texts = []
    for _ in range(n):
        text = rng.choices(words, k=rng.choice((4, 12, 60, 90)))
        if rng.random() < 0.4:
            text = text + passage
        texts.append(text)
        for _ in range(rng.choice((0, 0, 1, 4))):
            text = list(text)
            for _ in range(rng.choice((1, 1, 2, 3))):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(text)
    rng.shuffle(texts)
    return [(i, rng.choice((" ", "\n ")).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("params", [J.JoinParams(), J.JoinParams(small=2, sketch_bits=8, fragments=3, few_meetings=0)])
def test_against_all_pairs(spark, params):
    rows = corpus(3, 110)
    assert found(spark, rows, params) == plain(rows)


def test_large_group_of_near_copies(spark):
    """Texts that differ from one original in a word or two: all groups are large, and some pairs are too far apart."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice((1, 1, 2, 3))):
            text[rng.randrange(len(text))] = f"x{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(text)))
    assert found(spark, rows, J.JoinParams(small=8)) == plain(rows)


def test_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """A star of near copies gives about a pair for each of them."""
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:50], f"own{i}", *base[51:]])) for i in range(300)] + [(999, " ".join(base))]
    sizes = []

    def counted(pairs, *rest):
        sizes.append(pairs.count())
        return linked(pairs, *rest)

    linked = J.linked
    monkeypatch.setattr(J, "linked", counted)
    assert {c for _, _, c in found(spark, rows)} == {0}
    assert sum(sizes) <= 2 * len(rows)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 5003}x{i % 7}" for i in range(60_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "One two"), (8, "ONE  two"), (7, "One two"), (7, "other words")]
    rows += [(11, long), (12, long + " more"), (None, "alone here now"), (None, "alone here now"), (None, "a null id")]
    rows += [(20, "a b c d e f"), (21, "a b c d e f"), (22, "é ß c d e f g"), (23, "É ß c d e f g")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_empty_table_and_clashing_names(spark):
    names = "doc_id long, text string, class int, n int, token int, label int, print string, piece int"
    assert J.near_duplicates(spark.createDataFrame([], names)).count() == 0
    rows = [(1, "a b c", 5, 5, 5, 5, "p", 5), (2, "A b c", 6, 6, 6, 6, "q", None), (4, "d", None, 0, 0, 0, None, 1)]
    got = J.near_duplicates(spark.createDataFrame(rows, names)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1), (4, 1, 4)]


def test_partial_overlaps_add_up(spark):
    """The overlap of two sets is the sum over the fragments, wherever the borders are."""
    docs = spark.createDataFrame(corpus(4, 30), "doc_id long, text string")
    params = J.JoinParams(fragments=5, sketch_bits=10)
    table = write_shared(J._classes_and_sketch(docs, params), "classes")
    classes = table.where("piece IS NULL AND n > 0").select("doc_id", "print", "n", "class")
    order = J.global_order(table.where("piece IS NOT NULL").select("piece", "counts"), params)
    assert len(order.borders) == 4 and sorted(order.borders) == list(order.borders)
    pairs = classes.selectExpr("class AS a", "n").crossJoin(classes.selectExpr("class AS b", "n AS n2")).where("a < b")
    cut = J.segments(docs, classes, pairs, spark.sparkContext.broadcast(order), params)
    assert {r["fragment"] for r in cut.select("fragment").distinct().collect()} == set(range(5))
    sizes = {r["class"]: r["size"] for r in cut.selectExpr("class", "size(tokens) AS size").groupBy("class")
             .sum("size").toDF("class", "size").collect()}
    assert sizes == {r["class"]: r["n"] for r in classes.collect()}
    links = {(r["a"], r["b"]) for r in J.linked(pairs, cut, params).collect()}
    texts = {J.class_of(J.shingles(t, 5)): plain_set(t) for _, t in docs.collect()}
    for a in texts:
        for b in texts:
            if a < b:
                similar = 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])
                assert similar == ((a, b) in links)


def test_shingles_are_the_words_of_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aAbé \n\x0b\t\x00") for _ in range(rng.randrange(40)))
        assert len(J.shingles(text, 5)) == len(plain_set(text))
    assert np.array_equal(J.shingles("A b\nc", 5), J.shingles(" a  B c ", 5))
    assert len({J.shingles(t, 5)[0] for t in ("a", "a b", "b a", "a b c d e", "a b c d f", "ab")}) == 6
