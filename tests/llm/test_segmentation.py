import dataclasses
import math
import re
import weakref
from collections import Counter

import numpy as np
import pytest

from ratingloom.llm import segmentation as G
from ratingloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
PARAMS = dataclasses.replace(G.SegmentParams(), k=3)


def all_segmentations(text):
    vocab = G.vocabulary(PARAMS)
    weight = {vocab.model.id_to_piece(i): w for i, w in enumerate(vocab.weights) if w}

    def cuts(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in weight:
                for rest, w in cuts(s[n:]):
                    yield (s[:n], *rest), w + weight[s[:n]]

    found = list(cuts(G.SPACE + text.replace(" ", G.SPACE)))
    total = np.logaddexp.reduce([w for _, w in found])
    return {s: math.exp(w - total) for s, w in found}


def test_draws_follow_the_lattice():
    """Probabilities, order, distinctness, second places and inclusion against all segmentations."""
    text, n = "the end", 3000
    p = all_segmentations(text)
    vocab = G.vocabulary(PARAMS)
    first, second, weighted, rows = Counter(), Counter(), Counter(), {}
    for i, rank, f in G.sample_texts([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(977), PARAMS):
        cut = tuple(vocab.model.id_to_piece(int(x)) for x in f["ids"])
        assert math.exp(f["log_p"]) == pytest.approx(p[cut])
        rows.setdefault(i, []).append((f["gumbel"], cut))
        (first, second, Counter())[rank][cut] += 1
        weighted[cut] += p[cut] / math.exp(f["log_inclusion"]) / n
    for r in rows.values():
        assert len({c for _, c in r}) == 3 and [g for g, _ in r] == sorted((g for g, _ in r), reverse=True)
    for cut in sorted(p, key=p.get)[-4:]:
        assert first[cut] / n == pytest.approx(p[cut], abs=0.04)
        expected = sum(p[a] * p[cut] / (1 - p[a]) for a in p if a != cut)
        assert second[cut] / n == pytest.approx(expected, abs=0.04)
    assert sum(weighted.values()) == pytest.approx(1, abs=0.03)


def test_round_trip_and_chunks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = QUERIES["op1_sentencepiece"](spark, DATA).cache()
    assert rows.count() == 2 * docs.count() and G.round_trips(rows, docs).count() == 0
    one = G.sample_segmentations(docs, dataclasses.replace(G.SegmentParams(), chunk=3000))
    assert one.exceptAll(rows).count() == 0


def test_odd_rows(spark):
    texts = [None, "", " ", "a", "日本 ≠\t🙂\n\n", "  two  spaces ", "x" * 30_000, "a", "word " * 30_000]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, "a", 0), (None, "a b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    found = G.sample_segmentations(docs).cache()
    assert G.round_trips(found.where("doc_id is not null"), docs.distinct()).count() == 0
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["n_pieces"], r["log_p"], r["log_inclusion"]) for r in by[0] + by[1]] == [(0, 0.0, 0.0)] * 2
    assert len(by[3]) == 4 and len({tuple(r["ids"]) for r in by[3]}) == 2 and len(by[None]) == 2
    assert G.sample_segmentations(docs.limit(0)).count() == 0
    assert G.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["decoded"] is None


def test_runs_of_spaces_are_in_the_lattice():
    """The model's own encoding of a text is a path of the lattice, and probabilities are those over all segmentations."""
    vocab = G.vocabulary(PARAMS)
    for text in ("a    b", "a   \n b", "    x", "a  ", " " * 40 + "q", "if x:\n        return  1\n\n   y"):
        codes, lengths, units, _ = G.cut_units([text])
        lattice = G.Lattice(codes, lengths, vocab)
        # pieces along the units; a line break is one edge that stands for its byte piece
        unit, at = 0, int(lattice.start[units[0]])
        for i in vocab.model.encode(text):
            ids = {int(G.piece_ids(lattice.piece[e : e + 1], vocab)[0]): e for e in range(lattice.first[at], lattice.first[at + 1])}
            assert i in ids, (text, vocab.model.id_to_piece(i))
            at = int(lattice.target[ids[i]])
            if at == -1 and (unit := unit + 1) < len(units):
                at = int(lattice.start[units[unit]])
        assert unit == len(units), text
    text = "a    b"
    p = all_segmentations(text)
    assert any("▁▁▁" in s for s in p)
    for _, _, f in G.sample_texts([text] * 20, np.arange(20, dtype=np.uint64), PARAMS):
        cut = tuple(vocab.model.id_to_piece(int(x)) for x in f["ids"])
        assert math.exp(f["log_p"]) == pytest.approx(p[cut])


def test_units_are_those_of_the_pattern():
    pattern = re.compile("▁*[^▁\\n]+|▁+|\\n")
    texts = ["a  b", "", " ", "\n", "a\n\n b \n", "▁x ▁", "日本 ≠\t🙂\n\n", "a  ", "  a", "a b a b", "", "\r\n \r"]
    for some in (texts, [""], [], ["", ""], ["z"]):
        codes, lengths, numbers, bounds = G.cut_units(some)
        ends = np.cumsum(lengths)
        units = ["".join(map(chr, codes[e - n : e])) for n, e in zip(lengths, ends)]
        assert len(set(units)) == len(units) and len(bounds) == len(some) + 1
        for text, a, b in zip(some, bounds, bounds[1:]):
            want = pattern.findall("▁" + text.replace(" ", "▁")) if text else []
            assert [units[i] for i in numbers[a:b]] == want, text


def test_query_decodes(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op1_sentencepiece_decode"](spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and all(r["decoded"] == docs[r["doc_id"]] for r in rows)


def test_one_lattice_at_a_time(monkeypatch):
    """That of a slice of texts is gone before the next one is built, and slices change no answer."""
    alive, most = weakref.WeakSet(), []

    class Counted(G.Lattice):
        def __init__(self, *args):
            alive.add(self)
            most.append(len(alive))
            super().__init__(*args)

    texts = ["some words to cut", "and others", "", "a third one with more words", "the end"] * 3
    seeds = np.arange(len(texts)).astype(np.uint64)

    def drawn(chunk):
        rows = G.sample_texts(texts, seeds, G.SegmentParams(chunk=chunk))
        return [(i, rank, facts["ids"].tolist(), facts["log_p"], facts["gumbel"]) for i, rank, facts in rows]

    expected = drawn(1 << 20)
    monkeypatch.setattr(G, "Lattice", Counted)
    assert drawn(20) == expected and len(most) > 5 and max(most) == 1
