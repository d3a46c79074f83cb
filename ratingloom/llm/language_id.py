"""Language identification by error-correcting output codes.

Every language gets a codeword of +1/-1 bits. One binary classifier per bit
tells the languages with +1 from those with -1 by hashed character n-grams;
a text goes to the language whose codeword has the least weighted loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import fold, slices

#: What texts without a letter, or without a learned language, are given.
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``features`` is the number of hash buckets (a power of two) of character n-grams of
    the given ``orders``; ``smoothing`` is added to each count, in units of an even share.
    A best language with a share under ``ambiguous`` is flagged. ``chunk`` bounds the
    characters that are worked on at once (a longer text is worked on alone).
    """

    features: int = 1 << 16
    orders: tuple[int, ...] = (2, 3)
    smoothing: float = 0.1
    ambiguous: float = 0.5
    chunk: int = 1 << 18


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1/-1 bits for each of ``n`` languages, every column splitting them.

    Up to five languages get the exhaustive code (every split once, so that all
    rows differ in about half of the bits); more get the best of several random
    codes of 10 log2 n bits.
    """
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.int8).T
    bits, best, most = int(np.ceil(10 * np.log2(n))), None, -1
    rng = np.random.default_rng(seed)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        split = np.abs(code.astype(int).sum(0)) < n
        code = code[:, split]
        gram = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(gram, -np.inf)
        nearest = int((code.shape[1] - gram.max()) // 2)
        if nearest > most:
            best, most = code, nearest
    return best


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str], params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in order, and each text's number of them.

    Letters are lower-cased, everything else is a space; an n-gram counts if its
    first character or the one after it is a letter, and never spans two texts.
    """
    gap = " " * (1 + max(params.orders))
    framed = [f" {t.lower()}{gap}" for t in texts]
    joined, lengths = "".join(framed), list(map(len, framed))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    ends = np.cumsum(lengths)
    n = len(codes) - max(params.orders)
    wanted = letter[:n] | letter[1 : n + 1]
    at = np.flatnonzero(wanted)
    counts = np.diff(np.searchsorted(at, ends), prepend=0) * len(params.orders)
    shift = np.uint32(32 - (params.features.bit_length() - 1))
    found = np.empty((len(at), len(params.orders)), np.int32)
    for j, order in enumerate(params.orders):
        h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            h = (h ^ codes[k : n + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        found[:, j] = ((h * np.uint32(0x85EBCA6B)) >> shift)[at]
    return found.reshape(-1), counts


class LanguageModel:
    """Codewords, bit classifiers and bit weights; small, so it is sent to every task."""

    def __init__(self, languages, code, weights, bit_weights, params):
        self.languages, self.code = list(languages), code
        self.weights, self.bit_weights, self.params = weights, bit_weights, params

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity flag of every text."""
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        flags = np.ones(len(texts), bool)
        whole = [t or "" for t in texts]
        for a, b in slices(whole, self.params.chunk):
            found, counts = ngrams(whole[a:b], self.params)
            some = np.flatnonzero(counts)
            if not len(some) or not self.languages:
                continue
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[some]
            sums = np.add.reduceat(self.weights[found], starts, axis=0) if self.code.shape[1] else np.zeros((len(some), 0))
            margin = sums / np.sqrt(counts[some])[:, None]
            best, score = self.decode(margin)
            names[a + some] = np.array(self.languages, object)[best]
            scores[a + some] = score
            flags[a + some] = score < self.params.ambiguous
        return names.tolist(), scores, flags

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword of least weighted logistic loss, and its share among all codewords."""
        loss = np.zeros((len(margin), len(self.code)))
        for b in range(self.code.shape[1]):
            signed = -margin[:, b : b + 1] * self.code[None, :, b]
            loss += self.bit_weights[b] * np.logaddexp(0, signed)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / share.sum(1)


def fit(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from all rows of ``labelled`` (text, lang); null texts and languages are left out.

    Tasks count n-grams per language, Spark adds the counts up, and each hash
    bucket becomes one row of bit weights (the log odds of the two sides of the
    split, every language counting alike). Only the list of languages and
    ``features`` rows of weights come to the driver, whatever the input.
    An empty input gives a model that answers ``und``.
    """
    size = params.features

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(texts)), key=langs.__getitem__)
            for a, b in slices([texts[i] for i in order], params.chunk):
                part = order[a:b]
                found, counts = ngrams([texts[i] for i in part], params)
                ends = np.cumsum(counts)
                for lang in dict.fromkeys(langs[i] for i in part):
                    own = [k for k, i in enumerate(part) if langs[i] == lang]
                    grams = found[ends[own[0]] - counts[own[0]] : ends[own[-1]]]
                    hits = np.bincount(grams, minlength=size)
                    totals[lang] = totals[lang] + hits if lang in totals else hits
        for lang, hits in totals.items():
            used = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(hits[used], pa.int64())],
                ["lang", "feature", "n"],
            )

    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = rows.mapInArrow(count, "lang string, feature int, n long")
    counts = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages))
    n_bits = code.shape[1]
    if not n_bits:
        counts.unpersist()
        return LanguageModel(languages, code, np.zeros((size, 0), np.float32), np.zeros(0), params)
    alpha = params.smoothing
    rest = np.array([alpha / (totals[x] + alpha * size) for x in languages])
    spark = labelled.sparkSession
    facts = spark.createDataFrame(
        [(x, [int(v) for v in row], float(totals[x] + alpha * size)) for x, row in zip(languages, code)],
        "lang string, bits array<int>, total double",
    )
    # one row per language: a table as small as the list of languages itself
    share = counts.join(F.broadcast(facts), "lang").withColumn("share", F.col("n") / F.col("total"))
    plus = [F.sum(F.when(F.col("bits")[b] > 0, F.col("share")).otherwise(0.0)) for b in range(n_bits)]
    per_feature = share.groupBy("feature").agg(F.array(*plus).alias("plus"), F.sum("share").alias("all"))
    up, down = np.zeros((size, n_bits)), np.zeros((size, n_bits))
    for row in per_feature.collect():
        up[row["feature"]] = row["plus"]
        down[row["feature"]] = row["all"] - np.array(row["plus"])
    counts.unpersist()
    positive = (code > 0).astype(float)
    up = (up + rest @ positive) / positive.sum(0)
    down = np.maximum(down, 0) + rest @ (1 - positive)
    down /= (1 - positive).sum(0)
    weights = np.log(up) - np.log(down)
    apart = ((up - down) * weights).sum(0)
    return LanguageModel(languages, code, weights.astype(np.float32), apart / apart.mean(), params)


def identify(docs: DataFrame, model: LanguageModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given ``columns`` of ``docs`` (which has ``text``) with lang_pred, score and ambiguous.

    A null text, or one without a letter, is ``und`` with score 0, flagged
    ambiguous. Whole texts count. Equal scores go to the language that sorts
    first; a repeated row is answered each time; other columns are not read.
    A column to carry that is named like a result gives way to it.
    """
    results = ("lang_pred", "score", "ambiguous")
    columns = tuple(c for c in columns if c not in results)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*columns, *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, flags = shared.value.predict(batch.column(0).to_pylist())
            found = [pa.array(langs, pa.string()), pa.array(scores), pa.array(flags)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    schema = ", ".join([*fields, "lang_pred string, score double, ambiguous boolean"])
    carried = (F.col(f"`{c}`") for c in columns)
    return docs.select(F.col("text").alias("text to read"), *carried).mapInArrow(run, schema)


def in_training(docs: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id) modulo 4 is not 2."""
    return docs.where(fold(F.col("doc_id"), 4) != 2)


def language_of_documents(
    docs: DataFrame, params: LanguageParams = LanguageParams(), columns: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Fit on the training fold of ``docs`` and predict every row, keeping ``columns``."""
    return identify(docs, fit(in_training(docs), params), columns)
