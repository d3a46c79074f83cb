"""Hierarchical Pitman-Yor language model over words, fitted by parallel Gibbs sampling.

Every word is a context with a restaurant of its own, whose customers are the
words that follow it; all of them share one parent restaurant, whose customers
are their tables. Given the customers, a sweep draws the number of tables of
each word in each restaurant from its exact conditional (by generalised
Stirling numbers; large counts are seated group by group), using the table
counts and parent predictive of the sweep before. The predictive probability
of a text is averaged over the sweeps that are kept.

How the work is spread: tasks turn their documents into blocks of word
numbers. What blocks have to agree on - counts of words, counts of word pairs,
tables per word - they send to buckets of hashed keys, as one compressed array
for each block and bucket, and get back the sums in the same order. A hot word
or pair is one entry per block, whatever its count. The first block that has
a pair owns it and draws its tables.

The parent's base gives ``unknown`` of its mass to unknown words, taken as
one symbol, and the rest evenly to the known ones. Keys are hashes: 56 bits of
a word and 48 of a pair, beside the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.session import write_shared


@dataclass(frozen=True)
class ModelParams:
    """``theta`` are the strengths of the contexts and of the parent; the discounts are estimated from
    how many words or pairs occur once and twice. ``burn_in`` sweeps are thrown away, ``samples`` kept.
    Blocks hold about ``block`` tokens, and a bucket takes about ``bucket_bytes`` of text.
    Up to ``exact`` customers are seated by the exact conditional.
    """

    theta: tuple[float, float] = (1.0, 1.0)
    unknown: float = 0.5
    burn_in: int = 1
    samples: int = 2
    seed: int = 1
    block: int = 3_000_000
    bucket_bytes: int = 8 << 20
    exact: int = 32


#: Stands for the end of a text, and before its first word. No word is empty.
END = b""


# -- arrays as bytes -------------------------------------------------------


def enc(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    whole = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(whole.max(initial=0)).bit_length() + 7) // 8)
    planes = whole.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def dec(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, :width] = planes.T
    return whole.view("<u8").reshape(-1)


def enc_sorted(keys: np.ndarray) -> bytes:
    return enc(np.diff(keys, prepend=np.uint64(0)))


def dec_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(dec(data), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(hashes: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and key of each hash, and the order by both."""
    bucket = (_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    key = hashes & np.uint64((1 << bits) - 1)
    return bucket, key, np.lexsort((key, bucket))


# -- blocks ----------------------------------------------------------------

#: One row: a block, a bucket (-1: none), what the arrays are, the arrays, and two numbers to add up.
_ROWS = "kind string, block long, bucket int, a binary, b binary, c binary, d binary, e binary, x double, y double"
_NAMES = ["kind", "block", "bucket", "a", "b", "c", "d", "e", "x", "y"]


def _row(kind: str, block: int, bucket: int = -1, *arrays: bytes, x: float = 0.0, y: float = 0.0) -> tuple:
    return (kind, block, bucket, *arrays, *[None] * (5 - len(arrays)), x, y)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES)


def _tokenised(docs: DataFrame, buckets: int, params: ModelParams) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as blocks: a row of documents, and a row of word keys per bucket.

    Words are numbered in order of bucket and key, so that arrays over the
    words of a block need no keys beside them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = 0, _Block()
        for batch in batches:
            for key, text, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block.add(key, text, held)
                if block.size >= params.block:
                    yield _batch(block.rows(_block_id(number), buckets))
                    number, block = number + 1, _Block()
        if block.size:
            yield _batch(block.rows(_block_id(number), buckets))

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, _ROWS)


def _block_id(number: int) -> int:
    return TaskContext.get().partitionId() << 32 | number


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


class _Block:
    def __init__(self):
        self.numbers: dict[bytes, int] = {END: 0}
        self.tokens: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.keys: list[int | None] = []
        self.held: list[bool] = []
        self.size = 0

    def add(self, key: int | None, text: str | None, held: bool) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        numbers = self.numbers
        found = [numbers.setdefault(w, len(numbers)) for w in words]
        found.append(0)
        self.tokens.append(np.array(found, np.uint32))
        self.lengths.append(len(found))
        self.keys.append(key)
        self.held.append(held)
        self.size += len(found)

    def rows(self, block: int, buckets: int) -> list[tuple]:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))
        bucket, key, order = _placed(hashes, buckets, 56)
        renumber = np.empty(len(order), np.int64)
        renumber[order] = np.arange(len(order))
        tokens = renumber[np.concatenate(self.tokens)]
        lengths, held = np.array(self.lengths), np.array(self.held, bool)
        train = np.repeat(~held, lengths)
        counts = np.bincount(tokens[train], minlength=len(order))
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        null = np.array([k is None for k in self.keys])
        ids = np.array([k or 0 for k in self.keys], np.int64).view(np.uint64)
        rows = [
            _row("docs", block, -1, enc(tokens), enc(lengths), enc(held), enc(ids), enc(null)),
            _row("words", block, -1, enc(hashes[order]), enc(np.diff(bounds)), enc(renumber[:1])),
        ]
        for i in range(buckets):
            a, b = bounds[i], bounds[i + 1]
            if a < b:
                rows.append(_row("keys", block, i, enc_sorted(key[order[a:b]]), enc(counts[a:b])))
        return rows


class _Pairs:
    """The distinct word pairs of a block, in order of bucket and key."""

    def __init__(self, tokens: np.ndarray, hashes: np.ndarray, end: int, buckets: int):
        before = np.concatenate(([end], tokens[:-1]))
        n = np.int64(len(hashes))
        codes, inverse = np.unique(before * n + tokens, return_inverse=True)
        u, w = codes // n, codes % n
        pair = _mix(hashes[u] + _mix(hashes[w] ^ np.uint64(0x2545F4914F6CDD1D)))
        bucket, key, order = _placed(pair, buckets, 48)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.u, self.w, self.key = u[order], w[order], key[order]
        self.of_token = rank[inverse]
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))


def _parts(rows: pd.DataFrame, kind: str) -> dict[str, tuple]:
    """The row of a kind that a block has only one of."""
    return rows[rows["kind"] == kind].iloc[0]


def _gathered(rows: pd.DataFrame, kind: str, column: str) -> np.ndarray:
    """Arrays of a kind, bucket after bucket."""
    own = rows[rows["kind"] == kind].sort_values("bucket")
    return np.concatenate([dec(x) for x in own[column]]) if len(own) else np.zeros(0, np.uint64)


def _by_block(tables: list[DataFrame], function: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """Apply ``function`` to all rows of a block, from all tables."""
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union.groupBy("block").applyInPandas(lambda rows: _frame(function(rows)), _ROWS)


def _by_bucket(table: DataFrame, function: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """Apply ``function`` to all rows of a bucket."""
    return table.groupBy("bucket").applyInPandas(lambda rows: _frame(function(rows)), _ROWS)


class _Sums:
    """Entries of a bucket that have the same key, whichever block sent them."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("block")
        self.blocks = rows["block"].tolist()
        keys = [dec_sorted(x) for x in rows["a"]]
        self.ends = np.cumsum([len(k) for k in keys])
        self.keys, self.first, self.inverse = np.unique(
            np.concatenate(keys), return_index=True, return_inverse=True
        )

    def add(self, arrays) -> np.ndarray:
        values = np.concatenate([dec(x) for x in arrays]).astype(np.float64)
        return np.bincount(self.inverse, values, minlength=len(self.keys)).astype(np.int64)

    def answer(self, values: np.ndarray) -> list[bytes]:
        """Values of all entries, as one array for each block that asked."""
        return [enc(x) for x in np.split(values[self.inverse], self.ends[:-1])]

    def owned(self) -> list[bytes]:
        """Whether a block is the first to have the entry."""
        mine = np.zeros(len(self.inverse), bool)
        mine[self.first] = True
        return [enc(x) for x in np.split(mine, self.ends[:-1])]


# -- seating ---------------------------------------------------------------


@lru_cache(4)
def log_stirling(discount: float, most: int) -> np.ndarray:
    """Log of generalised Stirling numbers: [c, t] weighs the ways to seat c customers at t tables."""
    table = np.full((most + 1, most + 2), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(most + 2)
    for c in range(most):
        stay = table[c] + np.log(np.maximum(c - discount * t, 1e-300))
        open_ = np.concatenate(([-np.inf], table[c, :-1]))
        table[c + 1] = np.logaddexp(np.where(c >= t, stay, -np.inf), open_)
    return table[:, : most + 1]


def draw_tables(
    customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, theta: float,
    rng: np.random.Generator, exact: int = 32,
) -> np.ndarray:
    """Numbers of tables of dishes with so many customers, by the Chinese restaurant process.

    ``others`` are the tables of other dishes in the restaurant and ``parent``
    the parent's probability of the dish. Up to ``exact`` customers the number
    is drawn from its conditional; more are seated in groups of a sixteenth of
    those seated, by the expected number of new tables, rounded at random.
    """
    tables = np.minimum(customers, 1)
    weights = log_stirling(discount, exact)
    for c in np.unique(customers[(customers > 1) & (customers <= exact)]):
        which = np.flatnonzero(customers == c)
        for part in np.array_split(which, 1 + len(which) * int(c) // 2_000_000):
            t = np.arange(1, c + 1)
            opened = np.cumsum(np.log(theta + discount * (others[part, None] + t - 1)), axis=1)
            log_p = weights[c, 1 : c + 1] + opened + t * np.log(parent[part, None])
            p = np.cumsum(np.exp(log_p - log_p.max(1, keepdims=True)), axis=1)
            tables[part] = 1 + (p < rng.random((len(part), 1)) * p[:, -1:]).sum(1)
    many = np.flatnonzero(customers > exact)
    if len(many):
        left, rest, p = customers[many], others[many], parent[many]
        n, t = np.ones(len(many), np.int64), np.ones(len(many), np.int64)
        while len(open_ := np.flatnonzero(n < left)):
            step = np.minimum(np.maximum(1, n[open_] // 16), left[open_] - n[open_])
            new = (theta + discount * (rest[open_] + t[open_])) * p[open_]
            new = new / (new + n[open_] - discount * t[open_])
            t[open_] += np.minimum(np.floor(step * new + rng.random(len(open_))).astype(np.int64), step)
            n[open_] += step
        tables[many] = t
    return tables


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


@dataclass(frozen=True)
class Totals:
    """Parent restaurant of a sweep: its customers (all tables of contexts) and tables."""

    customers: float
    tables: float
    discount: float


def parent_probability(customers: np.ndarray, tables: np.ndarray, totals: Totals, n_known: float, params: ModelParams):
    """Predictive probability of known words in the parent restaurant, and that of an unknown one."""
    theta = params.theta[1]
    base = (theta + totals.discount * totals.tables) / (theta + totals.customers)
    known = np.maximum(customers - totals.discount * tables, 0.0) / (theta + totals.customers)
    return known + base * (1 - params.unknown) / max(n_known, 1.0), base * params.unknown


# -- fitting and scoring ---------------------------------------------------


def score(docs: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """Fit on the rows that are not ``held_out`` and score all of ``docs`` (doc_id, text, held_out).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and
    score, the log10 probability under the model. A null or empty text is its end alone. Repeated rows
    are learned from, and scored, each time. With nothing to learn from every token is unknown.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, -(-size // params.bucket_bytes)))
    blocks = write_shared(_tokenised(docs, buckets, params), "blocks", by="kind")
    kind = {k: blocks.where(F.col("kind") == k).select(*_NAMES) for k in ("docs", "words", "keys")}

    # counts of words
    def count_words(rows: pd.DataFrame) -> list[tuple]:
        sums = _Sums(rows)
        counts = sums.add(rows.sort_values("block")["b"])
        bucket = int(rows["bucket"].iloc[0])
        total = _row("total", -1, bucket, x=float(counts.sum()), y=float((counts > 0).sum()))
        return [total, *(_row("count", b, bucket, x) for b, x in zip(sums.blocks, sums.answer(counts)))]

    counted = write_shared(_by_bucket(kind["keys"], count_words), "counts")
    n_train, n_known = counted.where("kind = 'total'").agg(F.sum("x"), F.sum("y")).first()
    n_train, n_known = int(n_train or 0), int(n_known or 0)
    counts = counted.where("kind = 'count'")

    # counts of pairs, and which block owns a pair
    def pairs_of(rows: pd.DataFrame) -> _Pairs:
        facts, words = _parts(rows, "docs"), _parts(rows, "words")
        return _Pairs(dec(facts["a"]).astype(np.int64), dec(words["a"]), int(dec(words["c"])[0]), buckets)

    def send_pairs(rows: pd.DataFrame) -> list[tuple]:
        facts, block = _parts(rows, "docs"), int(rows["block"].iloc[0])
        pairs = pairs_of(rows)
        train = np.repeat(dec(facts["c"]) == 0, dec(facts["b"]).astype(np.int64))
        found = np.bincount(pairs.of_token[train], minlength=len(pairs.key))
        return [
            _row("pair", block, i, enc_sorted(pairs.key[a:b]), enc(found[a:b]))
            for i, (a, b) in enumerate(zip(pairs.bounds, pairs.bounds[1:]))
            if a < b
        ]

    def count_pairs(rows: pd.DataFrame) -> list[tuple]:
        sums = _Sums(rows)
        found = sums.add(rows.sort_values("block")["b"])
        bucket = int(rows["bucket"].iloc[0])
        total = _row("total", -1, bucket, x=float((found == 1).sum()), y=float((found == 2).sum()))
        answers = zip(sums.blocks, sums.answer(found), sums.owned())
        return [total, *(_row("pairs", b, bucket, x, y) for b, x, y in answers)]

    texts = [kind["docs"], kind["words"]]
    paired = write_shared(_by_bucket(_by_block(texts, send_pairs), count_pairs), "pairs")
    once, twice = paired.where("kind = 'total'").agg(F.sum("x"), F.sum("y")).first()
    discount = _discount(once or 0, twice or 0)
    pair_counts = paired.where("kind = 'pairs'")

    # of the pairs a block owns: those with several customers, and the tables of the rest per word
    def own_pairs(rows: pd.DataFrame) -> list[tuple]:
        block = int(rows["block"].iloc[0])
        pairs, words = pairs_of(rows), _parts(rows, "words")
        n = len(dec(words["a"]))
        found = _gathered(rows, "pairs", "a").astype(np.int64)
        mine = _gathered(rows, "pairs", "b") > 0
        single, several = mine & (found == 1), mine & (found > 1)
        u, w, customers = pairs.u[several], pairs.w[several], found[several]
        fixed = tuple(np.bincount(x[single], minlength=n) for x in (pairs.u, pairs.w))
        ones = np.ones(len(u), np.int64)
        return [
            _row("own", block, -1, enc(u), enc(w), enc(customers), *map(enc, fixed)),
            _row("sizes", block, -1, words["b"]),
            _row("drawn", block, -1, enc(ones), enc(0 * ones)),
            *_tables_sent(block, dec(words["b"]), u, w, ones, fixed),
        ]

    owned = write_shared(_by_block([*texts, pair_counts], own_pairs), "owned", by="kind")
    static = owned.where(F.col("kind").isin("own", "sizes")).select(*_NAMES)
    drawn = owned.where("kind = 'drawn'").select(*_NAMES)
    sent = owned.where("kind = 'sent'").select(*_NAMES)
    keys = kind["keys"].select(*_NAMES)

    totals, kept, states = None, [], []
    for sweep in range(1 + params.burn_in + params.samples):
        # sum up the tables of all contexts, and seat them in the parent restaurant
        before = totals

        def seat_parent(rows: pd.DataFrame, before=before, sweep=sweep) -> list[tuple]:
            asked = rows[rows["kind"] == "keys"]
            sums, bucket = _Sums(asked), int(rows["bucket"].iloc[0])
            by_block = rows[rows["kind"] == "sent"].set_index("block")
            context, dish = (sums.add([by_block.at[b, c] for b in sums.blocks]) for c in ("a", "b"))
            if before is None:
                tables = np.minimum(dish, 1)
            else:
                rng = np.random.default_rng([params.seed, sweep, bucket])
                base = np.full(len(dish), (1 - params.unknown) / max(n_known, 1))
                others = np.full(len(dish), max(before.tables - 1, 0.0))
                tables = draw_tables(dish, others, base, before.discount, params.theta[1], rng, params.exact)
            total = _row("total", -1, bucket, enc(np.array([(dish == 1).sum(), (dish == 2).sum()])),
                         x=float(dish.sum()), y=float(tables.sum()))
            answers = zip(sums.blocks, sums.answer(context), sums.answer(dish), sums.answer(tables))
            return [total, *(_row("state", b, bucket, x, y, z) for b, x, y, z in answers)]

        seated = write_shared(_by_bucket(keys.unionByName(sent), seat_parent), "seated")
        sums = seated.where("kind = 'total'").agg(F.sum("x"), F.sum("y")).first()
        if totals is None:
            small = [dec(r["a"]) for r in seated.where("kind = 'total'").select("a").toLocalIterator()]
            parent_discount = _discount(*(sum(int(x[i]) for x in small) for i in (0, 1)))
        totals = Totals(sums[0] or 0.0, sums[1] or 0.0, parent_discount)
        state = seated.where("kind = 'state'")
        if sweep > params.burn_in:
            kept.append(totals)
            states.append(state.withColumn("kind", F.lit(f"state{len(kept) - 1}")))
        if sweep == params.burn_in + params.samples:
            break
        keep = sweep >= params.burn_in

        # draw the tables of every context from the state of the parent
        def seat_contexts(rows: pd.DataFrame, totals=totals, sweep=sweep, keep=keep) -> list[tuple]:
            block, own = int(rows["block"].iloc[0]), _parts(rows, "own")
            u, w, found = (dec(own[c]).astype(np.int64) for c in "abc")
            context, dish, tables = (_gathered(rows, "state", c).astype(np.int64) for c in "abc")
            last = _parts(rows, "drawn")
            now, added = dec(last["a"]).astype(np.int64), dec(last["b"]).astype(np.int64)
            p, _ = parent_probability(dish, tables, totals, n_known, params)
            rng = np.random.default_rng([params.seed, sweep, block & 0xFFFFFFFF, block >> 32])
            t = draw_tables(found, np.maximum(context[u] - now, 0), p[w], discount, params.theta[0], rng, params.exact)
            sizes = dec(_parts(rows, "sizes")["a"])
            fixed = dec(own["d"]).astype(np.int64), dec(own["e"]).astype(np.int64)
            return [
                _row("drawn", block, -1, enc(t), enc(added + t if keep else added)),
                *_tables_sent(block, sizes, u, w, t, fixed),
            ]

        swept = write_shared(_by_block([static, drawn, state], seat_contexts), "swept", by="kind")
        drawn = swept.where("kind = 'drawn'").select(*_NAMES)
        sent = swept.where("kind = 'sent'").select(*_NAMES)

    # blocks that do not own a pair get its tables from the one that does
    def send_drawn(rows: pd.DataFrame) -> list[tuple]:
        block, pairs = int(rows["block"].iloc[0]), pairs_of(rows)
        found = _gathered(rows, "pairs", "a").astype(np.int64)
        mine = _gathered(rows, "pairs", "b") > 0
        several = found > 1
        values = np.zeros(len(found), np.int64)
        values[mine & several] = dec(_parts(rows, "drawn")["b"]).astype(np.int64)
        return [
            _row("tables", block, i, enc_sorted(pairs.key[a:b][s]), enc(values[a:b][s]))
            for i, (a, b) in enumerate(zip(pairs.bounds, pairs.bounds[1:]))
            if (s := several[a:b]).any()
        ]

    def share_drawn(rows: pd.DataFrame) -> list[tuple]:
        sums, bucket = _Sums(rows), int(rows["bucket"].iloc[0])
        answers = sums.answer(sums.add(rows.sort_values("block")["b"]))
        return [_row("tables", b, bucket, x) for b, x in zip(sums.blocks, answers)]

    shared = write_shared(_by_bucket(_by_block([*texts, pair_counts, drawn], send_drawn), share_drawn), "tables")

    def score_block(rows: pd.DataFrame) -> pd.DataFrame:
        facts, pairs = _parts(rows, "docs"), pairs_of(rows)
        count = _gathered(rows, "count", "a").astype(np.float64)
        found = _gathered(rows, "pairs", "a").astype(np.float64)
        seats = np.minimum(found, 1)
        seats[found > 1] = _gathered(rows, "tables", "a") / max(len(kept), 1)
        known = count > 0
        backed = np.zeros(len(found))
        for i, total in enumerate(kept):
            context, dish, tables = (_gathered(rows, f"state{i}", c).astype(np.float64) for c in "abc")
            p, unknown = parent_probability(dish, tables, total, n_known, params)
            p = np.where(known, p, unknown)
            backed += (params.theta[0] + discount * context[pairs.u]) * p[pairs.w] / len(kept)
        p = (np.maximum(found - discount * seats, 0) + backed) / (params.theta[0] + count[pairs.u])
        tokens, lengths = dec(facts["a"]).astype(np.int64), dec(facts["b"]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        base = np.log10((count + 0.5) / (n_train + 0.5 * (n_known + 1)))
        ids = pd.array(dec(facts["d"]).view(np.int64), "Int64")
        ids[dec(facts["e"]) > 0] = pd.NA
        return pd.DataFrame(
            {
                "doc_id": ids,
                "held_out": dec(facts["c"]) > 0,
                "n_tokens": lengths,
                "n_known": np.add.reduceat(known[tokens].astype(np.int64), starts),
                "train_tokens": np.full(len(lengths), n_train),
                "base_score": np.add.reduceat(base[tokens], starts),
                "score": np.add.reduceat(np.log10(p)[pairs.of_token], starts),
            }
        )

    everything = [*texts, counts, pair_counts, shared, *states]
    union = everything[0]
    for part in everything[1:]:
        union = union.unionByName(part.select(*_NAMES))
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return union.groupBy("block").applyInPandas(score_block, schema)


def _tables_sent(block: int, sizes: np.ndarray, u, w, tables, fixed) -> list[tuple]:
    """Tables of the owned pairs, added up per context and per word, one row for each bucket of words."""
    n = int(sizes.sum())
    context = fixed[0] + np.bincount(u, tables, minlength=n).astype(np.int64)
    dish = fixed[1] + np.bincount(w, tables, minlength=n).astype(np.int64)
    ends = np.cumsum(sizes).astype(np.int64)
    return [
        _row("sent", block, i, enc(context[a:b]), enc(dish[a:b]))
        for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends))
        if a < b
    ]
