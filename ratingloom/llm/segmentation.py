"""SentencePiece encoding with sampled segmentations, and decoding.

The vocabulary of a SentencePiece model spans a lattice over every text: an
edge for each piece that fits, byte pieces for characters without one. A piece
of merge rank r weighs 1 / (r + 2), as frequencies fall with the rank, and a
segmentation has the normalised product of its pieces' weights as probability.

``k`` distinct segmentations are drawn by Gumbel top-k: every segmentation
gets its log probability plus Gumbel noise, and the k largest win. The search
is A*: a node stands for all segmentations that share a prefix of pieces,
its value is the largest perturbed score below it, and the best open node is
opened first. Opening a node draws the segmentation that attains its value
(backward sums give the exact probability of each next piece) and leaves one
open node per step: all segmentations that turn off there.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import slices

#: A space in pieces; one stands before every text.
SPACE = "▁"


@dataclass(frozen=True)
class SegmentParams:
    """``model_file`` is the tokenizer's file on every executor; ``k`` segmentations are drawn, from
    weights raised to ``power``. ``chunk`` bounds the characters worked on at once (a longer text is
    worked on alone).
    """

    model_file: str = "/opt/tokenizers/piece_bpe_32k.model"
    k: int = 2
    power: float = 1.0
    seed: int = 1
    chunk: int = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit counters into random bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1), one for each key."""
    return ((_mix(keys) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(224, dtype=np.uint64) * _STEP


def _uniform_of(seed: int, part: int, index: int, step: int = 0) -> float:
    """One number inside (0, 1), for the few draws of a text that are not made in bulk."""
    x = (seed + part * 0x632BE59B + index * 0x1F123BB5 + step * 0x9E3779B97F4A7C15 + 1) % (1 << 64)
    for _ in range(2):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
        x ^= x >> 31
    return ((x >> 12) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces as a trie in an open hash table that numpy can walk for many positions at once."""

    def __init__(self, params: SegmentParams):
        self.model = sentencepiece.SentencePieceProcessor(model_file=params.model_file)
        model = self.model
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        weights = np.zeros(model.get_piece_size())
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue  # byte pieces stand for characters
            if SPACE in piece[1:] and piece.strip(SPACE):
                raise ValueError(f"piece {i} goes on after a space, so texts cannot be cut there")
            weights[i] = -params.power * np.log(2.0 + min(-model.get_score(i), model.get_piece_size()))
            node = 0
            for c in piece:
                node = children.setdefault((node, ord(c)), len(children) + 1)
            ends[node] = i
        self.weights = weights
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        #: of a byte piece: that of a piece after the last one
        self.byte_weight = -params.power * np.log(2.0 + model.get_piece_size())
        self.piece_at = np.full(len(children) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        bits = max(12, int(len(children) * 8).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        pairs = np.array([(n << 21 | c, v) for (n, c), v in children.items()], np.int64)
        slot = self._slot(pairs[:, 0])
        left = np.arange(len(pairs))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = pairs[free, 0]
            won = self.keys[slot[left]] == pairs[left, 0]
            self.next[slot[left[won]]] = pairs[left[won], 1]
            left = left[~won]
            slot[left] = (slot[left] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (_mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Child of each node by each character, or -1."""
        keys = nodes.astype(np.int64) << 21 | chars
        slot = self._slot(keys)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            slot[open_] = (slot[open_] + 1) & int(self.mask)
        return found


@lru_cache(2)
def vocabulary(params: SegmentParams) -> Vocabulary:
    return Vocabulary(params)


class Lattice:
    """All edges of the distinct units of a chunk, with the probability of each as the next step.

    Positions are numbered by their distance from the end of their unit, so that
    a backward step is one slice of all arrays. The edges of position p are
    ``first[p] : first[p + 1]``; an edge leads to position ``target``, or to the
    end of the unit (-1). ``piece`` is a piece id, or -1 - code for a character
    spelled in bytes.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, vocab: Vocabulary):
        n, end = len(codes), np.cumsum(lengths)
        left = np.repeat(end, lengths) - np.arange(n)
        # numbers of 16 bits are sorted by radix
        short = n and left.max() < 1 << 16
        order = np.argsort(left.astype(np.uint16) if short else left, kind="stable")
        number = np.empty(n + 1, np.int64)
        number[order] = np.arange(n)
        number[n] = -1
        self.start = number[end - lengths]
        # pieces that fit, found by walking the trie from all positions at once
        shift = len(vocab.weights).bit_length()
        none = len(vocab.weights)
        at, nodes, found = np.arange(n), np.zeros(n, np.int64), []
        spelled = np.ones(n, bool)
        depth = 0
        while len(at):
            nodes = vocab.step(nodes, codes[at + depth])
            alive = nodes >= 0
            at, nodes = at[alive], nodes[alive]
            depth += 1
            piece = vocab.piece_at[nodes]
            fits = piece >= 0
            if depth == 1:
                spelled[at[fits]] = False
            found.append((number[at[fits]] << 5 | depth) << shift | piece[fits])
            more = left[at] > depth
            at, nodes = at[more], nodes[more]
        found.append((number[:n][spelled] << 5 | 1) << shift | none)
        edges = np.concatenate(found)
        # arrays over all edges go as soon as they are used up
        del found
        edges.sort()
        self.piece = (edges & ((1 << shift) - 1)).astype(np.int32)
        size = (edges >> shift & 31).astype(np.int32)
        self.begin = (edges >> (shift + 5)).astype(np.int32)
        del edges
        self.first = np.searchsorted(self.begin, np.arange(n + 1))
        origin = order[self.begin]
        self.target = np.where(left[origin] > size, number[origin + size], -1).astype(np.int32)
        plain = np.flatnonzero(self.piece == none)
        weight = np.append(vocab.weights, 0.0)[self.piece]
        spelling = codes[origin[plain]]
        weight[plain] = vocab.byte_weight * _utf8_length(spelling)
        self.piece[plain] = -1 - spelling
        del size, origin, plain, spelling
        steps = np.searchsorted(left[order], np.arange(1, (int(left.max()) if n else 0) + 2))
        self._sum_up(weight, steps)

    def _sum_up(self, weight: np.ndarray, steps: np.ndarray) -> None:
        """Backward sums, for all units at once: positions in order of their distance from the end."""
        n = len(self.first) - 1
        beta = np.zeros(n + 1)  # the last one is the end of every unit
        for a, b in zip(steps, steps[1:]):
            x, y = self.first[a], self.first[b]
            v = weight[x:y]
            v += beta[self.target[x:y]]
            offset = self.first[a:b] - x
            top = np.maximum.reduceat(v, offset)
            inside = self.begin[x:y] - a
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(v - top[inside]), offset))
            v -= beta[a:b][inside]
        self.log_p = weight
        p = np.exp(weight)
        #: log of the probability of the other edges of the same position
        with np.errstate(divide="ignore"):
            self.rest = np.log1p(-np.minimum(p, 1.0))
        single = np.diff(self.first) == 1
        self.rest[self.first[:-1][single]] = -np.inf
        sums = np.cumsum(p)
        before = (sums - p)[self.first[:-1]]
        del p
        sums -= before[self.begin]
        self.upto = sums
        self.upto[self.first[1:] - 1] = np.inf  # the last edge takes what rounding leaves

    def walk(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path through each unit: edges in order, and where each unit's begin."""
        at, rows, steps = self.start[units], np.arange(len(units)), []
        keys = keys.copy()
        while len(rows):
            keys += _STEP
            u = _uniform(keys)
            edge = self.first[at]
            late = np.flatnonzero(self.upto[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.upto[edge[late]] <= u[late]]
            steps.append((rows, edge))
            at = self.target[edge]
            go = at >= 0
            rows, at, keys = rows[go], at[go], keys[go]
        counts = np.zeros(len(units) + 1, np.int64)
        for r, _ in steps:
            counts[r + 1] += 1
        offsets = np.cumsum(counts)
        path = np.empty(offsets[-1], np.int64)
        for t, (r, edge) in enumerate(steps):
            path[offsets[r] + t] = edge
        return path, offsets


def _utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def _below(phi: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``phi``, given that they are below ``top``."""
    return phi - np.log(np.exp(phi - top) - np.log(u))


def _one_below(phi: float, top: float, u: float) -> float:
    return phi - math.log(math.exp(phi - top) - math.log(u)) if phi > -math.inf else -math.inf


#: Above this no noise from 52 random bits can get.
_MOST_NOISE = 37.0


class _Path:
    """A drawn segmentation: its edges, and the open node at every step from ``since`` on.

    Open nodes are valued step by step, as far as they can matter: their log
    probability falls from step to step, so once it is out of reach of the best
    value by more than the noise can be, later ones cannot be the best.
    """

    def __init__(self, edges, offsets, lattice, value, since, key):
        self.edges, self.value, self.offsets, self.lattice = edges, value, offsets, lattice
        self.before = np.zeros(len(edges) + 1)
        np.cumsum(lattice.log_p[edges], out=self.before[1:])
        self.taken, self.key, self.since = {}, np.uint64(key), since
        self.open = np.zeros(0)
        self._settle()

    def _settle(self) -> None:
        n = len(self.edges)
        while True:
            a = self.since + len(self.open)
            best = int(self.open.argmax()) if len(self.open) else 0
            top = float(self.open[best]) if len(self.open) else -math.inf
            if a == n or top > self.before[a] + _MOST_NOISE:
                self.best = self.since + best, top
                return
            b = min(n, a + len(_STEPS))
            u = _uniform(self.key + np.uint64(a * 0x9E3779B97F4A7C15 % (1 << 64)) + _STEPS[: b - a])
            # a node without other edges has log probability -inf, and so value -inf
            valued = _below(self.before[a:b] + self.lattice.rest[self.edges[a:b]], self.value, u)
            self.open = np.concatenate((self.open, valued)) if len(self.open) else valued

    def close(self, step: int, value: float) -> None:
        self.open[step - self.since] = value
        self._settle()


def draw(lattice: Lattice, walks, seed: int, k: int) -> tuple[list[_Path], float]:
    """The k best perturbed segmentations of one text (fewer if it has fewer), and the value of the next.

    ``walks`` are k fresh random paths, each as (edges, offsets of the units).
    """
    root = -math.log(-math.log(_uniform_of(seed, 1, 0)))
    paths = [_Path(*walks[0], lattice, root, 0, (seed ^ 0xA5A5A5A5) % (1 << 64))]
    while len(paths) < k:
        parent = max(paths, key=lambda p: p.best[1])
        step, value = parent.best
        if value == -math.inf:
            break
        number, here = len(paths), int(parent.edges[step])
        used = parent.taken.setdefault(step, {here})
        at = int(lattice.begin[here])
        others = [e for e in range(int(lattice.first[at]), int(lattice.first[at + 1])) if e not in used]
        log_p = [float(lattice.log_p[e]) for e in others]
        most = max(log_p)
        share = list(accumulate(math.exp(x - most) for x in log_p))
        choice = min(bisect_right(share, _uniform_of(seed, 3, number) * share[-1]), len(others) - 1)
        used.add(turn := others[choice])
        # the node that is left: everything else that turns off at this step
        remain = sum(math.exp(x - most) for i, x in enumerate(log_p) if i != choice)
        left = float(parent.before[step]) + most + math.log(remain) if remain else -math.inf
        parent.close(step, _one_below(left, value, _uniform_of(seed, 4, number)))
        # finish the unit piece by piece, then go on with a fresh walk
        fresh, offsets = walks[number]
        unit = int(np.searchsorted(parent.offsets, step, side="right")) - 1
        tail = [turn]
        while (at := int(lattice.target[tail[-1]])) >= 0:
            inside = lattice.upto[lattice.first[at] : lattice.first[at + 1]].tolist()
            tail.append(int(lattice.first[at]) + bisect_right(inside, _uniform_of(seed, 5, number, len(tail))))
        shift = step + len(tail) - offsets[unit + 1]
        joined = np.concatenate((parent.edges[:step], tail, fresh[offsets[unit + 1] :]))
        joined_offsets = np.concatenate((parent.offsets[: unit + 1], offsets[unit + 1 :] + shift))
        key = (seed ^ 0xA5A5A5A5) + number * 0x1F123BB5
        paths.append(_Path(joined, joined_offsets, lattice, value, step + 1, key % (1 << 64)))
    return paths, max(p.best[1] for p in paths)


def log_inclusion(phi: float, threshold: float) -> float:
    """Log of the probability that a segmentation of log probability ``phi`` exceeds the threshold."""
    if threshold == -math.inf:
        return 0.0
    x = phi - threshold
    if x < -30:
        return x
    return math.log(-math.expm1(-math.exp(x))) if x < 30 else 0.0


def piece_ids(piece: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Ids of pieces, characters without one spelled as byte pieces."""
    plain = piece < 0
    if not plain.any():
        return piece
    codes = -1 - piece
    if codes[plain].max() < 0x80:
        return np.where(plain, vocab.byte_ids[np.where(plain, codes, 0)], piece)
    out = []
    for run in np.split(piece, np.flatnonzero(np.diff(plain)) + 1):
        spelled = run[0] < 0
        raw = np.frombuffer("".join(map(chr, -1 - run)).encode(), np.uint8) if spelled else None
        out.append(vocab.byte_ids[raw] if spelled else run)
    return np.concatenate(out)


def cut_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points and lengths of the distinct units of ``texts``; units in order by number; where each text's begin.

    Pieces are runs of spaces, or hold no space after their first character, and none holds a line
    break. So a unit is a run of spaces with the characters that follow, or one line break. A text
    starts with a space of its own; an empty one has no units.
    """
    raw = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    joined = b"".join(raw)
    data = np.frombuffer(joined, np.uint8)
    space, line = data == 0x20, data == 0x0A
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    sizes = np.diff(ends, prepend=0)
    begins[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(begins)
    offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
    cut = pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(joined)).dictionary_encode()
    lengths = pc.utf8_length(cut.dictionary).to_numpy().astype(np.int64)
    n_bytes = pc.sum(pc.binary_length(cut.dictionary)).as_py() or 0
    spelled = cut.dictionary.buffers()[2].to_pybytes()[:n_bytes] if n_bytes else b""
    codes = np.frombuffer(spelled.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    codes[codes == 0x20] = ord(SPACE)
    return codes, lengths, cut.indices.to_numpy().astype(np.int64), np.searchsorted(at, np.insert(ends, 0, 0))


def sample_texts(texts: list[str], seeds: np.ndarray, params: SegmentParams) -> Iterator[tuple[int, int, dict]]:
    """(text number, rank, facts) of the segmentations drawn for each text."""
    # counters run over, and a node without alternatives has log probability -inf
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        yield from _sample_texts(texts, seeds, params)


def _sample_texts(texts: list[str], seeds: np.ndarray, params: SegmentParams) -> Iterator[tuple[int, int, dict]]:
    for a, b in slices(texts, params.chunk):
        # in a call of its own, so that the lattice of a slice is gone before the next one is built
        yield from ((a + i, rank, facts) for i, rank, facts in _sample_slice(texts[a:b], seeds[a:b], params))


def _sample_slice(texts: list[str], seeds: np.ndarray, params: SegmentParams) -> Iterator[tuple[int, int, dict]]:
    vocab = vocabulary(params)
    codes, lengths, ids, bounds = cut_units(texts)
    lattice = Lattice(codes, lengths, vocab) if len(lengths) else None
    inner = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    own = np.repeat(seeds, np.diff(bounds)) + inner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    walks = [lattice.walk(ids, _mix(own + np.uint64(977 * s + 13))) for s in range(params.k)] if lattice else []
    del codes, lengths, ids, inner, own
    for i in range(len(texts)):
        if not texts[i]:
            yield i, 0, {"ids": np.zeros(0, np.int32), "log_p": 0.0, "gumbel": 0.0, "log_inclusion": 0.0}
            continue
        own_walks = []
        for path, offsets in walks:
            own_offsets = offsets[bounds[i] : bounds[i + 1] + 1]
            own_walks.append((path[own_offsets[0] : own_offsets[-1]], own_offsets - own_offsets[0]))
        paths, threshold = draw(lattice, own_walks, int(seeds[i]), params.k)
        for rank, path in enumerate(paths):
            phi = float(path.before[-1])
            yield (
                i,
                rank,
                {
                    "ids": piece_ids(lattice.piece[path.edges], vocab),
                    "log_p": phi,
                    "gumbel": float(path.value),
                    "log_inclusion": log_inclusion(phi, threshold),
                },
            )


def sample_segmentations(docs: DataFrame, params: SegmentParams = SegmentParams()) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, rank, n_pieces, log_p, gumbel, log_inclusion, ids).

    Up to k rows for each row of ``docs``, all different, ranked from 0 by their perturbed score
    ``gumbel``; ``log_p`` is the log probability and ``log_inclusion`` the log of the probability of
    being among the drawn, given the first score that was not. The draw is seeded by the doc_id, so
    repeated rows get the same answer. A null or empty text has one segmentation, without pieces.
    ``ids`` hold the piece ids. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            seeds = np.array([xxhash.xxh64_intdigest(str(k), params.seed) for k in keys], np.uint64)
            at, facts, size = [], [], 0
            for number, rank, fact in sample_texts(texts, seeds, params):
                at.append((number, rank))
                facts.append(fact)
                size += len(fact["ids"])
                if size > 1 << 20:
                    yield _rows(batch, at, facts)
                    at, facts, size = [], [], 0
            if at:
                yield _rows(batch, at, facts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, rank int, n_pieces int, log_p double, gumbel double, log_inclusion double, ids array<int>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, at: list, facts: list) -> pa.RecordBatch:
    sizes = np.array([len(f["ids"]) for f in facts], np.int32)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    flat = pa.array(np.concatenate([f["ids"] for f in facts]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array([i for i, _ in at])),
            pa.array([r for _, r in at], pa.int32()),
            pa.array(sizes),
            *(pa.array([f[name] for f in facts]) for name in ("log_p", "gumbel", "log_inclusion")),
            pa.ListArray.from_arrays(offsets, flat),
        ],
        ["doc_id", "rank", "n_pieces", "log_p", "gumbel", "log_inclusion", "ids"],
    )


def decode(rows: DataFrame, params: SegmentParams = SegmentParams()) -> DataFrame:
    """``rows`` with ``ids`` (piece ids) gain ``decoded``, the text; null ids give null.

    The text is the one that was encoded, but that U+2581 comes back as a space. A column that is
    called ``decoded`` already gives way to it.
    """
    rows = rows.drop("decoded")
    names = [*rows.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = vocabulary(params).model
            ids = batch.column(names.index("ids")).to_pylist()
            texts = [None if x is None else model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*fields, "decoded string"]))


def round_trips(rows: DataFrame, docs: DataFrame, params: SegmentParams = SegmentParams()) -> DataFrame:
    """Rows whose ids do not decode to the text of their document; empty if all is well."""
    back = decode(rows, params).join(docs.select("doc_id", "text"), "doc_id")
    return back.where(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))))
