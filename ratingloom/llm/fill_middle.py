"""Fill-in-the-middle transformation with an indexable skip list over the units of a text.

A unit is a word with the white space before it; white space at the end of a
text is a unit of its own. Two cut ranks, drawn from a hash of the doc_id,
divide the units into prefix, middle and suffix, which are put out of order
between marks, so that a model learns to fill in the middle.

The units stand in a skip list. Its lowest lane has a node for every unit;
each lane above keeps about a quarter of the nodes below, chosen by a hash of
their place. Every node carries two widths, how many units and how many code
points it skips from the node before it in its lane. The code point of a cut
is found by descending from the top lane: walk on while the units summed up
so far do not pass the rank, then go down a lane. The summed code points at
the end are the cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One in ``1 << LANE_BITS`` nodes of a lane goes on into the lane above.
LANE_BITS = 2

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class FillParams:
    """``percent`` of the texts are transformed, ``spm_percent`` of those with the suffix first."""

    seed: int = 42
    percent: int = 50
    spm_percent: int = 80


def unit_ends(text: str) -> np.ndarray:
    """Code points up to the end of each unit of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 0x20) | (codes - np.uint32(9) <= 4)  # below 9 the difference runs over
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(codes)) if len(codes) else ends


class SkipList:
    """Lanes of ``(units, chars, down)``: two widths of each node, and its place in the lane below."""

    def __init__(self, ends: np.ndarray):
        self.size = len(ends)
        units = np.ones(len(ends), np.int64)
        self.lanes = [(units, np.diff(ends, prepend=0), np.arange(len(ends)))]
        lots = np.arange(len(ends), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        lots = (lots ^ (lots >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        lots >>= np.uint64(2)
        while len(lots) > 1 << LANE_BITS:
            up = np.flatnonzero(lots & np.uint64((1 << LANE_BITS) - 1) == 0)
            if not 0 < len(up) < len(lots):
                break
            below = self.lanes[-1]
            widths = (np.diff(np.cumsum(w)[up], prepend=0) for w in below[:2])
            self.lanes.append((*widths, up))
            lots = lots[up] >> np.uint64(LANE_BITS)

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        units = chars = 0
        ahead = 0  # node of the lane that comes next
        for lane_units, lane_chars, down in reversed(self.lanes):
            while ahead < len(lane_units) and units + lane_units[ahead] <= rank:
                units += int(lane_units[ahead])
                chars += int(lane_chars[ahead])
                ahead += 1
            ahead = int(down[ahead - 1]) + 1 if ahead else 0
        return chars


def lots(key: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 from a hash of the key; a null key counts as the empty text."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(key: int | None, text: str, params: FillParams) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, code points of the prefix and of the middle, output)."""
    ends = unit_ends(text)
    n = len(ends)
    h = lots(key, params.seed)
    if not n or h[2] % 100 >= params.percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    units = SkipList(ends)
    a, b = (units.chars_before(rank) for rank in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < params.spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, params: FillParams = FillParams()) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n, form, prefix_chars, middle_chars, output).

    ``form`` is plain, spm or psm. Whole texts count, however long. A null text is empty; an empty
    text, and one that holds a mark, stays plain. The cuts depend on the doc_id alone, so repeated
    rows get the same answer each; null doc_ids count as the empty text. Equal cuts give an empty
    middle. Other columns are not read. An empty table gives none.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            columns = zip(*(transform(key, text or "", params) for key, text in rows))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from its form and its marks alone.

    A text that holds a mark is left plain, and marks begin with a sign they hold only once, so
    the first of each kind is the one that was put in.
    """
    width = len(PREFIX)

    def after(mark: str) -> Column:
        return F.instr(output, mark) + width

    def upto(mark: str, following: str) -> Column:
        return output.substr(after(mark), F.instr(output, following) - after(mark))

    middle = output.substr(after(MIDDLE), F.length(output))
    psm = F.concat(upto(PREFIX, SUFFIX), middle, upto(SUFFIX, MIDDLE))
    spm = F.concat(upto(PREFIX, MIDDLE), middle, upto(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """Output of :func:`fill_in_middle` with hashes of the output and of the restored text in its place."""
    output, form = F.col("output"), F.col("form")
    return rows.select(
        *(c for c in rows.columns if c != "output"),
        F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(output, form).cast("binary"), 256).alias("restored_sha256"),
    )
