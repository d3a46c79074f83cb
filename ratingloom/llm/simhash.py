"""SimHash near-duplicates, found by hashing balls around fingerprints.

Two fingerprints are linked if they differ in at most three of 64 bits. Half
the radius is one bit, so each fingerprint is sent to all variants within one
bit of it, and linked fingerprints meet halfway:

* over all 64 bits, fingerprints that share a variant differ in two bits at
  most. They are linked without a check, each to the smallest one. A variant
  has 65 fingerprints around it at most, so such a group is never large.
* for the remaining, odd bit, the 64 bits are cut into three blocks and each
  block is masked in turn. If two fingerprints differ in one to three bits, a
  block holds at least one of them, and with it masked the rest differ in two
  at most: they meet at a variant of the masked fingerprint, and the pair is
  verified. Only pairs that the first step left in different components are
  looked at, so a dense cluster does not give all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.components import components
from ratingloom.session import write_shared

RADIUS = 3
SHINGLE = 3
SEED = 42
#: First bit and length of each block that is masked.
BLOCKS = ((0, 21), (21, 21), (42, 22))

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    each = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(each[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return int(_POWERS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fp), the fingerprint as a signed long, and the columns to ``keep``."""
    names = ["doc_id", "fp", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names)

    kinds = {k: docs.schema[k].dataType.simpleString() for k in ("doc_id", *keep)} | {"fp": "long"}
    schema = ", ".join(f"{k} {kinds[k]}" for k in names)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _ball(fp: str, bits: list[int], marked: int = 0, keep: int = (1 << 64) - 1) -> F.Column:
    """All variants of the kept bits of ``fp`` within one of ``bits``, with a mark set."""
    flips = [marked, *((1 << b) | marked for b in bits)]
    masked = F.col(fp).bitwiseAND(F.lit(_signed(keep)))
    return F.transform(F.array(*(F.lit(_signed(f)) for f in flips)), lambda f: masked.bitwiseXOR(f))


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within two bits of each other."""
    variants = fps.select("fp", F.explode(_ball("fp", list(range(64)))).alias("variant"))
    hub = F.min("fp").over(Window.partitionBy("variant"))
    met = variants.withColumn("hub", hub).where("fp <> hub")
    return met.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def far_links(labelled: DataFrame) -> DataFrame:
    """Links (a, b) between labels of ``labelled`` (fp, label) that have fingerprints within three bits."""
    views = None
    for view, (first, length) in enumerate(BLOCKS):
        block = ((1 << length) - 1) << first
        bits = [b for b in range(64) if not block >> b & 1]
        ball = _ball("fp", bits, (view + 1) << first, ~block & ((1 << 64) - 1))
        rows = labelled.select("fp", "label", F.explode(ball).alias("variant"))
        views = rows if views is None else views.unionByName(rows)
    group = Window.partitionBy("variant")
    mixed = views.select(
        "*", F.min("label").over(group).alias("least"), F.max("label").over(group).alias("most")
    ).where("least < most")
    met = write_shared(mixed.select("variant", "fp", "label"), "met")
    other = met.select("variant", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS
    pairs = met.join(other, (met["variant"] == other["variant"]) & (F.col("label") < F.col("label2")) & near)
    return pairs.select(F.col("label").alias("a"), F.col("label2").alias("b")).distinct()


def _rooted(fps: DataFrame) -> DataFrame:
    """Rows of distinct ``fp`` with the ``root`` of their component in addition."""
    close = components(close_links(fps))
    labelled = fps.join(close.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = write_shared(labelled.withColumn("label", F.coalesce("label", "fp")), "labelled")
    far = components(far_links(labelled.select("fp", "label"))).withColumnRenamed("label", "root")
    rooted = labelled.join(far, labelled["label"] == far["node"], "left")
    return rooted.select(*fps.columns, F.coalesce("root", "label").alias("root"))


def first_rows(docs: DataFrame, key: str) -> DataFrame:
    """The ``key`` of one row of each component of ``docs`` (doc_id, text, key).

    It is the row with the smallest doc_id (null last), then the smallest
    fingerprint, then the smallest key.
    """
    printed = write_shared(fingerprints(docs, (key,)), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", key)
    fps = write_shared(printed.groupBy("fp").agg(F.min(row).alias("row")), "distinct_fps")
    least = _rooted(fps).groupBy("root").agg(F.min("row").alias("row"))
    return least.select(F.col(f"row.{key}").alias(key))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fingerprint, component_id).

    The fingerprint is 16 hex digits; component_id is the smallest doc_id that
    links lead to, itself included (null if the component has only null ids).
    A null text has no words, and so fingerprint zero, which links like any
    other. Repeated rows stay as they are; other columns are not read.
    """
    printed = write_shared(fingerprints(docs), "fingerprints")
    fps = write_shared(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fps")
    rooted = _rooted(fps)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    found = printed.join(classes, "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
