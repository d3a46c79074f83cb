"""The corpus pipeline: stages that filter, dedupe, mix and tokenise ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again before the next stage. Stages read doc_id,
text, lang and source only; other columns, whatever their names, come through
as they are (the last stage leaves them out). An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import language_id, mixing, quality, segmentation, simhash
from ratingloom.llm.common import set_apart, table
from ratingloom.session import use_adaptive_plans, write_shared


READ = ("doc_id", "text", "lang", "source")


def _with_row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` of its own for every row, in a written table so that it stays."""
    return write_shared(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _named(rows: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in rows.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language (without a letter) and those whose language stays ambiguous.

    A null or empty text has no language. Repeated rows are judged alike.
    """
    use_adaptive_plans(spark)
    rows = set_apart(docs, READ)
    found = language_id.language_of_documents(rows, columns=tuple(rows.columns))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")
    return found.where(known).select(*_named(rows)).toDF(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or meet a rule learned from ``labels``.

    A null or empty text fails them. Repeated rows are judged alike.
    """
    use_adaptive_plans(spark)
    rows = set_apart(docs, READ)
    rated, _ = quality.rate(rows, table(spark, sf_dir, "labels"))
    return rated.where("kept").select(*_named(rows)).toDF(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group of linked fingerprints: that with the smallest id, null ids last.

    Rows are told apart by a key of their own. So repeated rows and copies
    without an id leave one row, and a different text stays where it shares
    its id with a copy.
    """
    use_adaptive_plans(spark)
    plain = set_apart(docs, READ)
    rows = _with_row_keys(plain)
    kept = rows.join(simhash.first_rows(rows, "_row"), "_row", "left_semi")
    return kept.select(*_named(plain)).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that every source meets its target.

    Texts stay whole: a document comes as many times as the whole copies nearest
    to the words taken from it (half a copy or more counts as one). Only the
    document on the border of a target is rounded, so a source is off its
    target by half of that document at most. Every row counts by itself, also
    where doc_ids are null or repeated. Documents without words are dropped.
    """
    use_adaptive_plans(spark)
    plain = set_apart(docs, READ)
    rows = _with_row_keys(plain)
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    mixed = mixing.mix_documents(rows, keep=("_row",)).where("taken > 0").select("_row", copies.alias("_copies"))
    joined = rows.join(mixed.where("_copies > 0"), "_row")
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*_named(plain)).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece segmentations of every document.

    A null or empty text has one, without pieces; repeated rows get the same ones. Other columns are
    left out.
    """
    use_adaptive_plans(spark)
    return segmentation.sample_segmentations(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_rules", keep_good_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Learned decisions and sampled segmentations cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return docs
