"""Import of rating files into the event store."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.session import delete_folder, write_shared
from ratingloom.sources.events import FINISHED, read_event_store
from ratingloom.storage import create_file, make_folder, names_in

#: Columns by position; the header line is skipped.
RATING_FILE = T.StructType(
    [
        T.StructField("userId", T.StringType()),
        T.StructField("movieId", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
#: Holds the text of a line that does not fit the columns.
BAD_LINE = "_bad_line"
#: Columns of an event that hold all of a line.
WHOLE_LINE = ("entityId", "targetEntityId", "properties")


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a rating file, parsed once with all columns; bad ones keep their text in ``_bad_line``."""
    schema = T.StructType([*RATING_FILE.fields, T.StructField(BAD_LINE, T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    return write_shared(reader.csv(path), "csv_lines")


def _as_events(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.xxhash64("userId", "movieId", "timestamp", "rating").alias("event_id"),
        F.lit("rate").alias("event"),
        F.lit("user").alias("entityType"),
        F.col("userId").alias("entityId"),
        F.lit("item").alias("targetEntityType"),
        F.col("movieId").alias("targetEntityId"),
        F.to_json(F.struct("rating", "timestamp")).alias("properties"),
    )


def ratings_csv_to_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One ``rate`` event per line.

    A bad line stops a strict import; else it is left out, and
    :func:`rejected_csv_lines` has it.
    """
    if strict:
        reader = spark.read.schema(RATING_FILE).option("header", True).option("enforceSchema", True)
        return _as_events(reader.option("mode", "FAILFAST").csv(path))
    return _as_events(_read_lines(spark, path).where(F.col(BAD_LINE).isNull()))


def rejected_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, reason)`` of every line that a tolerant import leaves out."""
    bad = _read_lines(spark, path).where(F.col(BAD_LINE).isNotNull())
    reason = (
        F.when(F.size(F.split(BAD_LINE, ",")) < len(RATING_FILE.fields), "too few columns")
        .when(F.col("rating").isNull(), "rating is not a number")
        .when(F.col("timestamp").isNull(), "timestamp is not a number")
        .otherwise("too many columns")
    )
    return bad.select(F.col(BAD_LINE).alias("line"), reason.alias("reason"))


def import_ratings_csv(
    spark: SparkSession, path: str, store: str, app_name: str, strict: bool = True
) -> DataFrame:
    """Append a rating file to the event store of one application.

    Lines the store already has, compared whole, are not added again, so an
    import may be repeated. An import is read once it has been finished: one
    that breaks off leaves nothing that readers or a repetition see (see
    :func:`drop_unfinished_imports`). Returns one row ``(imported, known,
    rejected)`` of line counts.
    """
    events = ratings_csv_to_events(spark, path, strict).withColumn("app", F.lit(app_name))
    make_folder(spark, f"{store}/{FINISHED}")
    fresh = events
    if names_in(spark, f"{store}/{FINISHED}"):
        held = read_event_store(spark, store, app_name).select(*(F.col(c).alias(f"held_{c}") for c in WHOLE_LINE)).distinct()
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in WHOLE_LINE))
        fresh = events.join(held, same, "left_anti")
    # the batch is its own table, written once and counted from there
    batch = f"import-{uuid.uuid4().hex}"
    fresh.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("app", "batch").parquet(store)
    lines, imported = events.count(), _batch_size(spark, store, batch)
    rejected = 0 if strict else rejected_csv_lines(spark, path).count()
    create_file(spark, f"{store}/{FINISHED}/{batch}")
    counts = [(imported, lines - imported, rejected)]
    return spark.createDataFrame(counts, "imported long, known long, rejected long")


def _batch_size(spark: SparkSession, store: str, batch: str) -> int:
    """Lines of a batch; one without any has no files."""
    if not any(n.startswith("app=") for n in names_in(spark, store)):
        return 0
    return spark.read.parquet(store).where(F.col("batch") == batch).count()


def drop_unfinished_imports(spark: SparkSession, store: str) -> list[str]:
    """Delete what imports that broke off have left; for times when no import runs. Returns their batches."""
    finished, dropped = set(names_in(spark, f"{store}/{FINISHED}")), []
    for app in (n for n in names_in(spark, store) if n.startswith("app=")):
        for folder in names_in(spark, f"{store}/{app}"):
            batch = folder.removeprefix("batch=")
            if batch not in finished:
                delete_folder(spark, f"{store}/{app}/{folder}")
                dropped.append(batch)
    return dropped
