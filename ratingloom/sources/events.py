"""From stored events to ratings ``(user, item, rating, ts, event_id)``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.storage import names_in

#: Folder of an event store with a file for every finished import, named as its batch.
FINISHED = "_finished"


@dataclass(frozen=True)
class EventLayout:
    """Where the parts of a rating sit in an event table, as SQL expressions.

    ``parsed`` is what several of them need, such as a JSON column with all wanted fields; it is computed once per
    event, and the others refer to it as ``_parsed``. ``entity_type`` and ``target_type`` are null for tables that hold only
    user-to-item events.
    """

    event: str
    user: str
    item: str
    rating: str
    ts: str
    event_id: str
    entity_type: str | None = None
    target_type: str | None = None
    parsed: str | None = None


#: Tables written by :func:`ratingloom.sources.csv_import.import_ratings_csv`.
EVENT_STORE = EventLayout(
    event="event",
    user="entityId",
    item="targetEntityId",
    rating="_parsed.rating",
    ts="timestamp_seconds(_parsed.timestamp)",
    event_id="event_id",
    parsed="from_json(properties, 'rating DOUBLE, timestamp BIGINT')",
    entity_type="entityType",
    target_type="targetEntityType",
)

#: Click-stream tables with the item id under ``k`` of a JSON property column.
CLICKSTREAM = EventLayout(
    event="event_type",
    user="user_id",
    item="_parsed.k",
    rating="value",
    ts="ts",
    event_id="event_id",
    parsed="from_json(props, 'k BIGINT')",
)


def read_event_store(spark: SparkSession, path: str, app_name: str) -> DataFrame:
    """Events of one application, of all imports that have been finished; the store is partitioned by both."""
    finished = names_in(spark, f"{path}/{FINISHED}")
    return spark.read.parquet(path).filter((F.col("app") == app_name) & F.col("batch").isin(finished)).drop("batch")


def _fields(events: DataFrame, layout: EventLayout) -> DataFrame:
    if layout.parsed:
        # filters stay above a generator, so that parsing is not repeated in them
        parsed = F.struct(F.expr(layout.parsed).alias("_parsed"))
        events = events.select("*", F.inline(F.array(parsed)))
    return events.select(
        F.expr(layout.event).alias("event"),
        F.expr(layout.user).alias("user"),
        F.expr(layout.item).alias("item"),
        F.expr(layout.rating).cast("double").alias("rating"),
        F.expr(layout.ts).alias("ts"),
        F.expr(layout.event_id).alias("event_id"),
    )


def _typed(events: DataFrame, layout: EventLayout) -> DataFrame:
    if layout.entity_type:
        events = events.filter(F.expr(layout.entity_type) == "user")
    if layout.target_type:
        events = events.filter(F.expr(layout.target_type) == "item")
    return events


def _fault(event_names: Sequence[str]) -> Column:
    """Why a row cannot become a rating; null for good rows."""
    return (
        F.when(~F.coalesce(F.col("event").isin(*event_names), F.lit(False)), "unexpected_event")
        .when(F.col("rating").isNull(), "missing_rating")
        .when(F.col("user").isNull(), "missing_user")
        .when(F.col("item").isNull(), "missing_target")
    )


def scan_ratings(
    events: DataFrame,
    event_names: Sequence[str] = ("rate",),
    layout: EventLayout = EVENT_STORE,
    strict: bool = True,
) -> DataFrame:
    """Ratings of the named events.

    The event filter stays on the raw column, so it reaches the Parquet scan.
    A row without rating, user or target fails the job in strict mode, also
    where only other columns are used; otherwise it is left out and
    :func:`rejected_events` reports it.
    """
    wanted = _typed(events, layout).filter(F.expr(layout.event).isin(*event_names))
    rows = _fields(wanted, layout)
    fault = _fault(event_names)
    if strict:
        problem = F.concat(
            F.lit("cannot convert event "), F.col("event_id").cast("string"), F.lit(" to a rating: "), fault
        )
        rows = rows.filter(F.when(fault.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
    else:
        rows = rows.filter(fault.isNull())
    return rows.select("user", "item", "rating", "ts", "event_id")


def rejected_events(
    events: DataFrame,
    event_names: Sequence[str] = ("rate",),
    layout: EventLayout = EVENT_STORE,
) -> DataFrame:
    """Rows a strict conversion would fail on, counted by reason and event."""
    return (
        _fields(_typed(events, layout), layout)
        .withColumn("reason", _fault(event_names))
        .filter(F.col("reason").isNotNull())
        .groupBy("reason", "event")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("event_id").alias("first_event_id"),
            F.max("event_id").alias("last_event_id"),
        )
    )


def dataset_summary(ratings: DataFrame) -> DataFrame:
    """Counts of ratings, users and items and the first two ratings, one per row."""
    counts = ratings.agg(
        F.count(F.lit(1)).cast("string").alias("n_ratings"),
        F.count_distinct("user").cast("string").alias("n_users"),
        F.count_distinct("item").cast("string").alias("n_items"),
    ).unpivot([], ["n_ratings", "n_users", "n_items"], "name", "value")
    shown = F.format_string("Rating(%s,%s,%.2f)", F.col("user").cast("string"), F.col("item").cast("string"), "rating")
    sample = ratings.orderBy("event_id").limit(2).select(F.lit("sample").alias("name"), shown.alias("value"))
    return counts.unionByName(sample)
