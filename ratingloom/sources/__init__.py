"""Reading events and ratings, and storing models and reports."""

from ratingloom.sources.csv_import import drop_unfinished_imports, import_ratings_csv, ratings_csv_to_events
from ratingloom.sources.events import (
    CLICKSTREAM,
    EVENT_STORE,
    EventLayout,
    dataset_summary,
    read_event_store,
    rejected_events,
    scan_ratings,
)

__all__ = [
    "CLICKSTREAM",
    "EVENT_STORE",
    "EventLayout",
    "dataset_summary",
    "drop_unfinished_imports",
    "import_ratings_csv",
    "ratings_csv_to_events",
    "read_event_store",
    "rejected_events",
    "scan_ratings",
]
