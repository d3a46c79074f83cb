import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ratingloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4)
    yield session
    session.stop()


RATING_SCHEMA = "user {id}, item {id}, rating double, ts timestamp, event_id bigint"


@pytest.fixture(scope="session")
def make_ratings(spark):
    """Ratings in event order from (user, item, rating) triples."""

    def make(rows, ids="bigint"):
        cast = str if ids == "string" else int
        numbered = [(cast(u), cast(i), float(r), n) for n, (u, i, r) in enumerate(rows)]
        frame = spark.createDataFrame(numbered, f"user {ids}, item {ids}, rating double, event_id bigint")
        return frame.selectExpr("user", "item", "rating", "timestamp_seconds(event_id) AS ts", "event_id")

    return make


# The small worked example: a re-rating by user 2, constant ratings by user 11.
MINI = [
    (1, 10, 5), (1, 11, 3), (1, 12, 1),
    (2, 10, 4), (2, 11, 3), (2, 12, 2), (2, 13, 2), (2, 13, 5),
    (9, 10, 1), (9, 11, 3), (9, 12, 5), (9, 14, 4),
    (10, 10, 5), (10, 11, 4), (10, 12, 1), (10, 14, 5), (10, 15, 2),
    (11, 10, 3), (11, 11, 3), (11, 15, 4),
]


@pytest.fixture(scope="session")
def mini(make_ratings):
    return make_ratings(MINI).cache()


@pytest.fixture(scope="session")
def mini_text(make_ratings):
    return make_ratings(MINI, "string").cache()
