import json

import pytest
from pyspark.sql import functions as F

from ratingloom.operators.ratings import item_view_counts
from ratingloom.params import ALSParams, NeighbourParams, PopularityParams, engine_params_from_json
from ratingloom.sources import (
    dataset_summary,
    import_ratings_csv,
    read_event_store,
    rejected_events,
    scan_ratings,
)
from ratingloom.sources.csv_import import rejected_csv_lines
from ratingloom.sources.events import CLICKSTREAM

EVENT_SCHEMA = (
    "event_id bigint, event string, entityType string, entityId string, "
    "targetEntityType string, targetEntityId string, properties string"
)


def event(n, name="rate", item="7", properties='{"rating": 4.5, "timestamp": 100}', entity="user", target="item"):
    return (n, name, entity, "1", target, item, properties)


@pytest.fixture
def events(spark):
    return lambda *rows: spark.createDataFrame(list(rows), EVENT_SCHEMA)


def test_scan_keeps_rate_events_between_users_and_items(events):
    frame = events(event(0), event(1, "buy"), event(2, entity="device"), event(3, target="page"))
    (row,) = scan_ratings(frame).collect()
    assert (row.user, row.item, row.rating, row.event_id) == ("1", "7", 4.5, 0)
    assert row.ts.timestamp() == 100


BAD = [
    ("missing_rating", event(1, properties='{"timestamp": 1}')),
    ("missing_rating", event(1, properties='{"rating": "4.5"}')),
    ("missing_rating", event(1, properties="not json")),
    ("missing_target", event(1, item=None)),
]


@pytest.mark.parametrize(("reason", "bad"), BAD)
def test_bad_event_fails_a_strict_scan_and_is_reported_otherwise(events, reason, bad):
    frame = events(event(0), bad)
    with pytest.raises(Exception, match=f"cannot convert event 1 to a rating: {reason}"):
        scan_ratings(frame).collect()
    assert [r.event_id for r in scan_ratings(frame, strict=False).collect()] == [0]
    (row,) = rejected_events(frame).collect()
    assert (row.reason, row.n_rows, row.first_event_id) == (reason, 1, 1)


def test_strict_scan_fails_even_if_the_rating_is_not_used(events):
    frame = events(event(0), event(1, properties="{}"))
    with pytest.raises(Exception, match="cannot convert event 1"):
        item_view_counts(scan_ratings(frame)).collect()


def test_unexpected_event_is_reported(events):
    (row,) = rejected_events(events(event(0), event(5, "buy"))).collect()
    assert (row.reason, row.event, row.n_rows) == ("unexpected_event", "buy", 1)


def write(tmp_path, text):
    path = tmp_path / "ratings.csv"
    path.write_text(text)
    return str(path)


def test_csv_import(spark, tmp_path):
    path = write(tmp_path, "userId,movieId,rating,timestamp\n1,10,4.0,964982703\n1,12,3.5,964982931\n2,10,5,964982000\n")
    store = str(tmp_path / "store")
    import_ratings_csv(spark, path, store, "shop")
    import_ratings_csv(spark, path, store, "OtherApp")
    ratings = scan_ratings(read_event_store(spark, store, "shop"))
    assert sorted((r.user, r.item, r.rating) for r in ratings.collect()) == [
        ("1", "10", 4.0), ("1", "12", 3.5), ("2", "10", 5.0),
    ]
    plan = ratings._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(app" in plan and "PushedFilters: [" in plan


def test_csv_import_stops_at_a_bad_line(spark, tmp_path):
    path = write(tmp_path, "userId,movieId,rating,timestamp\n1,10,4.0,1\n1,12,good,2\n1,13,2.0,3\n")
    with pytest.raises(Exception):
        import_ratings_csv(spark, path, str(tmp_path / "strict"), "a")
    import_ratings_csv(spark, path, str(tmp_path / "tolerant"), "a", strict=False)
    found = scan_ratings(read_event_store(spark, str(tmp_path / "tolerant"), "a"))
    assert sorted(r.item for r in found.collect()) == ["10", "13"]
    bad = rejected_csv_lines(spark, path).collect()
    assert [tuple(r) for r in bad] == [("1,12,good,2", "rating is not a number")]


def test_csv_import_counts_and_may_be_repeated(spark, tmp_path):
    path = write(tmp_path, "userId,movieId,rating,timestamp\n1,10,4.0,1\n1,12,3,x\n1,13,2.0,3\n1\n1,2,3,4,5\n")
    store = str(tmp_path / "store")
    counts = [tuple(import_ratings_csv(spark, path, store, "a", strict=False).first()) for _ in range(2)]
    assert counts == [(2, 0, 3), (0, 2, 3)]
    assert scan_ratings(read_event_store(spark, store, "a")).count() == 2
    reasons = {r.line: r.reason for r in rejected_csv_lines(spark, path).collect()}
    assert reasons == {"1,12,3,x": "timestamp is not a number", "1": "too few columns", "1,2,3,4,5": "too many columns"}


def test_import_that_breaks_off_is_not_seen_and_may_be_repeated(spark, tmp_path, monkeypatch):
    from ratingloom.sources import csv_import

    store = str(tmp_path / "store")
    first = write(tmp_path, "userId,movieId,rating,timestamp\n1,10,4.0,1\n1,12,3,2\n")
    assert tuple(import_ratings_csv(spark, first, store, "a").first()) == (2, 0, 0)
    (tmp_path / "more").mkdir()
    second = write(tmp_path / "more", "userId,movieId,rating,timestamp\n1,12,3,2\n2,10,5,3\n2,11,1,4\n")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(csv_import, "create_file", broken)  # all files written, not published
        with pytest.raises(OSError):
            import_ratings_csv(spark, second, store, "a")
    items = lambda: sorted((r.user, r.item) for r in scan_ratings(read_event_store(spark, store, "a")).collect())
    assert items() == [("1", "10"), ("1", "12")]
    assert tuple(import_ratings_csv(spark, second, store, "a").first()) == (2, 1, 0)
    assert items() == [("1", "10"), ("1", "12"), ("2", "10"), ("2", "11")]
    assert len(csv_import.drop_unfinished_imports(spark, store)) == 1
    assert csv_import.drop_unfinished_imports(spark, store) == [] and len(items()) == 4


def test_first_import_that_breaks_off(spark, tmp_path, monkeypatch):
    from ratingloom.sources import csv_import

    path, store = write(tmp_path, "userId,movieId,rating,timestamp\n1,10,4.0,1\n"), str(tmp_path / "store")
    with monkeypatch.context() as m:
        m.setattr(csv_import, "create_file", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            import_ratings_csv(spark, path, store, "a")
    assert read_event_store(spark, store, "a").isEmpty()
    assert tuple(import_ratings_csv(spark, path, store, "a").first()) == (1, 0, 0)
    assert read_event_store(spark, store, "a").count() == 1


def test_lines_are_compared_whole(spark, tmp_path, monkeypatch):
    """Two ratings whose ids collide are both kept."""
    from ratingloom.sources import csv_import

    as_events = csv_import._as_events
    monkeypatch.setattr(csv_import, "_as_events", lambda rows: as_events(rows).withColumn("event_id", F.lit(7).cast("bigint")))
    store = str(tmp_path / "store")
    for n, line in enumerate(["1,10,4.0,1", "1,10,4.5,1", ",10,4.5,1", ",10,4.5,1"]):
        (tmp_path / str(n)).mkdir()
        import_ratings_csv(spark, write(tmp_path / str(n), f"userId,movieId,rating,timestamp\n{line}\n"), store, "a")
    assert read_event_store(spark, store, "a").count() == 3


def test_properties_are_parsed_once(events, spark):
    """In the filter, the check and the columns of a scan."""
    clicks = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    scans = [
        scan_ratings(events(event(0))),
        scan_ratings(events(event(0)), strict=False),
        scan_ratings(clicks, ("purchase",), CLICKSTREAM),
        scan_ratings(clicks, ("purchase",), CLICKSTREAM).select("user"),
        rejected_events(events(event(0))),
    ]
    for scan in scans:
        assert scan._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_summary(mini):
    found = [tuple(r) for r in dataset_summary(mini).collect()]
    assert set(found) == {
        ("n_ratings", "20"), ("n_users", "5"), ("n_items", "6"),
        ("sample", "Rating(1,10,5.00)"), ("sample", "Rating(1,11,3.00)"),
    }


def test_engine_json():
    text = json.dumps(
        {
            "datasource": {"params": {"appName": "shop", "evalParams": {"kFold": 10, "queryNum": 10}}},
            "algorithms": [
                {"name": "nb", "params": {"pearsonThreasholds": 5, "topNLikes": 150}},
                {"name": "als", "params": {"rank": 10, "numIterations": 20, "lambda": 0.01, "seed": 3}},
                {"name": "mv", "params": {"maxItems": 300}},
            ],
        }
    )
    params = engine_params_from_json(text)
    assert params.app_name == "shop" and params.eval_params.k_fold == 10
    assert [a.name for a in params.algorithms] == ["nb", "als", "mv"]
    assert [a.params for a in params.algorithms] == [NeighbourParams(5, 150), ALSParams(), PopularityParams(300)]
    with pytest.raises(ValueError, match="unknown algorithm 'pus'"):
        engine_params_from_json('{"algorithms": [{"name": "pus"}]}')
