"""Batches of queries: which users ask, and for how many items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.session import write_shared


class Requests:
    """The distinct ``(user, num)`` of a batch of queries, per ``by``, stored, and their largest ``num``.

    Several recommenders answer the same batch, so it is computed once.
    """

    def __init__(self, queries: DataFrame, by: Sequence[str] = ()):
        self.rows = write_shared(queries.select(*by, "user", "num").distinct(), "requests")
        self.most = self.rows.agg(F.max("num")).first()[0] or 0


def requests_of(queries: DataFrame | Requests) -> Requests:
    return queries if isinstance(queries, Requests) else Requests(queries)


def asked_rows(queries: DataFrame | Requests) -> DataFrame:
    return queries.rows if isinstance(queries, Requests) else queries


def most_asked(queries: DataFrame | Requests) -> int:
    return queries.most if isinstance(queries, Requests) else queries.agg(F.max("num")).first()[0] or 0
