"""The hybrid engine: several recommenders trained on one set of ratings."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.ratings import TrainingData, prepare
from ratingloom.operators.requests import Requests
from ratingloom.operators.serving import as_results, blend
from ratingloom.params import AlgorithmSpec, EngineParams
from ratingloom.plans.recommenders import RECOMMENDERS, Model, Neighbourhood
from ratingloom.session import delete_folder, scratch, use_adaptive_plans
from ratingloom.storage import current_version, save_version


@dataclass(frozen=True)
class HybridModel:
    """Fitted recommenders in the order of the settings, with their names.

    ``folder`` holds the tables that fitting stored, and those of later
    requests; :meth:`close` deletes it, after which the model is of no use.
    """

    parts: tuple[tuple[str, Model], ...]
    folder: str | None = None

    def recommend(self, queries: DataFrame) -> DataFrame:
        """Blended ``(user, num, item, score, rank)``; the queries are read once for all recommenders."""
        with scratch(queries.sparkSession, self.folder):
            requests = Requests(queries)
        return blend([model.recommend(requests) for _, model in self.parts], requests)

    def serve(self, queries: DataFrame) -> DataFrame:
        """One row per query with its ordered item list."""
        return as_results(self.recommend(queries), queries)

    def close(self, spark: SparkSession) -> None:
        if self.folder:
            delete_folder(spark, self.folder)

    def summary(self) -> DataFrame:
        """``(position, model, name, value)``: sizes of each recommender's tables, and its settings."""
        parts = [
            model.summary().select(F.lit(i).alias("position"), F.lit(name).alias("model"), "name", "value")
            for i, (name, model) in enumerate(self.parts)
        ]
        return reduce(DataFrame.unionByName, parts)

    def save(self, spark: SparkSession, path: str) -> None:
        """Store as a new version of ``path``, seen by :meth:`load` once all of it is there."""

        def write(version: str) -> None:
            for i, (_, model) in enumerate(self.parts):
                model.save(f"{version}/part-{i}")
            names = [(i, name) for i, (name, _) in enumerate(self.parts)]
            spark.createDataFrame(names, "position int, name string").write.parquet(f"{version}/names")

        save_version(spark, path, write)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HybridModel:
        """The last version that was stored whole; an error if files of it are missing."""
        version = current_version(spark, path)
        # one row per configured recommender
        names = spark.read.parquet(f"{version}/names").orderBy("position").collect()
        return cls(
            tuple((r["name"], RECOMMENDERS[r["name"]].load(spark, f"{version}/part-{r['position']}")) for r in names)
        )


@dataclass(frozen=True)
class HybridEngine:
    """Trains the configured recommenders; ``prepare_step`` may alter the ratings."""

    params: EngineParams
    prepare_step: Callable[[DataFrame], DataFrame] | None = None
    compat: bool = False

    def fit(self, ratings: DataFrame) -> HybridModel:
        spark = use_adaptive_plans(ratings.sparkSession)
        with scratch(spark) as folder:
            return HybridModel(self._fit_parts(ratings), folder)

    def _fit_parts(self, ratings: DataFrame) -> tuple[tuple[str, Model], ...]:
        prepared = TrainingData(prepare(ratings, self.prepare_step))
        lists: dict[object, Neighbourhood] = {}
        parts = []
        for spec in self.params.algorithms:
            recommender = make_recommender(spec, self.compat)
            if RECOMMENDERS[spec.name].uses_neighbourhood:
                # hybrids with equal settings share one neighbour search
                if spec.params not in lists:
                    lists[spec.params] = Neighbourhood.build(prepared, spec.params, self.compat)
                model = recommender.fit(prepared, lists[spec.params])
            else:
                model = recommender.fit(prepared)
            parts.append((spec.name, model))
        return tuple(parts)


def make_recommender(spec: AlgorithmSpec, compat: bool = False):
    if spec.name not in RECOMMENDERS:
        raise ValueError(f"unknown algorithm {spec.name!r}; known: {sorted(RECOMMENDERS)}")
    return RECOMMENDERS[spec.name].create(spec.params, compat=compat)


def describe(algorithms: tuple[AlgorithmSpec, ...]) -> str:
    """Settings as one stable line of text, for reports."""
    parts: list[Mapping] = [{"name": a.name, "params": asdict(a.params)} for a in algorithms]
    return json.dumps(parts, sort_keys=True)
