"""The four recommenders, each as settings -> fit -> recommend -> save/load.

``fit`` takes ratings ``(user, item, rating, ts, event_id)``, as a DataFrame or
as :class:`TrainingData` to share work between recommenders; ``recommend``
takes a batch of queries ``(user, num)`` and returns ``(user, num, item, score,
rank)``, one list for each distinct query. Lists are computed and stored by
``fit``; ``recommend`` reads them. A recommender of your own needs these methods and an entry in
:data:`RECOMMENDERS`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.ml.classification import NaiveBayesModel, RandomForestClassificationModel
from pyspark.ml.recommendation import ALSModel as SparkALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.block_search import similar_users
from ratingloom.operators.classify import classify, fit_forest, fit_naive_bayes
from ratingloom.operators.collaborative import cf_candidates, ranked_shares
from ratingloom.operators.factorization import Factorization, als_recommend, fit_als
from ratingloom.operators.popularity import item_views_top, popular_unseen
from ratingloom.operators.ratings import TrainingData, labeled_ratings, require_ratings, user_likes
from ratingloom.operators.requests import Requests, asked_rows, requests_of
from ratingloom.params import ALSParams, NeighbourParams, PopularityParams
from ratingloom.session import write_shared

# Weight of each recommender in the blended score.
NAIVE_BAYES_WEIGHT = 2.0
FOREST_WEIGHT = 1.0
POPULARITY_WEIGHT = 1.0


class Model(Protocol):
    def recommend(self, queries: DataFrame | Requests) -> DataFrame: ...

    def save(self, path: str) -> None: ...

    def summary(self) -> DataFrame: ...


class Recommender(Protocol):
    def fit(self, ratings: DataFrame | TrainingData) -> Model: ...


def _training_data(ratings: DataFrame | TrainingData) -> TrainingData:
    return ratings if isinstance(ratings, TrainingData) else TrainingData(ratings)


def _sizes(tables: dict[str, DataFrame], **settings: Any) -> DataFrame:
    """``(name, value)``: rows of each table, then the settings, as text."""
    rows = [t.agg(F.lit(k).alias("name"), F.count(F.lit(1)).cast("string").alias("value")) for k, t in tables.items()]
    spark = next(iter(tables.values())).sparkSession
    rows.append(spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "name string, value string"))
    return reduce(DataFrame.unionByName, rows)


def _store(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# -- popularity ------------------------------------------------------------


@dataclass(frozen=True)
class PopularityModel:
    top: DataFrame
    seen: DataFrame
    max_items: int
    compat: bool = False

    def recommend(self, queries: DataFrame | Requests) -> DataFrame:
        return popular_unseen(
            asked_rows(queries), self.top, self.seen, self.max_items, weight=POPULARITY_WEIGHT, compat=self.compat
        )

    def summary(self) -> DataFrame:
        return _sizes({"top": self.top, "seen": self.seen}, max_items=self.max_items)

    def save(self, path: str) -> None:
        _store(self.top, f"{path}/top")
        _store(self.seen, f"{path}/seen")
        settings = [(self.max_items, self.compat)]
        _store(self.top.sparkSession.createDataFrame(settings, "max_items int, compat boolean"), f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PopularityModel:
        settings = spark.read.parquet(f"{path}/settings").first()
        return cls(
            spark.read.parquet(f"{path}/top"),
            spark.read.parquet(f"{path}/seen"),
            settings["max_items"],
            settings["compat"],
        )


@dataclass(frozen=True)
class PopularityRecommender:
    params: PopularityParams = PopularityParams()
    compat: bool = False

    def fit(self, ratings: DataFrame | TrainingData) -> PopularityModel:
        data = _training_data(ratings)
        top = item_views_top(data.events, self.params.max_items, pruned=self.compat)
        seen = data.latest.select("user", "item")
        return PopularityModel(write_shared(top, "top"), seen, self.params.max_items, self.compat)


# -- similar users plus a classifier ---------------------------------------


@dataclass(frozen=True)
class Neighbourhood:
    """Shared by the classifier hybrids: neighbour, liked and seen lists, all computed and stored."""

    neighbours: DataFrame
    likes: DataFrame
    seen: DataFrame

    @classmethod
    def build(
        cls, ratings: DataFrame | TrainingData, params: NeighbourParams, compat: bool = False
    ) -> Neighbourhood:
        data = _training_data(ratings)
        return cls(
            write_shared(similar_users(data.latest, params, compat, latest_only=True), "neighbours"),
            write_shared(user_likes(data.rated(compat), params.top_n), "likes"),
            data.latest.select("user", "item"),
        )

    def candidates(self, queries: DataFrame | Requests) -> DataFrame:
        """Candidates of the queried users only."""
        users = asked_rows(queries).select("user").distinct()
        asked = self.neighbours.join(users, "user", "left_semi")
        return cf_candidates(asked, self.likes, self.seen)

    def save(self, path: str) -> None:
        _store(self.neighbours, f"{path}/neighbours")
        _store(self.likes, f"{path}/likes")
        _store(self.seen, f"{path}/seen")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Neighbourhood:
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("neighbours", "likes", "seen")))


@dataclass(frozen=True)
class ClassifierHybridModel:
    neighbourhood: Neighbourhood
    classifier: Any
    weight: float
    compat: bool = False

    def recommend(self, queries: DataFrame | Requests) -> DataFrame:
        queries = requests_of(queries)
        judged = classify(self.classifier, self.neighbourhood.candidates(queries))
        judged = judged.withColumn("liked", F.col("prediction") == 1.0).drop("prediction")
        return ranked_shares(judged, queries, "liked", self.weight, self.compat)

    def summary(self) -> DataFrame:
        lists = self.neighbourhood
        tables = {"neighbours": lists.neighbours, "likes": lists.likes, "seen": lists.seen}
        return _sizes(tables, classifier=type(self.classifier).__name__, weight=float(self.weight))

    def save(self, path: str) -> None:
        self.neighbourhood.save(path)
        self.classifier.write().overwrite().save(f"{path}/classifier")
        settings = [(float(self.weight), self.compat)]
        spark = self.neighbourhood.seen.sparkSession
        _store(spark.createDataFrame(settings, "weight double, compat boolean"), f"{path}/settings")

    @classmethod
    def _load(cls, spark: SparkSession, path: str, classifier_type: Any) -> ClassifierHybridModel:
        settings = spark.read.parquet(f"{path}/settings").first()
        classifier = classifier_type.load(f"{path}/classifier")
        return cls(Neighbourhood.load(spark, path), classifier, settings["weight"], settings["compat"])

    @classmethod
    def load_naive_bayes(cls, spark: SparkSession, path: str) -> ClassifierHybridModel:
        return cls._load(spark, path, NaiveBayesModel)

    @classmethod
    def load_forest(cls, spark: SparkSession, path: str) -> ClassifierHybridModel:
        return cls._load(spark, path, RandomForestClassificationModel)


@dataclass(frozen=True)
class ClassifierHybrid:
    params: NeighbourParams = NeighbourParams()
    compat: bool = False

    weight = 1.0

    def train(self, labeled: DataFrame) -> Any:
        raise NotImplementedError

    def fit(
        self, ratings: DataFrame | TrainingData, neighbourhood: Neighbourhood | None = None
    ) -> ClassifierHybridModel:
        data = _training_data(ratings)
        require_ratings(data.events)
        lists = neighbourhood or Neighbourhood.build(data, self.params, self.compat)
        classifier = self.train(labeled_ratings(data.rated(self.compat)))
        return ClassifierHybridModel(lists, classifier, self.weight, self.compat)


@dataclass(frozen=True)
class NaiveBayesHybrid(ClassifierHybrid):
    """Candidates of similar users that naive Bayes predicts as liked."""

    weight = NAIVE_BAYES_WEIGHT

    def train(self, labeled: DataFrame) -> NaiveBayesModel:
        return fit_naive_bayes(labeled)


@dataclass(frozen=True)
class ForestHybrid(ClassifierHybrid):
    """Candidates of similar users that a random forest predicts as liked."""

    weight = FOREST_WEIGHT
    seed: int = 3

    def train(self, labeled: DataFrame) -> RandomForestClassificationModel:
        return fit_forest(labeled, self.seed)


# -- matrix factorisation --------------------------------------------------


@dataclass(frozen=True)
class ALSRecommenderModel:
    fitted: Factorization
    normalize: bool = True

    def recommend(self, queries: DataFrame | Requests) -> DataFrame:
        return als_recommend(self.fitted, queries, self.normalize)

    def summary(self) -> DataFrame:
        model = self.fitted.model
        return _sizes({"users": model.userFactors, "items": model.itemFactors}, rank=model.rank)

    def save(self, path: str) -> None:
        self.fitted.model.write().overwrite().save(f"{path}/factors")
        _store(self.fitted.users, f"{path}/users")
        _store(self.fitted.items, f"{path}/items")
        settings = [(self.normalize,)]
        _store(self.fitted.users.sparkSession.createDataFrame(settings, "normalize boolean"), f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ALSRecommenderModel:
        fitted = Factorization(
            SparkALSModel.load(f"{path}/factors"),
            spark.read.parquet(f"{path}/users"),
            spark.read.parquet(f"{path}/items"),
        )
        return cls(fitted, spark.read.parquet(f"{path}/settings").first()["normalize"])


@dataclass(frozen=True)
class ALSRecommender:
    params: ALSParams = ALSParams()
    normalize: bool = True
    compat: bool = False

    def fit(self, ratings: DataFrame | TrainingData) -> ALSRecommenderModel:
        rated = _training_data(ratings).rated(self.compat)
        return ALSRecommenderModel(fit_als(rated, self.params), self.normalize)


@dataclass(frozen=True)
class _Entry:
    create: Callable[..., Recommender]
    load: Callable[[SparkSession, str], Model]
    uses_neighbourhood: bool = field(default=False)


# Names under which the JSON settings refer to recommenders.
RECOMMENDERS: dict[str, _Entry] = {
    "als": _Entry(ALSRecommender, ALSRecommenderModel.load),
    "prt": _Entry(ForestHybrid, ClassifierHybridModel.load_forest, uses_neighbourhood=True),
    "nb": _Entry(NaiveBayesHybrid, ClassifierHybridModel.load_naive_bayes, uses_neighbourhood=True),
    "mv": _Entry(PopularityRecommender, PopularityModel.load),
}
