"""Settings of the recommenders, and their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class NeighbourParams:
    """Similar-user search.

    ``raters_per_slot`` bounds the raters of one item that meet in one join
    group (items with more are split over several groups, none is dropped).
    """

    min_common: int = 5
    top_n: int = 150
    raters_per_slot: int = 2048


@dataclass(frozen=True)
class ALSParams:
    rank: int = 10
    num_iterations: int = 20
    reg: float = 0.01
    seed: int = 3
    #: Blocks of factors on either side; None follows the cluster and the number of ratings.
    user_blocks: int | None = None
    item_blocks: int | None = None


@dataclass(frozen=True)
class PopularityParams:
    max_items: int = 300


@dataclass(frozen=True)
class EvalParams:
    k_fold: int = 10
    query_num: int = 10


@dataclass(frozen=True)
class AlgorithmSpec:
    name: str
    params: Any


@dataclass(frozen=True)
class EngineParams:
    """Data source settings plus the ordered list of recommenders."""

    app_name: str = "default"
    eval_params: EvalParams | None = None
    algorithms: tuple[AlgorithmSpec, ...] = field(default_factory=tuple)


def _neighbour(raw: dict) -> NeighbourParams:
    return NeighbourParams(int(raw["pearsonThreasholds"]), int(raw["topNLikes"]))


def _als(raw: dict) -> ALSParams:
    default = ALSParams()
    return ALSParams(
        int(raw["rank"]),
        int(raw["numIterations"]),
        float(raw["lambda"]),
        int(raw.get("seed", default.seed)),
        *(int(raw[k]) if int(raw.get(k, -1)) > 0 else None for k in ("numUserBlocks", "numItemBlocks")),
    )


def _popularity(raw: dict) -> PopularityParams:
    return PopularityParams(int(raw["maxItems"]))


# Algorithm names and parameter spellings of the JSON format.
_JSON_READERS = {"nb": _neighbour, "prt": _neighbour, "als": _als, "mv": _popularity}


def engine_params_from_json(text: str) -> EngineParams:
    """Read the engine JSON: ``datasource.params`` and the ``algorithms`` list."""
    raw = json.loads(text)
    source = raw.get("datasource", {}).get("params", {})
    evaluation = source.get("evalParams")
    specs = []
    for entry in raw.get("algorithms", []):
        if entry["name"] not in _JSON_READERS:
            raise ValueError(f"unknown algorithm {entry['name']!r}; known: {sorted(_JSON_READERS)}")
        specs.append(AlgorithmSpec(entry["name"], _JSON_READERS[entry["name"]](entry.get("params", {}))))
    return EngineParams(
        app_name=source.get("appName", EngineParams.app_name),
        eval_params=EvalParams(evaluation["kFold"], evaluation["queryNum"]) if evaluation else None,
        algorithms=tuple(specs),
    )
