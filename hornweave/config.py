"""Settings: defaults, then a flat ``key: value`` file, then environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Names of score aggregations and their ids.
AGGREGATIONS = {"maxplus": 1, "max2": 2, "noisyor": 3, "maxgroup": 4}


@dataclass(frozen=True)
class Config:
    dataset: str = ""
    path_training: str = "data/{DATASET}/train.txt"
    path_valid: str = "data/{DATASET}/valid.txt"
    path_test: str = "data/{DATASET}/test.txt"
    min_supp: int = 10
    min_entity_supp: int = 1
    max_path_length: int = 3
    threshold_confidence: float = 0.0001
    threshold_correct_predictions: int = 2
    threshold_correct_predictions_zero: int = 100
    read_threshold_confidence: float = 0.0001
    read_threshold_correct_predictions: int = 2
    read_threshold_max_rule_length: int = 10
    unseen_negative_examples: int = 5
    rule_zero_weight: float = 0.01
    rule_ac2_weight: float = 0.1
    rule_length_degrade: float = 1.0
    top_k_output: int = 100
    discrimination_bound: int = 10_000
    branchingfactor_bound: int = 1_000
    aggregation_type: str = "maxplus"

    @property
    def aggregation_id(self) -> int:
        return AGGREGATIONS[self.aggregation_type]


def load(text: str = "", environment: Mapping[str, str] | None = None) -> Config:
    """Reads settings; ``{DATASET}`` in a value is replaced by the data set's name. Unknown keys are ignored."""
    given = {}
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        if colon and value.strip():
            given[key.strip().lower()] = value.strip().strip("'\"")
    for key, value in (os.environ if environment is None else environment).items():
        given[key.lower()] = value
    kinds = {f.name: type(f.default) for f in fields(Config)}
    values = {k: (float if kinds[k] is float else int if kinds[k] is int else str)(v) for k, v in given.items() if k in kinds}
    config = replace(Config(), **values)
    filled = {k: getattr(config, k).replace("{DATASET}", config.dataset) for k, kind in kinds.items() if kind is str}
    return replace(config, **filled)


def expand_runs(pattern: str) -> list[str]:
    """``path|a,b|rest`` names one path for each value between the bars."""
    head, bar, tail = pattern.partition("|")
    values, bar2, rest = tail.partition("|")
    return [head + v.strip() + rest for v in values.split(",")] if bar and bar2 else [pattern]
