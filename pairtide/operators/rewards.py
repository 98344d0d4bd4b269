"""Rewards of lookback decisions: one projection of formulas over a decision table, weighted by a template."""

import json
import os

from dataclasses import dataclass, field
from typing import Any, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairtide.operators.lookback import LookbackSpec

# Weights and parameters of the default template and of the legacy reward.
DEFAULT_WEIGHTS = {"S": 1.0, "C": 0.3, "E": -0.1, "Sharpe": 0.2, "LookbackPenalty": -0.2}
DEFAULT_PARAMS = {
    "edge": {"edge_boundary": 1.0, "penalty_same": 0.2, "jump_threshold": 10, "delta_weight": 0.0},
    "sharpe": {"min_vol": 1.0e-6},
    "lookback": {"target": None, "width": 0.5},
}
LEGACY_WEIGHTS = {"alpha": 1.0, "beta": 0.3, "gamma": 0.05}
LEGACY_PENALTY_SAME = 0.05
LEGACY_PENALTY_STEP = 10


#: The formulas, over a decision's own columns and the facts ``_on_edge``, ``_step`` and ``_off_target``.
FORMULAS = {
    "S": "(mean_abs + row_range) / 2",
    "C": "(stability_matrix + stability_rows) / 2",
    "E": "_on_edge * {edge} + CASE WHEN _step = 0 THEN {same} WHEN _step > {jump} THEN _step / {jump} ELSE 0D END + abs(delta_mean) * {swing}",
    "Sharpe": "returns_mean / greatest(abs(returns_vol), {least_vol})",
    "LookbackPenalty": "_off_target / {width}",
}
LEGACY_FORMULAS = {**FORMULAS, "Sharpe": "0D", "LookbackPenalty": "abs(delta_mean)"}


@dataclass(frozen=True)
class RewardParams:
    """Numbers in the formulas. ``target`` None is the middle of the lookback range."""

    edge: float = 1.0
    same: float = 0.0
    jump: float = 10.0
    swing: float = 0.0
    least_vol: float = 1.0e-6
    width: float = 0.5
    target: float | None = None

    #: Where a template's file keeps each number.
    PLACES = {
        "edge": ("edge", "edge_boundary"), "same": ("edge", "penalty_same"), "jump": ("edge", "jump_threshold"), "swing": ("edge", "delta_weight"),
        "least_vol": ("sharpe", "min_vol"), "width": ("lookback", "width"), "target": ("lookback", "target"),
    }

    @classmethod
    def of(cls, params: Mapping[str, Any]) -> "RewardParams":
        given = {name: (params.get(part) or {}).get(key) for name, (part, key) in cls.PLACES.items()}
        read = {name: float(value) for name, value in given.items() if value is not None}
        # a jump counts whole steps
        return cls(**{**read, "jump": float(max(1, int(read.get("jump", cls.jump)))), "width": max(read.get("width", cls.width), 1e-6)})


@dataclass(frozen=True)
class RewardTemplate:
    """Component weights and parameters; a component without weight does not count."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    params: Mapping[str, Any] = field(default_factory=lambda: dict(DEFAULT_PARAMS))
    name: str = "default"

    @classmethod
    def from_dict(cls, data: Mapping[str, Any], name: str = "inline") -> "RewardTemplate":
        components, params = data.get("components", {}), data.get("params") or {}
        if not isinstance(components, Mapping) or not isinstance(params, Mapping):
            raise ValueError("a reward template needs mappings for 'components' and 'params'")
        return cls({k: float(v) for k, v in components.items()}, dict(params), data.get("name", name))

    @classmethod
    def load(cls, source: "str | Mapping[str, Any] | None", folder: str | None = None) -> "RewardTemplate":
        """From a mapping, a JSON file (a YAML one where a reader is installed), a file's name in ``folder``, or the default for None."""
        if source is None or source == "default":
            return cls()
        if isinstance(source, Mapping):
            return cls.from_dict(source)
        tries = [source, *[os.path.join(folder or "", source + end) for end in (".json", ".yaml", ".yml")]]
        path = next((t for t in tries if os.path.isfile(t)), None)
        if path is None:
            raise FileNotFoundError(f"no reward template {source!r}")
        with open(path) as file:
            if path.endswith(".json"):
                data = json.load(file)
            else:
                import yaml

                data = yaml.safe_load(file)
        return cls.from_dict(data or {}, os.path.splitext(os.path.basename(path))[0])


def _scored(states: DataFrame, range_: LookbackSpec, numbers: RewardParams, formulas: Mapping[str, str], weights: Mapping[str, float]) -> DataFrame:
    """``states`` with a column for each formula and ``reward``, their weighted sum."""
    low, high = range_.min_lookback, range_.max_lookback
    target = (low + high) / 2 if numbers.target is None else numbers.target
    put = {k: f"{getattr(numbers, k)!r}D" for k in numbers.PLACES if k != "target"}
    facts = {
        "_on_edge": f"IF(lookback IN ({low}, {high}), 1D, 0D)",
        "_step": "CAST(abs(lookback - prev_lookback) AS DOUBLE)",
        "_off_target": f"abs(lookback - {target!r}D) / {float(high - low)!r}D",
    }
    parts = states.withColumns({k: F.expr(v) for k, v in facts.items()}).withColumns({k: F.expr(v.format(**put)) for k, v in formulas.items()})
    total = " + ".join(f"{k} * ({float(weights.get(k, 0.0))!r}D)" for k in formulas)
    return parts.withColumn("reward", F.expr(total)).drop(*facts)


def with_reward(states: DataFrame, range_: LookbackSpec, template: RewardTemplate) -> DataFrame:
    """Add every component and the weighted ``reward``."""
    return _scored(states, range_, RewardParams.of(template.params), FORMULAS, template.weights)


def with_legacy_reward(
    states: DataFrame,
    range_: LookbackSpec,
    weights: Mapping[str, float] = LEGACY_WEIGHTS,
    penalty_same: float = LEGACY_PENALTY_SAME,
    penalty_step: int = LEGACY_PENALTY_STEP,
) -> DataFrame:
    """The older reward: strength plus consistency minus edge penalty; the rest is reported only."""
    numbers = RewardParams(same=penalty_same, jump=float(penalty_step))
    return _scored(states, range_, numbers, LEGACY_FORMULAS, {"S": weights["alpha"], "C": weights["beta"], "E": -weights["gamma"]})
