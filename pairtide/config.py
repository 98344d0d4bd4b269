"""Driver-side settings of the pair analysis, validated once before planning."""

from dataclasses import dataclass, replace
from typing import Any, Mapping, Optional

# Accepted names and the defaults users of this analysis expect.
METHODS = ("ccf_at_lag", "ccf_auc", "ccf_at_max_lag", "signature")
CORRELATIONS = ("pearson", "squared_pearson", "spearman", "kendall", "distance", "mutual_information")
SCALINGS = ("mean-centering", "by_std", "std")
SIGNATURE_FORMS = ("custom", "levy")
DEFAULT_LOOKBACK = 252
DEFAULT_LAG = 1
DEFAULT_MAX_LAG = 10
DEFAULT_QUANTILES = 4


@dataclass(frozen=True)
class PairSpec:
    """What is measured for every pair of a window, and on which windows."""

    method: str = "ccf_at_lag"
    correlation: str = "pearson"
    lag: int = DEFAULT_LAG
    max_lag: int = DEFAULT_MAX_LAG
    quantiles: int = DEFAULT_QUANTILES
    scaling: str = "mean-centering"
    signature_form: str = "custom"
    lookback: int = DEFAULT_LOOKBACK
    update_freq: int = 1

    def __post_init__(self):
        if self.method == "dtw":
            raise ValueError("dtw is not supported; use signature or a ccf method")
        _check("method", self.method, METHODS)
        _check("correlation", self.correlation, CORRELATIONS)
        _check("signature_form", self.signature_form, SIGNATURE_FORMS)
        if self.lookback < 2:
            raise ValueError("lookback must be at least 2 rows")
        if self.update_freq < 1:
            raise ValueError("update_freq must be at least 1")
        if self.method in ("ccf_auc", "ccf_at_max_lag") and self.max_lag < 1:
            raise ValueError("max_lag must be at least 1")
        if self.quantiles < 2:
            raise ValueError("quantiles must be at least 2")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "PairSpec":
        """Read the nested form: common keys plus one block named like the method."""
        method = data.get("method", "ccf_at_lag")
        block = data.get(method) or {}
        return cls(
            method=method,
            correlation=block.get("correlation_method", "pearson"),
            lag=int(block.get("lag", DEFAULT_LAG)),
            max_lag=int(block.get("max_lag", DEFAULT_MAX_LAG)),
            quantiles=int(block.get("quantiles", DEFAULT_QUANTILES)),
            scaling=data.get("Scaling_Method", "mean-centering"),
            signature_form=block.get("sig_method", "custom"),
            lookback=int(data.get("lookback", DEFAULT_LOOKBACK)),
            update_freq=int(data.get("update_freq", 1)),
        )

    def with_lookback(self, lookback: int) -> "PairSpec":
        return replace(self, lookback=lookback)


@dataclass(frozen=True)
class RoleSpec:
    """How leaders and followers are cut from the net scores of a window."""

    top_percentile: float = 50.0
    bottom_percentile: float = 50.0
    agg_func: str = "sum"

    def __post_init__(self):
        for name in ("top_percentile", "bottom_percentile"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be between 0 and 100")
        if self.agg_func not in ("sum", "mean"):
            raise ValueError("agg_func must be 'sum' or 'mean'")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "RoleSpec":
        if data.get("method", "percentile") != "percentile":
            raise ValueError(f"unknown role method: {data['method']}")
        return cls(
            top_percentile=float(data.get("top_percentile", 50.0)),
            bottom_percentile=float(data.get("bottom_percentile", 50.0)),
            agg_func=data.get("agg_func", "sum"),
        )


def _check(name: str, value: Optional[str], allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {name} {value!r}; expected one of {', '.join(allowed)}")
