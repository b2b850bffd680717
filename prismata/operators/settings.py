"""Driver-side choices: which setting holds, which fallback applies, whether cached results are still good."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS = {"tau_multi": 0.35, "temperature": 0.07, "shortlist_topN": 0}


def first_given(*values, default=None):
    """The first value that isn't None; the first element of a list."""
    for v in values:
        if isinstance(v, (list, tuple)):
            v = v[0] if v else None
        if v is not None:
            return v
    return default


def scoring_settings(arguments: dict, calibration: dict | None, config: dict, use_calibration: bool = True) -> dict:
    """Arguments, then calibration (if used; it has no say on the shortlist), then config, then defaults."""
    tuned = {k: v for k, v in (calibration or {}).items() if k != "shortlist_topN"} if use_calibration else {}
    return {k: first_given(arguments.get(k), tuned.get(k), config.get(k), default=d) for k, d in DEFAULTS.items()}


def similarity_cutoff(value) -> float:
    """A share; values over 1 are percentages."""
    x = float(value)
    return x / 100 if x > 1 else x


def may_repeat(enabled: bool, phase: str, scope: str) -> bool:
    """Whether classes that are too small may be drawn with repeats."""
    return enabled and (scope == "all" or (phase == "train" and scope == "train_only"))


def same_splits(stored: dict, wanted: dict, keys: tuple[str, ...] = ("threshold", "folds", "definition", "seed")) -> bool:
    """Whether stored splits can be used again."""
    return all(k in stored and stored[k] == wanted.get(k) for k in keys)


def unwrapped(metrics: dict, depth: int = 10) -> dict:
    """The innermost of nested `metrics`."""
    while depth and isinstance(metrics.get("metrics"), dict):
        metrics, depth = metrics["metrics"], depth - 1
    return metrics


def chosen_k(asked: int | None, configured: list[int], available: list[int]) -> int | None:
    """The K to report: the one asked for, else the last configured, else the smallest there is."""
    for k in (asked, configured[-1] if configured else None):
        if k is not None and k in available:
            return k
    return min(available, default=None)


def numeric_keys(document: Column) -> Column:
    """The keys of a JSON object (text) that are whole numbers, as an array in order."""
    keys = F.map_keys(F.from_json(document, "map<string,string>"))
    return F.array_sort(F.transform(F.filter(keys, lambda k: k.rlike("^[0-9]+$")), lambda k: k.cast("int")))
