"""Driver-side parameter checks (VAL4): raised before any plan is built."""

from __future__ import annotations

from collections.abc import Iterable


def positive_int(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return value


def non_negative_int(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be an integer >= 0, got {value!r}")
    return value


def non_negative_number(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not value >= 0:
        raise ValueError(f"{name} must be a number >= 0, got {value!r}")
    return float(value)


def number_between(value, low: float, high: float, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise ValueError(f"{name} must be a number in [{low}, {high}], got {value!r}")
    return float(value)


def non_blank(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-blank string, got {value!r}")
    return value.strip()


def window_sizes(windows: Iterable[int]) -> list[int]:
    """Distinct window sizes in ascending order."""
    return sorted({positive_int(w, "window") for w in windows})
