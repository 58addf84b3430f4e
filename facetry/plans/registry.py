"""The registry of measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from inspect import signature

GROUPS = ("general", "statistical", "info-theory", "model-based", "landmarking", "clustering", "complexity", "itemset", "concept", "relative")
DEFAULT_GROUPS = ("general", "statistical", "info-theory", "model-based", "landmarking")
#: Groups that others are made from.
NEEDS = {"relative": ("landmarking",)}


class TooLarge(Exception):
    """A dataset is beyond a documented bound of a measure. Extraction never turns this into
    a missing value: ask for another measure, a subsample, or another kind of it."""


class NotConverged(Exception):
    """An iteration ended without its result; extraction lets this through as well."""


@dataclass(frozen=True)
class Measure:
    """A measure: ``function(data, **hyper)`` gives a number, ``(key, value)`` rows, or a
    DataFrame ``key, value``."""

    group: str
    name: str
    function: Callable
    scalar: bool
    supervised: bool
    hyper: tuple[str, ...] = field(default=())

    @property
    def about(self) -> str:
        return (self.function.__doc__ or "").strip()


MEASURES: dict[tuple[str, str], Measure] = {}


def measure(group: str, name: str | None = None, scalar: bool = False, supervised: bool = False) -> Callable:
    """Register a function as a measure; its docstring is the description."""

    def add(f: Callable) -> Callable:
        called = name or f.__name__
        MEASURES[group, called] = Measure(group, called, f, scalar, supervised, tuple(list(signature(f).parameters)[1:]))
        return f

    return add
