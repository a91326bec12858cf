"""The operators that a chain can name: stock ones and those a user registers.

An operator says where it may stand, which parameters the search may move, and how it is built from their values:

- `WIDE`, `VECTOR`: build(values, chain) gives a `prep.base.Prep`, for tables of columns or of one vector;
- `SELECTION`: build(rows, values, chain) gives a `select.Selected` from assembled training rows;
- `TRAINER`: build(values, chain) gives a `pyspark.ml` classifier;
- `METRIC`: build(scores, keys, weight) gives (keys..., value) from stacked scores; none for those `validate.measures` knows;
- `STEP`: handled by the chain itself (split, weights, assembling).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from tunekit.operators import space

STEP, WIDE, VECTOR, SELECTION, TRAINER, METRIC = "step", "wide", "vector", "selection", "trainer", "metric"
PLACES = (STEP, WIDE, VECTOR, SELECTION, TRAINER, METRIC)


@dataclass(frozen=True)
class Operator:
    """`params(n_features, n_rows)` gives the parameters with their bounds; None stands for the stock ones of that name."""

    name: str
    place: str
    build: Callable | None = None
    params: Callable[[int, float], Sequence[space.Param]] | None = None


_OPERATORS: dict[str, Operator] = {}


def register(operator: Operator) -> Operator:
    """Make an operator known to chains by its name; a name can be given once."""
    if operator.place not in PLACES:
        raise ValueError(f"unknown place {operator.place!r}")
    if operator.name in _OPERATORS:
        raise ValueError(f"operator {operator.name!r} is registered already")
    if operator.build is None and operator.place not in (STEP, METRIC):
        raise ValueError(f"operator {operator.name!r} needs a build function")
    _OPERATORS[operator.name] = operator
    if operator.params is not None:
        space.OWN_PARAMS[operator.name] = operator.params
    return operator


def unregister(name: str) -> None:
    """Forget an operator; chains that name it can no longer be made."""
    _OPERATORS.pop(name, None)
    space.OWN_PARAMS.pop(name, None)


def known(name: str) -> bool:
    return name in _OPERATORS


def lookup(name: str) -> Operator:
    if name not in _OPERATORS:
        raise ValueError(f"unknown operator {name!r}")
    return _OPERATORS[name]


def place_of(name: str) -> str:
    return lookup(name).place
