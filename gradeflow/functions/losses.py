"""Training losses as aggregate Columns over prediction and target columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: added inside the root, so a perfect fit scores 1e-3
ROOT_EPSILON = 1e-6
DEFAULT_THRESHOLD = 0.5


def _mean_over_cells(cells: Sequence[Column]) -> Column:
    return F.avg(reduce(add, cells) / len(cells))


def _differences(predictions: Sequence[str], targets: Sequence[str]) -> list[Column]:
    if not predictions or len(predictions) != len(targets):
        raise ValueError("a loss needs as many prediction columns as target columns")
    return [
        F.col(p).cast("double") - F.col(t).cast("double")
        for p, t in zip(predictions, targets, strict=True)
    ]


def _mse(predictions, targets, threshold) -> list[Column]:
    return [_mean_over_cells([d * d for d in _differences(predictions, targets)])]


def _rmse(predictions, targets, threshold) -> list[Column]:
    return [F.sqrt(_mse(predictions, targets, threshold)[0] + F.lit(ROOT_EPSILON))]


def _mcrmse(predictions, targets, threshold) -> list[Column]:
    if len(targets) != 2:
        raise ValueError("mcrmse needs exactly two targets")
    parts = [_rmse([p], [t], threshold)[0] for p, t in zip(predictions, targets, strict=True)]
    return [reduce(add, parts) / len(parts), *parts]


def _smooth_l1(predictions, targets, beta) -> list[Column]:
    def cell(d: Column) -> Column:
        size = F.abs(d)
        return F.when(size < beta, d * d * (0.5 / beta)).otherwise(size - 0.5 * beta)

    return [_mean_over_cells([cell(d) for d in _differences(predictions, targets)])]


def _huber(predictions, targets, delta) -> list[Column]:
    def cell(d: Column) -> Column:
        size = F.abs(d)
        return F.when(size <= delta, d * d * 0.5).otherwise((size - 0.5 * delta) * delta)

    return [_mean_over_cells([cell(d) for d in _differences(predictions, targets)])]


def tied_margin(first: Column, second: Column, label: Column, margin: float) -> Column:
    """Ranking loss of one pair; ties are pulled together, others pushed apart by a margin."""
    gap = first - second
    hinge = F.greatest(F.lit(float(margin)) - label * gap, F.lit(0.0))
    return F.when(label == 0, F.abs(gap)).otherwise(hinge)


@dataclass(frozen=True)
class Loss:
    """A named loss: ``columns(predictions, targets)`` gives its metrics by name.

    For ``ranking`` use ``pair_columns(first, second, labels)`` on paired rows.
    """

    name: str
    metrics: tuple[str, ...]
    threshold: float
    build: Callable[..., list[Column]] | None

    def columns(self, predictions: Sequence[str], targets: Sequence[str]) -> dict[str, Column]:
        if self.build is None:
            raise ValueError(f"{self.name} compares pairs; use pair_columns")
        built = self.build(predictions, targets, self.threshold)
        return dict(zip(self.metrics, built, strict=True))

    def pair_columns(
        self, first: Sequence[str], second: Sequence[str], labels: Sequence[str]
    ) -> dict[str, Column]:
        if self.build is not None:
            raise ValueError(f"{self.name} is not a pair loss; use columns")
        cells = [
            tied_margin(F.col(a), F.col(b), F.col(t), self.threshold)
            for a, b, t in zip(first, second, labels, strict=True)
        ]
        return {self.metrics[0]: _mean_over_cells(cells)}


# Loss names and the metric names they report.
_REGISTRY: dict[str, tuple[tuple[str, ...], Callable[..., list[Column]] | None]] = {
    "mse": (("MSE",), _mse),
    "rmse": (("RMSE",), _rmse),
    "mcrmse": (("MCRMSE", "C", "W"), _mcrmse),
    "ranking": (("Ranking",), None),
    "smoothl1": (("SmoothL1",), _smooth_l1),
    "huber": (("Huber",), _huber),
}


def get_loss(name: str, threshold: float = DEFAULT_THRESHOLD) -> Loss:
    """Loss by name; the threshold (beta, delta or margin) is always honoured."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown loss {name!r}; choose one of {sorted(_REGISTRY)}")
    metrics, build = _REGISTRY[name]
    return Loss(name, metrics, threshold, build)
