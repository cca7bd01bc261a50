"""Distance metrics, which index takes which, and the values that stand for a missing result."""

from __future__ import annotations

from enum import IntEnum

MAX_FLOAT32 = 3.4028234663852886e38
NO_ID = -1  # the 64 bits of the greatest unsigned integer


class Metric(IntEnum):
    SUM_OF_SQUARES = 0
    INNER_PRODUCT = 1
    COSINE = 2
    L2 = 3

    @property
    def descending(self) -> bool:
        """Whether a greater value is a nearer neighbour."""
        return self is Metric.INNER_PRODUCT


SUPPORTED = {
    "FLAT": frozenset(Metric),
    "IVF_FLAT": frozenset({Metric.SUM_OF_SQUARES, Metric.L2, Metric.COSINE}),
    "VAMANA": frozenset({Metric.SUM_OF_SQUARES, Metric.L2, Metric.COSINE}),
    "IVF_PQ": frozenset({Metric.SUM_OF_SQUARES, Metric.L2}),
}


def as_metric(metric: Metric | int | str) -> Metric:
    return Metric[metric.upper()] if isinstance(metric, str) else Metric(metric)


def check_metric(index_type: str, metric: Metric | int | str) -> Metric:
    """The metric, or ValueError if the index type is unknown or doesn't take it."""
    m = as_metric(metric)
    if index_type not in SUPPORTED:
        raise ValueError(f"unknown index type {index_type!r}; known: {', '.join(SUPPORTED)}")
    if m not in SUPPORTED[index_type]:
        raise ValueError(f"{index_type} does not support {m.name}; it supports {', '.join(x.name for x in sorted(SUPPORTED[index_type]))}")
    return m
