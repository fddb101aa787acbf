"""All registered queries and their SQL."""

from __future__ import annotations

from . import gaps, modelling, profiling, ranking, risk, texts  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
