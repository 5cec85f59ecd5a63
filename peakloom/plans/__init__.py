"""Consensus strategies by name."""

from __future__ import annotations

from .average import AverageSpectrumStrategy
from .best import BestSpectrumStrategy
from .binning import BinningStrategy
from .common import Strategy
from .most_similar import MostSimilarStrategy

STRATEGIES: dict[str, type[Strategy]] = {"best": BestSpectrumStrategy, "most": MostSimilarStrategy, "bin": BinningStrategy, "average": AverageSpectrumStrategy}


def strategy(name: str, **options) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known are {', '.join(STRATEGIES)}")
    return STRATEGIES[name](**options)
