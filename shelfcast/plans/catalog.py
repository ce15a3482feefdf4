"""Named queries: how to build each from the layers, and the schema of its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfcast.operators.forecast import STATISTICAL
from shelfcast.plans.layers import Layers
from shelfcast.plans.present import present


@dataclass(frozen=True)
class Query:
    schema: str
    build: Callable[[Layers], DataFrame]

    def run(self, layers: Layers) -> DataFrame:
        return present(self.build(layers), self.schema)


CATALOG: dict[str, Query] = {}
# Names registered twice.
CONTESTS: list[str] = []
# A third registration, `<name>_challenger`: only models with a long backtest may win there, never the
# baseline, so that what compares or calibrates the champion has an effect that SQL repeats.
CHALLENGERS = ("IMAPA", "AutoETS")
CHALLENGED = ("ev_champion", "ev_per_series", "ev_confidence", "ev_dm_stat", "ev_significance", "ev_run_summary",
              "pol_ratio_quantiles", "pol_horizon_quantiles", "pol_order_plan", "pol_backtest_single", "mon_drift")


def query(schema: str) -> Callable:
    """Register the decorated builder under its own name."""

    def register(build: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
        CATALOG[build.__name__] = Query(schema, build)
        return build

    return register


def contest(schema: str) -> Callable:
    """Register a builder whose result depends on the champion, or lists models, twice.

    Under its own name all models compete. Under `<name>_statistical` only those do that work
    series by series; SQL can repeat these, so that name carries the oracle of the shared code.
    """

    def register(build: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
        CATALOG[build.__name__] = Query(schema, build)
        CATALOG[f"{build.__name__}_statistical"] = Query(schema, lambda t: build(t.among(STATISTICAL)))
        CONTESTS.append(build.__name__)
        if build.__name__ in CHALLENGED:
            CATALOG[f"{build.__name__}_challenger"] = Query(schema, lambda t: build(t.among(STATISTICAL, CHALLENGERS)))
        return build

    return register
