"""Other engines' results as tables: annual ratios of a company, and the inputs of its valuation.

An engine is a Python function named as "package.module:function" that is imported where it runs, on the
executors, or a function itself. One row of entities is one call; entities fan out over tasks. An engine that isn't
installed raises with a hint before any task starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import DataFrame

from tailframe.plans.shipping import ship

RATIOS = "entity string, fiscal_year int, interest_coverage double, debt_to_equity double, current_ratio double, cfo_to_net_income double, fcf_margin double, ebitda_margin double"
VALUATION = "entity string, fcff array<double>, net_debt double, shares double, share_price double, wacc double, terminal_growth double, market_implied_wacc double"


def found(engine: str | Callable, hint: str) -> str | Callable:
    """The engine, once it is certain that it can be imported here."""
    if callable(engine):
        return engine
    module, _, function = engine.partition(":")
    try:
        there = find_spec(module) is not None
    except ModuleNotFoundError:
        there = False
    if not there or not function:
        raise ImportError(f"{engine!r} isn't installed: {hint}")
    return engine


def _load(engine: str | Callable) -> Callable:
    if callable(engine):
        return engine
    module, _, function = engine.partition(":")
    return getattr(import_module(module), function)


def _called(entities: DataFrame, engine: str | Callable, schema: str, hint: str) -> DataFrame:
    ship(entities.sparkSession)
    engine = found(engine, hint)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _load(engine)
        for batch in batches:
            for entity in batch["entity"]:
                made = [{**row, "entity": entity} for row in call(entity)]
                yield pd.DataFrame(made, columns=names).astype({n: "float64" for n in names if schema.count(f"{n} double")})

    return entities.select("entity").distinct().repartition("entity").mapInPandas(run, schema)


def ratios(entities: DataFrame, engine: str | Callable, hint: str = "install the package that reads annual reports") -> DataFrame:
    """Annual ratios, ready for scorecard.fundamental(): engine(entity) gives a dict a fiscal year; what it
    leaves out is NULL."""
    return _called(entities, engine, RATIOS, hint)


def valuation_inputs(entities: DataFrame, engine: str | Callable, hint: str = "install the package that values companies") -> DataFrame:
    """Inputs of a discounted cash flow, ready for valuation.assess(): engine(entity) gives one dict, in a list."""
    return _called(entities, engine, VALUATION, hint)
