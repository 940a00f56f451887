"""Rewards by functions of the user's: row by row or a whole batch of columns at once."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

REWARD = "overall double, format double, accuracy double"


def load_function(spec: str, **bound) -> Callable:
    """``file.py:function`` with arguments bound; the function must be there."""
    path, _, name = spec.partition(":")
    module = importlib.util.module_from_spec(loaded := importlib.util.spec_from_file_location("reward_function", path))
    loaded.loader.exec_module(module)
    if not hasattr(module, name):
        raise ValueError(f"{path} has no function {name}")
    return partial(getattr(module, name), **bound)


def _filled(rewards: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({k: [r.get(k) for r in rewards] for k in ("overall", "format", "accuracy")}, dtype="float64")


def row_rewards(rows: DataFrame, function: Callable[..., dict], arguments: list[str], key: str) -> DataFrame:
    """key and reward; the function gets those of the arguments that it names and the rows have."""
    taken = [a for a in arguments if a in inspect.signature(function).parameters and a in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = _filled([function(**{a: getattr(r, a) for a in taken}) for r in part.itertuples(index=False)])
            yield pd.concat([part[[key]].reset_index(drop=True), out], axis=1)

    return rows.select(key, *[a for a in taken if a != key]).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {REWARD}")


def batch_rewards(rows: DataFrame, function: Callable[..., list[dict]], arguments: list[str], key: str, batch: str | None = None) -> DataFrame:
    """key and reward; the function gets lists and gives a list. With ``batch`` it sees all rows of a batch together."""
    schema = f"{key} {dict(rows.dtypes)[key]}, {REWARD}"

    def of(part: pd.DataFrame) -> pd.DataFrame:
        found = function(**{a: part[a].tolist() for a in arguments})
        if len(found) != len(part):
            raise ValueError(f"{len(found)} rewards for {len(part)} rows")
        return pd.concat([part[[key]].reset_index(drop=True), _filled(found)], axis=1)

    chosen = rows.select(*dict.fromkeys([key, *arguments, *([batch] if batch else [])]))
    if batch:
        return chosen.groupBy(batch).applyInPandas(lambda part: of(part.sort_values(key, kind="stable").reset_index(drop=True)), schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(of, batches)

    return chosen.mapInPandas(run, schema)
