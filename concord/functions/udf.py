"""User code over frames, in Arrow batches: a map, and an aggregate of own making in two phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python objects, missing ones None, which Spark takes whatever pandas keeps them in."""
    texts = [c for c in frame.columns if frame[c].dtype == object or isinstance(frame[c].dtype, pd.StringDtype)]
    return frame.assign(**{c: pd.Series([None if v is None or v != v else v for v in frame[c].tolist()], index=frame.index, dtype=object) for c in texts})


def batch_map(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of each batch of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield plain(f(frame))

    return df.mapInPandas(run, schema)


def custom_aggregate(df: DataFrame, keys: list[str], partial: Callable[[pd.DataFrame], dict], merge: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """An aggregate by keys: ``partial`` gives the state (column: value) of some rows of one group, ``merge`` that of two states.

    Each task merges its own states first, so a group sends one row a task. schema: of keys and states.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for frame in frames:
            for k, part in frame.groupby(keys, dropna=False, sort=False):
                k, s = tuple(None if v != v else v for v in k), partial(part)
                states[k] = merge(states[k], s) if k in states else s
        yield plain(pd.DataFrame([dict(zip(keys, k, strict=True)) | s for k, s in states.items()], columns=names))

    def last(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.drop(columns=keys).to_dict("records")
        state = rows[0]
        for r in rows[1:]:
            state = merge(state, r)
        return plain(pd.DataFrame([{k: group[k].iloc[0] for k in keys} | state], columns=names))

    return df.mapInPandas(first, schema).groupBy(*keys).applyInPandas(last, schema)
