"""One ordered pass over the rows of each key, where each row's result needs the one before it.

Rows are shuffled by key and sorted within their partitions by Spark; a task then reads them as they come and carries
one state. So a key's rows are never together in memory, however many it has; what they cost is one task's time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame

from threadloom.runtime import share_code

S = TypeVar("S")


def _runs(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Neighbouring rows of one key; nulls are equal."""
    if frame.empty:
        return
    new = pd.Series(False, index=frame.index)
    for k in keys:
        before = frame[k].shift()
        new |= (frame[k] != before) & ~(frame[k].isna() & before.isna())
    at = [0, *[int(i) for i in new.to_numpy().nonzero()[0] if i], len(frame)]
    for a, b in zip(at, at[1:], strict=False):
        yield tuple(None if pd.isna(frame[k].iat[a]) else frame[k].iat[a] for k in keys), frame.iloc[a:b]


def ordered(rows: DataFrame, keys: list[str], order: list, schema: str, begin: Callable[[tuple], S], step: Callable[[S, pd.DataFrame], tuple[S, pd.DataFrame | None]], end: Callable[[S], pd.DataFrame | None] | None = None) -> DataFrame:
    """Rows that ``step`` gives for each run of a key's rows, with the state after it, and ``end`` for its last state."""
    share_code(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            for own, part in _runs(frame, keys):
                if key is None or own != key:
                    if key is not None and end and (last := end(state)) is not None:
                        yield last
                    key, state = own, begin(own)
                state, out = step(state, part)
                if out is not None:
                    yield out
        if key is not None and end and (last := end(state)) is not None:
            yield last

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
