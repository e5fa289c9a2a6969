"""Grouped work on many whole groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows gathered before a function is called, beyond the group that is not yet complete.
ROWS = 200_000


def whole_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on frames of whole groups of ``keys``, each frame sorted by keys and ``order``.

    One shuffle by the keys, as for applyInPandas, but ``f`` sees thousands of small groups in one call.
    """

    def last_start(t: pd.DataFrame) -> int:
        k = t[keys].to_numpy(dtype=object)
        same = np.all(k == k[-1], axis=1)
        return int(len(k) - np.argmin(same[::-1])) if not same.all() else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= ROWS:
                t = pd.concat(held, ignore_index=True)
                cut = last_start(t)
                if cut:
                    yield f(t.iloc[:cut].reset_index(drop=True))
                held = [t.iloc[cut:]]
                rows = len(held[0])
        if held and rows:
            yield f(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
