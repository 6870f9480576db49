"""The cache over streams: the keys touched last, kept up to date as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import Cache


def recent_stream(log: DataFrame, capacity: int, cache: str = "cache", order: str = "seq"):
    """After each batch of a streaming log (cache, seq, key, value): cache, evicted keys and what is held.

    The state of a cache is bounded by its capacity.
    """
    state_type = "keys array<string>, held array<double>"
    out_type = f"{cache} string, held_keys array<string>, evicted array<string>"

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Cache(capacity)
        if state.exists:
            for key, value in zip(*state.get):
                now.held[key] = value
        rows = pd.concat(list(batches)).sort_values(order)
        gone = [k for key, value in zip(rows["key"], rows["value"]) for k, _ in now.apply("put", str(key), float(value))]
        state.update((list(now.held.keys()), list(now.held.values())))
        yield pd.DataFrame({cache: [str(name[0])], "held_keys": [list(reversed(now.held.keys()))], "evicted": [gone]})

    return log.groupBy(cache).applyInPandasWithState(run, out_type, state_type, "update", GroupStateTimeout.NoTimeout)
