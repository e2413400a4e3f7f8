"""Circuit breakers over a stream (W1): state by provider, the same step as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators.state import CIRCUIT_SCHEMA, Circuit

_STATE = "state string, failures long, successes long, opened_at long, refused long"


def circuit_stream(events: DataFrame, threshold: int = 5, reset_ms: int = 300_000, half_open: int = 2) -> DataFrame:
    """Each provider's circuit after every batch of events (provider, seq, ts_ms, success); update mode."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, failures, successes, opened, refused = state.get if state.exists else ("closed", 0, 0, -1, 0)
        c = Circuit(kind, failures, successes, opened)
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "seq"])
        for ts, ok in rows[["ts_ms", "success"]].itertuples(index=False):
            refused += not c.step(int(ts), bool(ok), threshold, reset_ms, half_open)
        state.update((c.state, c.failures, c.successes, c.opened_at, refused))
        yield pd.DataFrame([[key[0], c.state, c.failures, c.successes, refused, c.opened_at]], columns=["provider", "state", "failures", "successes", "refused", "opened_at"])

    return events.groupBy("provider").applyInPandasWithState(fold, CIRCUIT_SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)
