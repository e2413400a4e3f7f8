"""Keyed state machines (W1, W3, W4): one pure step function each, for batch and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Circuit:
    """Opens after ``threshold`` failures in a row; after ``reset_ms`` a probe may pass; lifetime successes close it."""

    state: str = "closed"
    failures: int = 0
    successes: int = 0
    opened_at: int = -1

    def step(self, ts: int, success: bool, threshold: int = 5, reset_ms: int = 300_000, half_open: int = 2) -> bool:
        """Apply one event; false if the open circuit refused it."""
        if self.state == "open":
            if ts - self.opened_at <= reset_ms:
                return False
            self.state = "half-open"
        if success:
            self.successes += 1
            self.failures = 0
            if self.state == "half-open" and self.successes >= half_open:
                self.state, self.opened_at = "closed", -1
        else:
            self.failures += 1
            if self.state == "half-open" or self.failures >= threshold:
                self.state, self.opened_at = "open", ts
        return True


@dataclass
class Throttle:
    """Delay doubles on 429 and 503, grows by half on an error, shrinks after five successes in a row; five refusals in a row stop."""

    delay: float = 1000.0
    refused: int = 0
    succeeded: int = 0

    def step(self, status: int, least: float = 200.0, most: float = 30_000.0) -> None:
        """Apply a response's status; 0 stands for a network error."""
        if status in (429, 503):
            self.refused += 1
            self.succeeded = 0
            self.delay = min(self.delay * 2, most)
        elif 200 <= status < 300:
            self.succeeded += 1
            self.refused = 0
            if self.succeeded >= 5 and self.delay > least:
                self.delay = max(self.delay * 0.9, least)
                self.succeeded = 0
        elif status == 0:
            self.refused += 1
            self.delay = min(self.delay * 1.5, most)

    @property
    def stopped(self) -> bool:
        return self.refused >= 5


CIRCUIT_SCHEMA = "provider string, state string, failures long, successes long, refused long, opened_at long"


def _folded(events: DataFrame, order: list[str], fresh: Callable[[], Any], step: Callable[[Any, tuple], Any], result: Callable[[Any], list], schema: str) -> DataFrame:
    """One row per provider: ``result`` of the state after all its events (columns ``order``), step by step in that order.

    Events are sorted within partitions and pass by in batches, so a history
    of any length takes no more memory than a batch.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, at, done = None, None, []
        for f in frames:
            for row in f.itertuples(index=False):
                if at is None or row[0] != key:
                    if at is not None:
                        done.append([key, *result(at)])
                    key, at = row[0], fresh()
                at = step(at, tuple(row)[1:])
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if at is not None:
            yield pd.DataFrame([[key, *result(at)]], columns=names)

    rows = events.select("provider", *order).repartition("provider").sortWithinPartitions("provider", *order)
    return rows.mapInPandas(run, schema)


def circuit_states(events: DataFrame, threshold: int = 5, reset_ms: int = 300_000, half_open: int = 2) -> DataFrame:
    """State of each provider's circuit after its events (provider, ts_ms, seq, success), in order of time."""

    def step(at: tuple[Circuit, int], row: tuple) -> tuple[Circuit, int]:
        ts, _, ok = row
        return at[0], at[1] + (not at[0].step(int(ts), bool(ok), threshold, reset_ms, half_open))

    return _folded(events, ["ts_ms", "seq", "success"], lambda: (Circuit(), 0), step, lambda at: [at[0].state, at[0].failures, at[0].successes, at[1], at[0].opened_at], CIRCUIT_SCHEMA)


def reset(states: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """``states`` with the circuits of ``providers`` (all without them) as at the start."""
    fresh = {"state": F.lit("closed"), "failures": F.lit(0).cast("long"), "successes": F.lit(0).cast("long"), "refused": F.lit(0).cast("long"), "opened_at": F.lit(-1).cast("long")}
    if providers is None:
        return states.select("provider", *(v.alias(k) for k, v in fresh.items()))
    marked = states.join(providers.select("provider", F.lit(True).alias("again")), "provider", "left")
    return marked.select("provider", *(F.when(F.col("again"), v).otherwise(F.col(k)).alias(k) for k, v in fresh.items()))


def throttle_delays(events: DataFrame) -> DataFrame:
    """Delay of each provider after its responses (provider, seq, status)."""

    def step(at: Throttle, row: tuple) -> Throttle:
        at.step(int(row[1]))
        return at

    return _folded(events, ["seq", "status"], Throttle, step, lambda t: [round(t.delay, 6), t.refused, t.stopped], "provider string, delay_ms double, refused_in_a_row long, stopped boolean")
