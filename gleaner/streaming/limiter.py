"""Admission schedules: a sliding-window rate limiter and a concurrency gate, in batch and as a stream.

admit[i] = max(arrive[i], admit[i-1], admit[i-n] + period). A source's requests are one sequence by nature, so a task
reads them in order, batch by batch, and holds only the last n admissions or the requests in flight.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ADMITTED = "{key} long, arrived_ms long, request_id long, admitted_ms long"


def admit(arrivals: list[int], last: list[int], requests: int, period: int) -> tuple[list[int], list[int]]:
    """Admission times, and the last ones that later requests still depend on."""
    kept, out = list(last), []
    for at in arrivals:
        when = max([at, *kept[-1:], *([kept[-requests] + period] if len(kept) >= requests else [])])
        out.append(when)
        kept = [*kept, when][-requests:]
    return out, kept


def _by_source(arrivals: DataFrame, key: str, step: Callable, *more: str) -> DataFrame:
    """arrivals in order within each source, with admitted_ms from step(state, columns) -> (times, state); a source begins with no state.

    A source stays in one task, since each admission depends on the one before, but only its state is held.
    """
    order = [key, "arrived_ms", "request_id"]
    rows = arrivals.select(*order, *more).repartition(key).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, state = object(), None
        for batch in batches:
            keys, out, start = batch.column(0).to_pylist(), [], 0
            columns = [batch.column(i).to_pylist() for i in (1, *range(3, batch.num_columns))]
            for end in range(1, len(keys) + 1):
                if end == len(keys) or keys[end] != keys[start]:
                    if keys[start] != source:
                        source, state = keys[start], None
                    times, state = step(state, *(c[start:end] for c in columns))
                    out += times
                    start = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=[*order, "admitted_ms"])

    return rows.mapInArrow(run, _ADMITTED.format(key=key))


def rate_limited(arrivals: DataFrame, key: str, requests: int, period_ms: int) -> DataFrame:
    """arrivals(key, arrived_ms, request_id) with admitted_ms: at most so many requests in any period, in arrival order."""
    return _by_source(arrivals, key, lambda last, at: admit(at, last or [], requests, period_ms))


def gated(arrivals: DataFrame, key: str, limit: int) -> DataFrame:
    """arrivals(key, arrived_ms, request_id, took_ms) with admitted_ms: at most limit in flight, first come first served."""

    def step(busy: list[int] | None, arrived: list[int], took: list[int]) -> tuple[list[int], list[int]]:
        busy, out = busy or [], []
        for at, ms in zip(arrived, took, strict=True):
            out.append(max(at, heapq.heappop(busy)) if len(busy) >= limit else at)
            heapq.heappush(busy, out[-1] + ms)
        return out, busy

    return _by_source(arrivals, key, step, "took_ms")


def rate_limited_stream(arrivals: DataFrame, key: str, requests: int, period_ms: int) -> DataFrame:
    """The same on a stream; a source's state is its last admissions."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["arrived_ms", "request_id"])
        last = list(state.get[0]) if state.exists else []
        out, last = admit(pdf["arrived_ms"].tolist(), last, requests, period_ms)
        state.update((last,))
        yield pdf.assign(admitted_ms=out)[[key, "arrived_ms", "request_id", "admitted_ms"]]

    grouped = arrivals.select(key, "arrived_ms", "request_id").groupBy(key)
    return grouped.applyInPandasWithState(run, _ADMITTED.format(key=key), "admitted array<long>", "append", GroupStateTimeout.NoTimeout)
