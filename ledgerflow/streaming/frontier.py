"""Commit positions over a stream, one state per partition: position, offsets delivered but not absorbed, completions of those."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def advance(position: int | None, pending: list[int], done: set[int], delivered: Iterable[int], completed: Iterable[int]) -> tuple[int | None, list[int], set[int]]:
    """The state after one batch. The position never falls.

    The first delivered offset is the floor. A delivery at or below the newest one known, or below the position, is a
    redelivery and changes nothing; a completion below the oldest open delivery is stale and forgotten. Without any
    delivery the first completion stands for the floor, and completions count as a dense run.
    """
    fresh = sorted(set(delivered))
    if position is None and fresh:
        position = fresh[0]
    newest = pending[-1] if pending else (position or 0) - 1
    pending = pending + [o for o in fresh if o > newest]
    done = done.union(completed)
    ready = next((k for k, o in enumerate(pending) if o not in done), len(pending))
    if ready:
        position = pending[ready - 1] + 1
    pending = pending[ready:]
    if pending:
        return position, pending, {o for o in done if o > pending[0]}
    if position is None and done:
        position = min(done) + 1
    while position in done:
        position += 1
    return position, pending, {o for o in done if o > position} if done else done


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Within a batch, deliveries count before completions. State holds only what isn't absorbed: bounded by what is in flight."""
    position, emitted, pending, done = state.get if state.exists else (None, None, [], [])
    seen, ended = set(), set()
    for pdf in batches:
        seen.update(int(x) for x in pdf.loc[pdf["kind"] == "observe", "offset"])
        ended.update(int(x) for x in pdf.loc[pdf["kind"] == "done", "offset"])
    position, pending, done = advance(position, list(pending), set(done), seen, ended)
    state.update((position, position, pending, sorted(done)))
    if position is not None and position != emitted:
        yield pd.DataFrame({"topic": [key[0]], "partition": [key[1]], "position": [position], "parked": [len(done)]})


def stream_positions(log: DataFrame) -> DataFrame:
    """(topic, partition, position, parked), emitted when the position moves, from (topic, partition, offset, kind in observe | done)."""
    return log.groupBy("topic", "partition").applyInPandasWithState(
        _advance, "topic string, partition int, position long, parked int", "position long, emitted long, pending array<long>, done array<long>", "append", GroupStateTimeout.NoTimeout
    )
