"""Rate limits per caller: the exact greedy rule, over tables and streams, and a bound by a window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

LIMIT, SECONDS = 100, 60


def _admit(kept: deque, at: float, limit: int, seconds: float) -> bool:
    """Whether a request is admitted; `kept` holds the times of those admitted in the last `seconds`."""
    while kept and kept[0] <= at - seconds:
        kept.popleft()
    if len(kept) >= limit:
        return False
    kept.append(at)
    return True


def _fold(by: str, at: str, limit: int, seconds: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, kept = object(), deque()
        for f in frames:
            out = []
            for k, t in zip(f[by], f[at]):
                if k != who:
                    who, kept = k, deque()
                out.append(_admit(kept, t.timestamp(), limit, seconds))
            yield f.assign(admitted=out)

    return run


def limited(requests: DataFrame, by: str, at: str, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """Adds `admitted`. A request is admitted if fewer than `limit` were in the `seconds` before; rejected ones don't count.

    A caller's requests are folded in order of time as they stream by; no more than `limit` times are held, however many
    requests a caller has. Requests of one time are in no set order, and as many of them are admitted in any.
    """
    d = requests.repartition(by).sortWithinPartitions(by, at)
    return d.mapInPandas(_fold(by, at, limit, seconds), requests.schema.add("admitted", "boolean"))


def limited_stream(requests: DataFrame, by: str, at: str, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """(by, at, admitted) of a stream: the admitted times of a caller are its state, which goes when the caller has been silent
    for `seconds` of processing time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0] if state.exists else [])
        rows = pd.concat(frames).sort_values(at)
        out = [_admit(kept, t.timestamp(), limit, seconds) for t in rows[at]]
        state.update((list(kept),))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({by: [key[0]] * len(rows), at: rows[at].to_numpy(), "admitted": out})

    kind = dict(requests.dtypes)[by]
    return requests.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {at} timestamp, admitted boolean", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def window_bound(requests: DataFrame, by: str, at: str, seconds: int = SECONDS) -> DataFrame:
    """Adds `recent`: the caller's requests in the `seconds` up to each, rejected ones among them; a request of which it is at most
    the limit is surely admitted."""
    over = Window.partitionBy(by).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return requests.withColumn("recent", F.count("*").over(over))
