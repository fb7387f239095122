"""A stateful circuit breaker for streams of calls: after `limit` failures in a row a page's primary backend is off."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "page_id long, event_id long, primary_disabled boolean"


def breaker(calls: DataFrame, limit: int = 3) -> DataFrame:
    """calls: a stream of page_id, event_id and usable, in order of event_id within a page and trigger."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, off = state.get if state.exists else (0, False)
        rows = pd.concat(list(parts)).sort_values("event_id")
        flags = []
        for usable in rows["usable"]:
            flags.append(off)
            run = 0 if usable else run + 1
            off = off or run >= limit
        state.update((run, off))
        yield pd.DataFrame({"page_id": key[0], "event_id": rows["event_id"].to_numpy(), "primary_disabled": flags})

    return calls.groupBy("page_id").applyInPandasWithState(step, OUTPUT, "run int, off boolean", "append", GroupStateTimeout.NoTimeout)
