"""The last breadcrumbs of each person, attached to the next crash: a stateful stream operator with a time to live."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = 100
TTL_MS = 1_800_000


def _fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    times, texts = map(deque, state.get if state.exists else ([], []))
    out = []
    rows = pd.concat(list(frames)).sort_values(["us", "kind"])
    for us, kind, text in zip(rows["us"], rows["kind"], rows["text"]):
        while times and (times[0] < us - TTL_MS * 1000 or len(times) > KEEP):
            times.popleft(), texts.popleft()
        if kind == "crumb":
            times.append(int(us)), texts.append(text)
        else:
            out.append((*key, text, int(us), list(texts)[-KEEP:]))
            times.clear(), texts.clear()
    while len(times) > KEEP:
        times.popleft(), texts.popleft()
    if times:
        state.update((list(times), list(texts)))
        state.setTimeoutDuration(TTL_MS)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["app_id", "distinct_id", "crash", "us", "breadcrumbs"])


def attach(items: DataFrame) -> DataFrame:
    """``items``: a stream of app_id, distinct_id, us (bigint), kind (crumb or crash), text. One row per crash."""
    out = "app_id string, distinct_id string, crash string, us bigint, breadcrumbs array<string>"
    state = "times array<bigint>, texts array<string>"
    return items.groupBy("app_id", "distinct_id").applyInPandasWithState(_fold, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)
