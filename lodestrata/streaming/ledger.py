"""The delivery ledger as a stream: per session and content the last hash decides whether a delivery is new, unchanged or changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def actions(deliveries: DataFrame) -> DataFrame:
    """(session_id, content_id, turn, action) of a stream of deliveries (session_id, content_id, turn, content_hash).

    The state of a key is one hash; deliveries of a micro-batch are taken in the order of their turns.
    """
    kind = deliveries.schema["session_id"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(parts)).sort_values("turn").itertuples(index=False):
            rows.append((key[0], key[1], r.turn, "new" if last is None else "unchanged" if last == r.content_hash else "changed"))
            last = r.content_hash
        state.update((last,))
        yield pd.DataFrame(rows, columns=["session_id", "content_id", "turn", "action"])

    return deliveries.groupBy("session_id", "content_id").applyInPandasWithState(step, f"session_id {kind}, content_id string, turn long, action string", "hash string", "append", GroupStateTimeout.NoTimeout)
