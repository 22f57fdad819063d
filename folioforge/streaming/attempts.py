"""Attempt events as a stream: legality of transitions with state per transaction, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.executors import ship
from folioforge.operators.lifecycle import LEGAL

VIOLATIONS = "transaction_id bigint, sequence bigint, before string, state string"


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events (transaction_id, sequence, state) that do not follow legally on the last one of their transaction. Events of a transaction arrive in order of sequence; the state is its last event."""
    legal = set(LEGAL)
    ship(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get[0] if held.exists else "none"
        out = []
        for x in pd.concat(list(batches)).sort_values("sequence").itertuples(index=False):
            if (before, x.state) not in legal:
                out.append((key[0], x.sequence, before, x.state))
            before = x.state
        held.update((before,))
        yield pd.DataFrame(out, columns=["transaction_id", "sequence", "before", "state"])

    return events.groupBy("transaction_id").applyInPandasWithState(run, VIOLATIONS, "last string", "append", GroupStateTimeout.NoTimeout)


def outcome_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by kind and window; windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
