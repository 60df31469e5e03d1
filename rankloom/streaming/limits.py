"""Streaming forms: sliding-window acceptance as keyed state, windowed counts with a watermark.

The batch forms have arrival order as their clock; the stream takes event time and adds a watermark (an addition).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, id bigint, t double, allowed boolean"


class AcceptWithin(StatefulProcessor):
    """At most ``limit`` accepted events of a key in any ``window`` seconds; the accepted times are the state."""

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("accepted", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        accepted = [r[0] for r in self.log.get()]
        out = []
        for r in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: (r.t, r.id)):
            accepted = [t for t in accepted if r.t - t < self.window]
            ok = len(accepted) < self.limit
            if ok:
                accepted.append(r.t)
            out.append((key[0], r.id, r.t, ok))
        self.log.put([(t,) for t in accepted])
        yield pd.DataFrame(out, columns=["key", "id", "t", "allowed"])

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, limit: int, window: float) -> DataFrame:
    """Stream (key, id, t) with the decision on each event. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=AcceptWithin(limit, window), outputStructType=OUT, outputMode="Append", timeMode="None")


def windowed_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums per window; rows later than the watermark are dropped."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_micros("window.start").alias("start_us"), by, "n", "total")


def library_changes(stream: DataFrame, merge, checkpoint: str):  # type: ignore[no-untyped-def]
    """Micro-batches of library changes handed to ``merge(batch, batch_id)``; resumed from the checkpoint."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True)
