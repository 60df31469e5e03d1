"""Sliding-window limits whose decisions depend on earlier decisions.

Each key's events are streamed in time order with the state of that key alone in memory, so a key with a third of
all events needs no more memory than any other; a key's decisions are sequential by definition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stream(events: DataFrame, fold, out: str, key: str = "key") -> DataFrame:
    """mapInPandas over events grouped by key and ordered by (t, id); fold(state, t, row) gives (state, values)."""
    names = [x.strip().split()[0] for x in out.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                k = getattr(r, key)
                if k != current:
                    current, state = k, None
                state, values = fold(state, r)
                rows.append(values)
            yield pd.DataFrame(rows, columns=names)

    return events.repartition(key).sortWithinPartitions(key, "t", "id").mapInPandas(run, out)


def rate_limited(events: DataFrame, limit: int, window: float) -> DataFrame:
    """(key, id, t, allowed, retry_after) of events (key, id, t in seconds): at most limit accepted in any window.

    Refused events are not counted. retry_after: whole seconds until the next may be accepted, 0 for accepted ones.
    """

    def fold(log: deque | None, r):
        log = deque() if log is None else log
        while log and r.t - log[0] >= window:
            log.popleft()
        if len(log) < limit:
            log.append(r.t)
            return log, (r.key, r.id, r.t, True, 0)
        return log, (r.key, r.id, r.t, False, max(1, int(log[0] + window - r.t)) if log else 1)

    kind = events.schema["key"].dataType.simpleString()
    return _stream(events.select("key", "id", "t"), fold, f"key {kind}, id bigint, t double, allowed boolean, retry_after int")


def two_level(events: DataFrame, limit: int, window: float, daily: int, day: float = 86_400.0) -> DataFrame:
    """(key, id, t, verdict): the visitor's limit first, then one shared by all. A shared refusal uses the visitor's slot.

    Only events that pass the visitors' limits reach the shared one, which is a single sequence.
    """
    own = rate_limited(events, limit, window)
    passed = own.where("allowed").select(F.lit("all").alias("key"), "id", "t")
    shared = rate_limited(passed, daily, day).select("id", F.col("allowed").alias("shared"))
    return own.join(shared, "id", "left").select("key", "id", "t", F.when(~F.col("allowed"), "visitor").when(~F.coalesce("shared", F.lit(True)), "daily").otherwise("ok").alias("verdict"), F.when(~F.col("allowed"), F.ceil(F.col("retry_after") / 60)).otherwise(F.lit(0)).cast("int").alias("minutes"))


def earliest(booked: list[tuple[float, int]], need: int, now: float, window: float, most: int) -> float:
    """First start from now on whose window meets no stretch in which the load leaves less than ``need``.

    The load is a step function: a booking adds its tokens at its start and returns them one window later. One sweep
    over the steps pushes the start behind every stretch that is too full.
    """
    steps: dict[float, int] = {}
    for when, n in booked:
        steps[when] = steps.get(when, 0) + n
        steps[when + window] = steps.get(when + window, 0) - n
    times = sorted(steps)
    start, load = now, 0
    for at, until in zip(times, [*times[1:], float("inf")]):
        load += steps[at]
        if load + need > most and start < until and at < start + window:
            start = until
    return start


def token_budget(requests: DataFrame, per_window: int, window: float = 60.0, max_wait: float = 120.0) -> DataFrame:
    """(key, id, t, tokens, start, wait): each request books the earliest start at which no window exceeds the budget.

    Requests above the budget count as the budget. One that would wait longer than max_wait books nothing (start NULL).
    """

    def fold(booked: list[tuple[float, int]] | None, r):
        live = [b for b in booked or () if b[0] + window > r.t]
        need = min(int(r.tokens), per_window)
        start = earliest(live, need, r.t, window, per_window)
        if start - r.t > max_wait:
            return live, (r.key, r.id, r.t, need, None, None)
        return [*live, (start, need)], (r.key, r.id, r.t, need, start, start - r.t)

    kind = requests.schema["key"].dataType.simpleString()
    return _stream(requests.select("key", "id", "t", "tokens"), fold, f"key {kind}, id bigint, t double, tokens bigint, start double, wait double")


def sliding_counts(events: DataFrame, seconds: int) -> DataFrame:
    """(key, id, n): events of the key in the window that ends at each event, itself included."""
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(w)).select("key", "id", "n")


def fresh(cache: DataFrame, now: float, ttl: float, inclusive: bool) -> DataFrame:
    """Cached rows (with t, seconds) that still count: responses up to their time to live, lists below it."""
    age = F.lit(now) - F.col("t")
    return cache.where(age <= ttl if inclusive else age < ttl)


def evict(cache: DataFrame, most_bytes: int, key: str, used: str = "last_used", size: str = "bytes") -> DataFrame:
    """The most recently used rows whose bytes fit, the newest always kept.

    A running total by time bucket: totals of buckets are few, and only the bucket at the edge is ranked in itself.
    """
    w = Window.orderBy(F.desc("_b"))
    bucketed = cache.withColumn("_b", F.floor(F.col(used) / 3600))
    totals = bucketed.groupBy("_b").agg(F.sum(size).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    inner = Window.partitionBy("_b").orderBy(F.desc(used), key)
    run = bucketed.join(totals, "_b").where(F.col("_before") <= most_bytes).withColumn("_run", F.col("_before") + F.sum(size).over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", (F.col("_before") == 0) & (F.row_number().over(inner) == 1))
    return run.where((F.col("_run") <= most_bytes) | F.col("_first")).drop("_b", "_before", "_run", "_first")
