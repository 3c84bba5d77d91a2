"""Rate limits: windows that a visitor's first request opens; refused requests don't count.

One state machine, used by a batch replay (sorted groups) and by Structured Streaming (keyed state). Time is event time in
seconds. Visitors with many events are the unit of state, so a hot visitor is one task's stream but only a few numbers of
state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (limit, window in seconds) by category.
RULES = {"checks": ((90, 60),), "lookups": ((180, 60), (2000, 3600))}


def hit(state: dict[float, tuple[float, int]], now: float, rules) -> int | None:
    """Seconds to wait, or None where the request passes; state maps a window to (opened, count) and is changed.

    Windows that are over open anew. A request waits for the last of the full windows to end, and only one that waits for
    none is counted.
    """
    for _, window in rules:
        if window not in state or state[window][0] + window <= now:
            state[window] = (now, 0)
    full = [state[window][0] + window - now for limit, window in rules if state[window][1] >= limit]
    if full:
        return max(1, math.ceil(max(full)))
    for _, window in rules:
        state[window] = (state[window][0], state[window][1] + 1)
    return None


def replay(events: DataFrame, rules=((90, 60),), key: str = "key", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(id, key, ts, wait) of each event in order of time (then id): wait is null where it passes.

    Events are sorted in their partition and streamed through the state machine, so memory is one visitor's state. Events
    without a key or a time can't be judged: they come back with a null wait and count nowhere.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (id_col, key)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, state = object(), {}
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["t"], strict=True):
                if k != now_key:
                    now_key, state = k, {}
                out.append(hit(state, t, rules))
            yield pd.DataFrame({"id": b["id"], "key": b["key"], "t": b["t"], "wait": pd.array(out, "Int64")})

    rows = events.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(ts).cast("double").alias("t"))
    judged = "key is not null and t is not null"
    rest = rows.where(f"not ({judged})").withColumn("wait", F.lit(None).cast("long"))
    rows = rows.where(judged)
    out = rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(run, f"id {kinds[id_col]}, key {kinds[key]}, t double, wait long")
    return out.unionByName(rest).withColumnsRenamed({"id": id_col, "key": key, "t": ts})


def stream(events: DataFrame, rules=((90, 60),), key: str = "key", ts: str = "ts", id_col: str = "event_id", ttl: float = 3600.0) -> DataFrame:
    """The same decisions over a stream: keyed state that ends once event time is `ttl` seconds past a visitor's last event.

    A batch's events of a visitor are taken in order of time; the source's order holds between batches. Events more than
    `ttl` seconds behind the latest one seen are too late to be judged and are dropped by the watermark; those without a key
    or a time come back with a null wait, as in `replay`. The watermark starts at 0, so times are above 0.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {c: events.schema[c].dataType.simpleString() for c in (id_col, key)}

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {w: (o, n) for w, o, n in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["t", "id"], ignore_index=True)
        waits = [hit(held, t, rules) for t in rows["t"]]
        state.update(([float(w) for w in held], [float(o) for o, _ in held.values()], [int(n) for _, n in held.values()]))
        state.setTimeoutTimestamp(int((rows["t"].max() + ttl) * 1000))
        yield pd.DataFrame({"id": rows["id"], "key": k[0], "t": rows["t"], "wait": pd.array(waits, "Int64")})

    rows = events.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(ts).cast("double").alias("t"))
    judged = "key is not null and t is not null"
    rest = rows.where(f"not ({judged})").withColumn("wait", F.lit(None).cast("long"))
    timed = rows.where(judged).withColumn("at", F.timestamp_seconds("t")).withWatermark("at", f"{int(ttl)} seconds")
    out = timed.groupBy("key").applyInPandasWithState(run, f"id {kinds[id_col]}, key {kinds[key]}, t double, wait long", "windows array<double>, opened array<double>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.unionByName(rest).withColumnsRenamed({"id": id_col, "key": key, "t": ts})


def visitor(cf: Column, forwarded: Column, client: Column) -> Column:
    """A request's visitor: the proxy's header, the first forwarded address, the connection; 64 characters at most."""
    first = F.trim(F.split(F.coalesce(forwarded, F.lit("")), ",")[0])
    pick = F.when(F.trim(F.coalesce(cf, F.lit(""))) != "", F.trim(cf)).when(first != "", first).otherwise(F.coalesce(client, F.lit("unknown")))
    return F.substr(pick, F.lit(1), F.lit(64))
