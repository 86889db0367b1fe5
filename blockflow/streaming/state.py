"""Keyed state over streams: memory and streaks, with expiry.

State lives in a stateful processor on the RocksDB store. Event-time timers remove a key's state once
the watermark has passed the last use by the time limit, whether or not the key comes again; a key
that is back at its start keeps no state at all. So state is bounded by the keys in use, not by
all keys ever seen. Rows of a micro-batch are applied in event order, across micro-batches in
arrival order, so results equal the batch form on in-order input. Rows older than the watermark are
dropped by the engine.
"""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from blockflow.operators import memory as m

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Keyed(StatefulProcessor):
    """One result per row from the state of its key; state unused for ``ttl_s`` of event time is
    removed, and counts as new if a row comes before the watermark has got that far."""

    def __init__(self, start: Callable[[], object],
                 step: Callable[[object, dict], tuple[object, tuple]], columns: list[str],
                 ttl_s: float):
        self.start, self.step, self.columns, self.ttl_s = start, step, columns, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, last double")

    def _expiry(self, last: float) -> int:
        return int((last + self.ttl_s) * 1000) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        held, last = self.start(), None
        if self.held.exists():
            value, last = self.held.get()
            held = json.loads(value)
            held = tuple(held) if isinstance(held, list) else held
            self.handle.deleteTimer(self._expiry(last))
        for pdf in rows:
            out = []
            for row in pdf.sort_values(["time_s", "event_id"]).to_dict("records"):
                if last is not None and row["time_s"] - last > self.ttl_s:
                    held = self.start()
                held, result = self.step(held, row)
                last = row["time_s"]
                out.append(result)
            yield pd.DataFrame(out, columns=self.columns)
        if held == self.start():
            self.held.clear()
        else:
            self.held.update((json.dumps(held), last))
            self.handle.registerTimer(self._expiry(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_state(stream: DataFrame, keys: list[str], start: Callable[[], object],
                step: Callable[[object, dict], tuple[object, tuple]], ddl: str, ttl_s: float,
                late: str = "1 day") -> DataFrame:
    """``step(state, row) → (state, result)`` over the rows of each key; ``late`` is how far rows
    may lag behind the latest one. Sets the session's state store, which timers need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = (stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
             .withColumn("time_s", m.seconds(F.col("ts"))))
    columns = [f.split()[0] for f in ddl.split(", ")]
    return timed.groupBy(*keys).transformWithStateInPandas(
        Keyed(start, step, columns, ttl_s), ddl, "append", "EventTime")


def learn_stream(events: DataFrame, min_quality: float = 0.65, margin: float = 0.12,
                 ttl_s: float = 30 * m.DAY, late: str = "1 day") -> DataFrame:
    """Memory entry of the key after each learning event; an entry not used for ``ttl_s`` goes."""
    ddl = ("doc_id bigint, source_key string, source_lang string, target_lang string, "
           "event_id bigint, translation string, quality double, occurrences bigint")

    def step(held, row):
        if held is None:
            held = (row["target"], row["translation"], row["quality"], 1)
        else:
            target, shown, quality, n = held
            if target == row["target"]:
                held = (target, shown, max(quality, row["quality"]), n + 1)
            elif row["quality"] >= quality + margin:
                held = (row["target"], row["translation"], row["quality"], 1)
            else:
                held = (target, shown, quality, n + 1)
        return held, (*[row[k] for k in m.KEYS], row["event_id"], *held[1:])

    useful = m.learnable(events, min_quality).select(
        *m.KEYS, F.col("_target").alias("target"), "translation", "quality", "event_id", "ts")
    return keyed_state(useful, m.KEYS, lambda: None, step, ddl, ttl_s, late)


def streak_stream(calls: DataFrame, fast_s: float = 2.0, limit: int = 3,
                  ttl_s: float = 30 * m.DAY, late: str = "1 day") -> DataFrame:
    """Streak of fast empty results and its alarm per client; a client not heard of for ``ttl_s``
    starts anew."""
    def step(held, row):
        fast = row["n_blocks"] == 0 and row["elapsed_s"] < fast_s
        held = 0 if row["n_blocks"] > 0 else held + int(fast)
        return held, (row["client"], row["event_id"], held, bool(fast and held >= limit))

    return keyed_state(calls, ["client"], lambda: 0, step,
                       "client bigint, event_id bigint, streak bigint, alarm boolean", ttl_s, late)
