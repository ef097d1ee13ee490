"""Streams of answers and of cache rows, with state that ends: transformWithState, its timers, and RocksDB for the state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.policy import next_request, next_run

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "user_id long, event_id long, slow double, cooldown long, hits int, waited long, outcome string"
HIT = "user_id long, event_id long, hit boolean, age_ms long"


@contextmanager
def state_store(spark: SparkSession):
    """RocksDB keeps the state meanwhile, as transformWithState asks; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _frames(rows: Iterator, order: list[str]):
    import pandas as pd

    return pd.concat(list(rows)).sort_values(order)


class Requests(StatefulProcessor):
    """A run's state (slow, cooldown) is apart from that of its requests (429s in a row, waits, tries), a map entry each, which
    goes with the request's last answer. A request that isn't heard of for `forgotten_ms` after it could have gone on is
    abandoned: a timer takes its entry away and says so."""

    def __init__(self, forgotten_ms: int = 3_600_000) -> None:
        self.forgotten_ms = forgotten_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "slow double, cooldown long")
        self.requests = handle.getMapState("requests", "request long", "hits int, waited long, tries int, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = not self.run.exists()  # a new run has no requests either
        slow, cooldown = (1.0, 0) if new else self.run.get()
        out = []
        # Answers of a batch, in their order; each call of the state is a message to Spark, so a request's entry is read where it
        # comes first and written once
        stored: dict[int, tuple | None] = {}
        going: dict[int, tuple | None] = {}
        for r in _frames(rows, ["event_id"]).itertuples():
            request, status = int(r.request), None if pd.isna(r.status) else int(r.status)
            wait_ms, at = None if pd.isna(r.wait_ms) else int(r.wait_ms), int(r.at)
            if request not in going:
                stored[request] = going[request] = None if new or not self.requests.containsKey((request,)) else self.requests.getValue((request,))
            own, wait, outcome = next_request(*(going[request] or (0, 0, 0))[:3], status, wait_ms)
            tried = outcome == "retry"
            slow, cooldown = next_run(slow, cooldown, at, status, wait if status == 429 else wait_ms, tried and status == 429, tried and status != 429)
            going[request] = (*own, max(cooldown, at + wait) + self.forgotten_ms) if tried else None
            out.append((int(key[0]), int(r.event_id), slow, cooldown, own[0], own[1], outcome))
        for request, entry in going.items():
            if entry:
                self.requests.updateValue((request,), entry)
                self.handle.registerTimer(entry[3])
            elif stored[request]:
                self.requests.removeKey((request,))
        self.run.update((slow, cooldown))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [k for k, v in self.requests.iterator() if v[3] <= now]
        for k in gone:
            self.requests.removeKey(k)
        slow, cooldown = self.run.get() if self.run.exists() else (1.0, 0)
        yield pd.DataFrame([(int(key[0]), -int(k[0]) - 1, slow, cooldown, 0, 0, "abandoned") for k in gone], columns=[c.split()[0] for c in ANSWER.split(", ")])

    def close(self) -> None:
        pass


def requests(answers: DataFrame, forgotten_ms: int = 3_600_000, watermark: str = "1 day") -> DataFrame:
    """answers(user_id, event_id, ts, request, at, status, wait_ms), streamed -> ANSWER after each; an abandoned request is a
    row with -request - 1 in place of event_id. Answers of a user are taken in the order of event_id within a batch."""
    seen = answers.withWatermark("ts", watermark)
    return seen.groupBy("user_id").transformWithStateInPandas(Requests(forgotten_ms), ANSWER, "Append", "EventTime")


class Cache(StatefulProcessor):
    """The last success of a key, for `ttl_ms`; a timer takes it away when its time is over and nothing newer has come."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        saved = self.saved.get()[0] if self.saved.exists() else None
        first, out = saved, []
        for r in _frames(rows, ["at", "event_id"]).itertuples():
            age = None if saved is None else int(r.at) - saved
            hit = age is not None and age <= self.ttl_ms
            out.append((int(key[0]), int(r.event_id), hit, age if hit else None))
            if r.ok:
                saved = int(r.at)
        if saved is not None and saved != first:
            self.saved.update((saved,))
            self.handle.registerTimer(saved + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "hit", "age_ms"]).astype({"age_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.saved.exists() and self.saved.get()[0] + self.ttl_ms < expiredTimerInfo.getExpiryTimeInMs():
            self.saved.clear()
        yield pd.DataFrame({"user_id": [], "event_id": [], "hit": [], "age_ms": []}).astype({"user_id": "int64", "event_id": "int64", "hit": "bool", "age_ms": "Int64"})

    def close(self) -> None:
        pass


def cache_hits(events: DataFrame, ttl_ms: int, watermark: str = "1 day") -> DataFrame:
    """events(user_id, event_id, ts, at (ms), ok), streamed -> HIT: whether each finds a success of its user that is at most
    ttl_ms old, and how old. Events of a batch are taken in the order of (at, event_id)."""
    seen = events.withWatermark("ts", watermark)
    return seen.groupBy("user_id").transformWithStateInPandas(Cache(ttl_ms), HIT, "Append", "EventTime")
