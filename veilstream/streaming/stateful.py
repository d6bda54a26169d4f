"""Streaming versions of the stateful operators; each gives the batch operator's results for the same order of arrival."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilstream.operators import audit

#: A session's state goes this long after it was last used.
HOURS = 24


def telemetry_stream(requests: DataFrame) -> DataFrame:
    """Events of a stream of requests; without state."""
    return audit.telemetry(requests)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """A query that appends a stream of events as JSON lines by day."""
    rows = events.withColumn("date", F.to_date("timestamp"))
    return rows.writeStream.format("json").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain_events(events: DataFrame, partition: str, order: str, columns: list[str], start: str = "") -> DataFrame:
    """(partition, order, body, prev_hash, event_hash) for a stream of events: audit.chain() that goes on from batch to batch.

    State is the last hash of each partition of the log. Events are chained in the order of `order` within a batch and in that
    of arrival between batches; `body` is the JSON that was hashed.
    """
    rows = events.select(partition, order, audit.canonical(columns).alias("body"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else start
        batch = pd.concat(list(parts)).sort_values(order, kind="stable")
        before, own = [], []
        for body in batch["body"]:
            before.append(last)
            last = hashlib.sha256((last + body).encode()).hexdigest()
            own.append(last)
        state.update((last,))
        yield batch[[partition, order, "body"]].assign(prev_hash=before, event_hash=own)

    shape = f"{partition} {kinds[partition]}, {order} {kinds[order]}, body string, prev_hash string, event_hash string"
    return rows.groupBy(partition).applyInPandasWithState(run, shape, "last string", "append", GroupStateTimeout.NoTimeout)


def limit_logins(attempts: DataFrame, seconds: int = 300, most: int = 8, late: str = "1 hour") -> DataFrame:
    """(ip, username, attempt_id, ts, failures, blocked) for a stream of attempts; state is the times of recent failures.

    Time is that of the events: a key's state goes once the watermark, `late` behind, has passed its last failure by
    `seconds`. Attempts that come later than that are left out.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "attempt_id"])
        out, now = [], 0
        for r in rows.itertuples(index=False):
            now = int(r.ts.timestamp())
            times = [t for t in times if t >= now - seconds]
            out.append((*key, r.attempt_id, r.ts, len(times), len(times) >= most))
            times = [] if r.success else [*times, now]
        state.update((times,))
        state.setTimeoutTimestamp(max((now + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ip", "username", "attempt_id", "ts", "failures", "blocked"])

    shape = "ip string, username string, attempt_id long, ts timestamp, failures long, blocked boolean"
    return attempts.withWatermark("ts", late).groupBy("ip", "username").applyInPandasWithState(run, shape, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_answers(requests: DataFrame, provider: Callable[[str], Iterator[str]]) -> DataFrame:
    """(request_id, seq, kind, content) for requests (request_id, prompt): the parts of each answer as an injected provider gives them.

    `text` for each part, then `done`; `error` with the reason where the provider fails. Works on streams and tables.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = []
                try:
                    out += [(r.request_id, n, "text", part) for n, part in enumerate(provider(r.prompt))]
                    out.append((r.request_id, len(out), "done", None))
                except Exception as e:  # whatever the provider raises ends this answer only
                    out.append((r.request_id, len(out), "error", str(e)))
                yield pd.DataFrame(out, columns=["request_id", "seq", "kind", "content"])

    return requests.select("request_id", "prompt").mapInPandas(run, "request_id string, seq long, kind string, content string")


class Answers(StatefulProcessor):
    """The parts of an answer by their number, and where it ends; a part goes out when all before it are there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = HOURS * 3600 * 1000
        self.parts = handle.getMapState("parts", "seq long", "content string", ttl)
        self.place = handle.getValueState("place", "next long, last long, kind string, content string", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given, last, kind, content = self.place.get() if self.place.exists() else (0, -1, "", "")
        out = []
        if given >= 0:  # an answer that has ended takes no more parts
            for batch in rows:
                for r in batch.itertuples(index=False):
                    if r.kind == "text":
                        self.parts.updateValue((int(r.seq),), (r.content or "",))
                    elif r.kind in ("done", "error") and (last < 0 or r.seq < last):
                        last, kind, content = int(r.seq), r.kind, r.content
            while (last < 0 or given < last) and self.parts.containsKey((given,)):
                out.append((key[0], "text", self.parts.getValue((given,))[0]))
                given += 1
            if 0 <= last == given:
                whole = "".join(self.parts.getValue((n,))[0] for n in range(last)) if kind == "done" else content
                out.append((key[0], kind, whole))
                self.parts.clear()
                given = -1
            self.place.update((given, last, kind, content))
        yield pd.DataFrame(out, columns=["request_id", "kind", "content"])

    def close(self) -> None:
        pass


def gather_answers(parts: DataFrame) -> DataFrame:
    """(request_id, kind, content) from a stream (request_id, seq, kind, content): each text in order once those before it have come, the whole once `done` and all before it are there.

    Parts may come in any order over any batches, and `done` before parts. Numbers begin at 0. An answer's state goes HOURS after
    its last part; it stays that long after its end, so that late copies of parts are not taken for a new answer. Needs the
    RocksDB state store.
    """
    return parts.groupBy("request_id").transformWithStateInPandas(Answers(), "request_id string, kind string, content string", "append", "ProcessingTime")


class Placeholders(StatefulProcessor):
    """A session's placeholders: value state by canonical value, counters by label; gone HOURS after their last use."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = HOURS * 3600 * 1000
        self.known = handle.getMapState("known", "canonical string", "placeholder string", ttl)
        self.count = handle.getMapState("count", "label string", "n long", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if self.known.containsKey((r.canonical,)):
                given = self.known.getValue((r.canonical,))[0]
            else:
                n = (self.count.getValue((r.label,))[0] if self.count.containsKey((r.label,)) else 0) + 1
                self.count.updateValue((r.label,), (n,))
                given = f"[{r.label}_{n}]"
                self.known.updateValue((r.canonical,), (given,))
            out.append((key[0], int(r.seq), r.canonical, given))
        yield pd.DataFrame(out, columns=["session_id", "seq", "canonical", "placeholder"])

    def close(self) -> None:
        pass


def stream_placeholders(values: DataFrame) -> DataFrame:
    """(session_id, seq, canonical, placeholder) for a stream (session_id, seq, canonical, label). Needs the RocksDB state store."""
    return values.groupBy("session_id").transformWithStateInPandas(Placeholders(), "session_id string, seq long, canonical string, placeholder string", "append", "ProcessingTime")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in windows of event time; rows later than `late` are left out. An addition of this engine."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
