"""The audit log: redacted payloads, a hash chain per log partition, and its verification.

An event's hash is over the hash before it and the event's own JSON. Recording is serial within a partition by nature
(sorted rows pass through a worker in batches, which keeps the last hash only); verification compares neighbours and recomputes each hash for itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions import fixed

REMOVED = "[REDACTED]"


def redact(payload: Column, keys: tuple[str, ...] = fixed.SENSITIVE_KEYS) -> Column:
    """A map of strings without the values of sensitive keys, in any case."""
    return F.transform_values(payload, lambda k, v: F.when(F.lower(k).isin(*keys), F.lit(REMOVED)).otherwise(v))


def _clean(value, keys: frozenset[str]):
    if isinstance(value, dict):
        return {k: REMOVED if k.lower() in keys else _clean(v, keys) for k, v in value.items()}
    return [_clean(v, keys) for v in value] if isinstance(value, list) else value


def redact_json(rows: DataFrame, column: str = "payload", keys: tuple[str, ...] = fixed.SENSITIVE_KEYS) -> DataFrame:
    """The same for JSON of any depth; what is not JSON becomes null. Keys are sorted."""
    names = frozenset(keys)

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return json.dumps(_clean(json.loads(v), names), sort_keys=True, ensure_ascii=False) if v is not None else None
            except ValueError:
                return None

        return values.map(one)

    return rows.withColumn(column, clean(column))


def canonical(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def event_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat(previous, body), 256)


def tails(log: DataFrame, partition: str, order: str) -> DataFrame:
    """(partition, event_hash): the last hash of each partition of a stored log, from which chain() goes on."""
    return log.groupBy(partition).agg(F.max_by("event_hash", order).alias("event_hash"))


def chain(events: DataFrame, partition: str, order: str, columns: list[str], start: str = "", after: DataFrame | None = None) -> DataFrame:
    """events with prev_hash and event_hash, chained in order within each partition of the log (such as a day).

    A partition begins with `start`, or goes on from its row of `after` (see tails()).
    """
    bodies = events.withColumn("_body", canonical(columns))
    if after is None:
        bodies = bodies.withColumn("_start", F.lit(start))
    else:
        last = after.select(F.col(partition).alias("_p"), F.col("event_hash").alias("_start"))
        bodies = bodies.join(last, F.col(partition).eqNullSafe(F.col("_p")), "left").drop("_p").withColumn("_start", F.coalesce("_start", F.lit(start)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, start
        for part in parts:
            prev, own = [], []
            for key, body, begin in zip(*(part[c].to_pylist() for c in ("_key", "_body", "_start")), strict=True):
                if key != last:
                    last, before = key, begin
                prev.append(before)
                before = hashlib.sha256((before + body).encode()).hexdigest()
                own.append(before)
            new = {"prev_hash": pa.array(prev, pa.string()), "event_hash": pa.array(own, pa.string())}
            kept = [n for n in part.schema.names if n not in new]
            yield pa.RecordBatch.from_arrays([*[part[n] for n in kept], *new.values()], names=[*kept, *new])

    bodies = bodies.withColumn("_key", F.to_json(F.struct(partition), {"ignoreNullFields": "false"}))
    shape = bodies.drop("prev_hash", "event_hash").withColumns({"prev_hash": F.lit(""), "event_hash": F.lit("")}).schema
    return bodies.repartition(partition).sortWithinPartitions(partition, order).mapInArrow(run, shape).drop("_body", "_key", "_start")


def verify(events: DataFrame, partition: str, order: str, columns: list[str]) -> DataFrame:
    """(partition, order, linked, intact): whether each event follows the one before it, and its hash is that of its content.

    The first event of a partition's rows is taken to follow its own prev_hash, so a later part of a log can be verified.
    """
    before = F.lag("event_hash").over(Window.partitionBy(partition).orderBy(order))
    return events.select(partition, order, (F.coalesce(before, "prev_hash") == F.col("prev_hash")).alias("linked"), (event_hash(F.col("prev_hash"), canonical(columns)) == F.col("event_hash")).alias("intact"))


def write_log(events: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append as JSON lines, a folder for each day."""
    events.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date").json(path)


def route_event(method: Column, path: Column) -> Column:
    """The event of a request: the first route that matches; null where none does."""
    out = F.lit(None).cast("string")
    for m, pattern, event in reversed(fixed.ROUTES):
        out = F.when((F.upper(method) == m) & path.rlike(pattern), event).otherwise(out)
    return out


def telemetry(requests: DataFrame) -> DataFrame:
    """Events of requests (ts, done, method, path, status_code, user_id, client_ip, user_agent, response_size), but for skipped and unknown paths."""
    skipped = F.lit(False)
    for prefix in fixed.SKIPPED_PATHS:
        skipped = skipped | F.col("path").startswith(prefix)
    ms = ((F.unix_micros(F.col("done").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000).cast("double")
    rows = requests.where(~skipped).withColumns({"event_type": route_event(F.col("method"), F.col("path")), "latency_ms": F.bround(ms, 2)}).where("event_type is not null")
    payload = F.create_map(*[x for c in ("method", "path", "status_code", "latency_ms", "user_id", "client_ip", "user_agent", "response_size") for x in (F.lit(c), F.col(c).cast("string"))])
    return rows.select(F.col("ts").alias("timestamp"), "event_type", "user_id", F.col("status_code").cast("int").alias("status_code"), "latency_ms", "path", payload.alias("payload"))


def login_blocks(attempts: DataFrame, seconds: int = 300, most: int = 8) -> DataFrame:
    """attempts (ip, username, ts, attempt_id, success) with failures and blocked, by event time.

    failures: those of the last `seconds` since the key's last success, to the nearest second; from `most` on, an attempt is
    blocked. Attempts of one second and one id do not count each other.
    """
    key = ["ip", "username"]
    order = Window.partitionBy(*key).orderBy("ts", "attempt_id")
    cleared = F.coalesce(F.sum(F.col("success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = attempts.withColumn("_round", cleared).withColumn("_t", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")).withColumn("_fail", (~F.col("success")).cast("int"))
    recent = Window.partitionBy(*key, "_round").orderBy("_t").rangeBetween(-seconds, 0)
    same = Window.partitionBy(*key, "_round", "_t").orderBy("attempt_id").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    failures = F.sum("_fail").over(recent) - F.sum("_fail").over(same)  # those before this attempt
    rows = rows.withColumn("failures", F.coalesce(failures, F.lit(0)))
    return rows.withColumn("blocked", F.col("failures") >= most).drop("_round", "_t", "_fail")
