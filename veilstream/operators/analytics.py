"""Dashboard aggregates over sessions and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.sources.tables import settled


def date_range(since: dt.date | None, until: dt.date | None, days: int, today: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """First and last instant: the last `days` days where nothing is given; ends in the wrong order are swapped."""
    until = until or today
    since = since or until - dt.timedelta(days=days - 1)
    since, until = min(since, until), max(since, until)
    return dt.datetime.combine(since, dt.time.min), dt.datetime.combine(until, dt.time.max)


def between(rows: DataFrame, time: str, since, until) -> DataFrame:
    return rows.where(F.col(time).between(F.lit(since), F.lit(until)))


def per_day(rows: DataFrame, time: str, since, until, *more: Column) -> DataFrame:
    """(day, n, …): a row for each day of the range, also those without rows."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("day"))
    counts = between(rows, time, since, until).groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), *more)
    return spine.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def active_users(rows: DataFrame, time: str, user: str, until, days: int = 7, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    recent = F.col(time) > F.lit(until) - F.expr(f"INTERVAL {int(days)} DAYS")
    return rows.agg(count(F.when(recent & (F.col(time) <= F.lit(until)), F.col(user))).alias("active_users"))


def top_types(sessions: DataFrame, k: int = 10) -> DataFrame:
    """(entity_type, n) of the k most frequent types in entities_json; malformed JSON counts for nothing."""
    spans = F.from_json("entities_json", "array<struct<entity_type:string>>")
    return top(sessions.select(F.explode(spans).alias("s")).select("s.entity_type").where("entity_type is not null"), "entity_type", k)


def top(rows: DataFrame, column: str, k: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def ranks(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(*by, value, rank, n): a column's values but for nulls, their rank from 0 among those of equal `by`, and the number of these.

    Values are sorted over all partitions, and a value's rank is its place in its partition behind the sizes of those
    before: no task and no buffer holds all of them, also where one group has nearly all rows. The table of sizes has a
    row for each partition and each group that is in it.
    """
    values = rows.select(*by, F.col(column).cast("double").alias("value")).where("value is not null")
    order = settled(values.orderBy(*by, "value").select(*by, "value", F.monotonically_increasing_id().alias("_i")))
    order = order.withColumn("_p", F.shiftright("_i", 33)).withColumn("_i", F.col("_i").bitwiseAND(F.lit(2**33 - 1)))
    sizes = order.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    group = Window.partitionBy(*(by or (F.lit(0),)))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_{c}") for c in by], (before - F.col("_first")).alias("_from"), F.sum("_n").over(group).alias("n"))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return order.join(starts if by else F.broadcast(starts), same).select(*by, "value", (F.col("_from") + F.col("_i")).alias("rank"), "n")


def at_place(place: Column) -> Column:
    """An aggregate of ranks(): the value at a place between ranks, by linear interpolation."""
    low = F.floor(place)
    here = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))
    share = F.max(place - low)
    return here(low) + F.when(share > 0, (here(low + 1) - here(low)) * share).otherwise(F.lit(0.0))


def percentiles(rows: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """p50, p95, p99: linear interpolation, rounded half to even; 0 without values. Approximate ones need no sort."""
    names = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    if approximate:
        got = rows.agg(*[F.percentile_approx(F.col(column).cast("double"), p).alias(n) for n, p in names])
    else:
        got = ranks(rows, column).agg(*[at_place(p * (F.col("n") - 1)).alias(n) for n, p in names])
    return got.select(*[F.coalesce(F.bround(n, 0).cast("long"), F.lit(0)).alias(n) for n, _ in names])


def error_rate(status: Column) -> Column:
    """Share of statuses of 400 and more, in percent."""
    n = F.count(status)
    return F.when(n > 0, F.bround(100.0 * F.count_if(status >= 400) / n, 2)).otherwise(F.lit(0.0))


def summary(events: DataFrame, since, until) -> DataFrame:
    """For each day: requests, median and p95 latency, error rate, active users. events: timestamp, user_id, status_code, latency_ms."""
    days = per_day(events, "timestamp", since, until, error_rate(F.col("status_code")).alias("error_rate"), F.count_distinct("user_id").alias("active_users"))
    latency = ranks(between(events, "timestamp", since, until).withColumn("_day", F.to_date("timestamp")), "latency_ms", "_day")
    quantiles = latency.groupBy("_day").agg(*[F.bround(at_place(F.lit(p) * (F.col("n") - 1)), 0).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95))])
    return days.join(quantiles, F.col("day") == F.col("_day"), "left").select("day", "n", "p50", "p95", "error_rate", "active_users")


def top_endpoints(events: DataFrame, k: int = 10) -> DataFrame:
    return top(events, "path", k)


def dashboard(sessions: DataFrame, events: DataFrame, since, until) -> DataFrame:
    """One row: sessions, sessions_per_day, active_users, top_types, p50, p95, p99, error_rate. No limit on events."""
    own = between(sessions, "created_at", since, until)
    asked = between(events, "timestamp", since, until)
    days = per_day(sessions, "created_at", since, until).agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("sessions_per_day"))
    types = top_types(own).agg(F.collect_list(F.struct("entity_type", "n")).alias("top_types"))
    done = percentiles(asked.where("event_type = 'anonymize.done'"), "latency_ms")
    parts = [own.agg(F.count(F.lit(1)).alias("sessions")), days, active_users(own, "created_at", "user_id", until), types, done, asked.agg(error_rate(F.col("status_code")).alias("error_rate"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def span_counts(spans: DataFrame, *by: str) -> DataFrame:
    return spans.groupBy(*(by or ("entity_type",))).agg(F.count(F.lit(1)).alias("n"))


def grouped_spans(spans: DataFrame) -> DataFrame:
    """Types with their spans in order, the largest group first."""
    return spans.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "start", "end", "text"))).alias("spans")).orderBy(F.desc("n"), "entity_type")


def legend(types: DataFrame, first: list[str]) -> DataFrame:
    """Types in a fixed order, then the rest by name."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col("entity_type"))
    return types.select("entity_type").distinct().orderBy(F.when(place > 0, place).otherwise(F.lit(len(first) + 1)), "entity_type")
