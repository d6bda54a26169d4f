"""Sessions, errors, feedback and users as tables: changes are DataFrame to DataFrame, so any table format can hold them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.operators.restore import scanner
from veilstream.sources.tables import rewrite_buckets, settled, touched

#: Columns of a session that an update never changes.
FIXED_COLUMNS = ("user_id", "locale", "created_at")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], fixed: tuple[str, ...] = FIXED_COLUMNS, order: str | None = None) -> DataFrame:
    """table with changes: new keys are added, known ones replaced but for their fixed columns. Of several changes of a key the last by `order` counts."""
    new = latest(changes, keys, order) if order else changes
    new = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_hit"))
    rows = table.withColumn("_old", F.lit(True)).join(new, keys, "full")

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in fixed:
            return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return rows.select(*[column(c) for c in table.columns])


def upsert_bucketed(path: str, changes: DataFrame, keys: list[str], buckets: int, fixed: tuple[str, ...] = FIXED_COLUMNS, order: str | None = None) -> list[int]:
    """upsert() into a table that write_bucketed() has written: only the buckets that hold keys of changes are read and rewritten. Returns them.

    changes are settled first, as they are read for the buckets and for the rows, and may come from the table itself.
    """
    new = settled(changes)
    which = touched(new, keys, buckets)
    rewrite_buckets(changes.sparkSession, path, keys, buckets, which, lambda rows: upsert(rows, new, keys, fixed, order))
    return which


def load_session(table: DataFrame, session_id: str, user_id: str | None, now: dt.datetime, hours: int) -> DataFrame:
    """A session of its owner that has not run out."""
    rows = table.where((F.col("session_id") == session_id) & (F.lit(now) - F.col("created_at") <= F.expr(f"INTERVAL {int(hours)} HOURS")))
    return rows if user_id is None else rows.where(F.col("user_id") == user_id)


def list_sessions(table: DataFrame, user_id: str | None = None, blobs: tuple[str, ...] = ("docx", "response_docx", "registry"), counts: DataFrame | None = None) -> DataFrame:
    """Sessions, newest first, their large columns only as has_…; counts (session_id, entity_count) of live ones, else 0."""
    rows = table if user_id is None else table.where(F.col("user_id") == user_id)
    rows = rows.select(*[F.col(c).isNotNull().alias(f"has_{c}") if c in blobs else c for c in table.columns])
    if counts is not None:
        rows = rows.join(counts.select("session_id", F.col("entity_count").alias("_n")), "session_id", "left").withColumn("entity_count", F.coalesce("_n", F.lit(0))).drop("_n")
    return rows.orderBy(F.desc("created_at"), "session_id")


def close(table: DataFrame, closed: DataFrame, owners: bool = True) -> DataFrame:
    """table without closed (session_id, user_id); another owner's sessions stay."""
    return table.join(closed, ["session_id", *(["user_id"] if owners else [])], "left_anti").select(*table.columns)


def close_user(table: DataFrame, user_id: str) -> DataFrame:
    return table.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def prune(table: DataFrame, time: str, now: dt.datetime, days: int) -> DataFrame:
    """Rows of the last `days` days."""
    return table.where(F.col(time) >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))


def reset_workflow(table: DataFrame, derived: tuple[str, ...]) -> DataFrame:
    """table with columns that follow from a document set to null, as when a new one is attached."""
    return table.withColumns({c: F.lit(None).cast(dict(table.dtypes)[c]) for c in derived})


def migrate(table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """table with the columns that a newer schema adds."""
    return table.withColumns({c: v for c, v in defaults.items() if c not in table.columns})


def workflow_stage(table: DataFrame) -> DataFrame:
    """The stage of each session, taken back to the last one whose results are there."""
    done = F.when(F.col("has_restored"), 4).when(F.col("has_response"), 3).when(F.col("has_anonymized"), 2).when(F.col("has_document"), 1).otherwise(0)
    return table.withColumn("stage", F.least(F.coalesce("stage", F.lit(0)), done))


def query(table: DataFrame, time: str, newest: str, limit: int | None = None, since=None, until=None, **equal) -> DataFrame:
    """Rows by time range and equal columns (None: any), newest first. A limit belongs to a page; None reads on."""
    rows = table
    if since is not None:
        rows = rows.where(F.col(time) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(time) <= F.lit(until))
    for c, v in equal.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    rows = rows.orderBy(F.desc(newest))
    return rows if limit is None else rows.limit(limit)


def page(table: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of table with the total number of rows."""
    total = table.agg(F.count(F.lit(1)).alias("total"))
    return table.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def severities(errors: DataFrame, since) -> DataFrame:
    return errors.where(F.col("timestamp") >= F.lit(since)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


ERRORS = "error_id string, timestamp timestamp, user_id string, session_id string, page_url string, message string, stack string, user_agent string, severity string"


def append_errors(errors: DataFrame, new: DataFrame, now: dt.datetime) -> DataFrame:
    """errors with reports of clients and servers: message is needed, other columns may be missing or null; severity is error unless it says warning."""
    have = set(new.columns)
    severity = F.when(F.col("severity") == "warning", "warning").otherwise("error") if "severity" in have else F.lit("error")
    given = {"error_id": F.uuid(), "timestamp": F.lit(now), "severity": severity}
    rows = new.where("message is not null")
    return errors.unionByName(rows.select(*[given.get(n, F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in ERRORS.split(", "))]))


def stored_spans(sessions: DataFrame) -> DataFrame:
    """(session_id, text, entities, stats) of sessions with a stored result: its spans, and how many there are of each type."""
    spans = F.from_json("entities_json", "array<struct<text:string,entity_type:string,start:int,end:int,score:double>>")
    rows = sessions.withColumn("entities", spans).where("anonymized_text <> '' and size(entities) > 0")
    types = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["entity_type"])))
    count = lambda t: F.size(F.filter("entities", lambda e: e["entity_type"] == t))
    return rows.select("session_id", F.col("anonymized_text").alias("text"), "entities", F.map_from_arrays(types, F.transform(types, count)).alias("stats"))


def import_responses(sessions: DataFrame, responses: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """sessions with a model's text from responses (session_id, text), its length and placeholders; results of an earlier one go."""
    new = responses.select("session_id", F.col("text").alias("_t"), F.char_length("text").alias("_n"), F.regexp_count("text", F.lit(scanner(labels))).alias("_p"))
    rows = sessions.drop("char_count", "placeholder_count").join(new, "session_id", "left")
    hit = F.col("_t").isNotNull()
    reset = {c: F.when(~hit, F.col(c)) for c in ("result_json", "resolutions_json") if c in sessions.columns}
    return rows.withColumns({"response_text": F.coalesce("_t", "response_text"), "char_count": F.col("_n"), "placeholder_count": F.col("_p"), **reset}).drop("_t", "_n", "_p")


def error_source(errors: DataFrame) -> DataFrame:
    """errors with `source`: server for paths under /api, else client."""
    return errors.withColumn("source", F.when(F.coalesce("path", F.lit("")).startswith("/api"), "server").otherwise("client"))


def feedback_state(submitted: DataFrame, updates: DataFrame) -> DataFrame:
    """Feedback with its last reply and status; updates (feedback_id, reply, status, at) are a log, nulls change nothing."""
    last = updates.groupBy("feedback_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in ("reply", "status")], F.max(F.when(F.col("reply").isNotNull(), F.col("at"))).alias("reply_at"))
    rows = submitted.join(last, "feedback_id", "left")
    return rows.select(*submitted.columns, F.col("_reply").alias("reply"), F.coalesce("_status", F.lit("new")).alias("status"), "reply_at")


def unread_replies(feedback: DataFrame, seen) -> DataFrame:
    return feedback.where(F.col("reply_at") > F.lit(seen)).agg(F.count(F.lit(1)).alias("unread"))


def screenshots(feedback: DataFrame, most: int = 5 * 1024 * 1024) -> DataFrame:
    """feedback with `screenshot` decoded from base64; malformed and larger ones are null."""
    blob = F.try_to_binary("screenshot", F.lit("base64"))
    return feedback.withColumn("screenshot", F.when(F.octet_length(blob) <= most, blob))


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json) with binary columns in base64."""
    cols = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.col(key), F.to_json(F.struct(*cols)).alias("json"))


def create_session(table: DataFrame, new: DataFrame, now: dt.datetime, models_allowed: bool = True) -> DataFrame:
    """table with new sessions (user_id, locale): random ids, created now, without a model's layer where models are switched off."""
    fresh = new.select(F.uuid().alias("session_id"), *new.columns, F.lit(now).alias("created_at"), F.lit(models_allowed).alias("models_allowed"))
    return table.unionByName(fresh, allowMissingColumns=True)


RESULT = "text string, resolved array<struct<placeholder:string,value:string>>, unresolved array<string>"
RESOLUTIONS = "array<struct<placeholder:string,value:string>>"


def stored_results(sessions: DataFrame) -> DataFrame:
    """sessions with `result` and `resolutions` read from result_json and resolutions_json: null and empty where those are malformed."""
    result = F.from_json("result_json", RESULT)
    given = F.filter(F.from_json("resolutions_json", RESOLUTIONS), lambda r: r["placeholder"].isNotNull() & r["value"].isNotNull())
    return sessions.withColumns({"result": F.when(result["text"].isNotNull(), result), "resolutions": F.coalesce(given, F.array().cast(RESOLUTIONS))})


def upload(current: DataFrame, added: DataFrame, mode: str) -> DataFrame:
    """The files (session_id, n, name, text) of sessions after an upload: added ones in place of, or behind, the present ones."""
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "replace":
        return current.join(added.select("session_id").distinct(), "session_id", "left_anti").select(*current.columns).unionByName(added)
    last = current.groupBy("session_id").agg((F.max("n") + 1).alias("_from"))
    moved = added.join(last, "session_id", "left").withColumn("n", F.col("n") + F.coalesce("_from", F.lit(0)))
    return current.unionByName(moved.select(*current.columns))


def change_users(users: DataFrame, changes: DataFrame, admin: str) -> tuple[DataFrame, DataFrame]:
    """users after changes (user_id, action, role, is_active, email, display_name), and the refused changes with `error`.

    action is create, update or delete; null values change nothing. An admin cannot disable, demote or delete the own
    account; unknown users are not updated or deleted and known names not created again. One change a user.
    """
    known = users.select(F.col("user_id").alias("_id"), F.lit(True).alias("_known"))
    own = F.col("user_id") == admin
    error = (
        F.when(own & (F.col("action") == "update") & ~F.coalesce("is_active", F.lit(True)), "cannot disable the own account")
        .when(own & (F.col("action") == "update") & (F.coalesce("role", F.lit("admin")) != "admin"), "cannot give up the own admin role")
        .when(own & (F.col("action") == "delete"), "cannot delete the own account")
        .when((F.col("action") == "create") & F.col("_known").isNotNull(), "user exists")
        .when((F.col("action") != "create") & F.col("_known").isNull(), "no such user")
    )
    judged = changes.join(known, F.col("user_id") == F.col("_id"), "left").withColumn("error", error).drop("_id", "_known")
    good = judged.where("error is null")
    set_ = good.where("action = 'update'").select("user_id", *[F.col(c).alias(f"_{c}") for c in ("role", "is_active", "email", "display_name")])
    rows = users.join(good.where("action = 'delete'").select("user_id"), "user_id", "left_anti").join(set_, "user_id", "left")
    rows = rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("role", "is_active", "email", "display_name") else c for c in users.columns])
    fresh = good.where("action = 'create'").select(*[c for c in users.columns if c in good.columns]).withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    return rows.unionByName(fresh, allowMissingColumns=True), judged.where("error is not null")


def find_user(users: DataFrame, name: str) -> DataFrame:
    return users.where(F.lower("username") == name.lower())


def sync_directory(users: DataFrame, directory: DataFrame) -> DataFrame:
    """users with directory (dn, username, email, display_name): the user of that dn, else of that name in any case, is updated; others are added.

    Of several entries for one user that of the user's own dn holds, else that of the least dn.
    """
    d = directory.select(F.col("dn").alias("_dn"), F.col("username").alias("_name"), F.col("email").alias("_email"), F.col("display_name").alias("_shown"))
    by_dn = users.select("user_id", F.col("ldap_dn").alias("_dn")).where("_dn is not null")
    by_name = users.select(F.col("user_id").alias("_id"), F.lower("username").alias("_low"))
    hits = d.join(by_dn, "_dn", "left").join(by_name, F.lower("_name") == F.col("_low"), "left").withColumn("_to", F.coalesce("user_id", "_id"))
    one = hits.where("_to is not null").groupBy("_to").agg(F.min(F.struct(F.col("user_id").isNull().alias("_by_name"), "_dn", "_name", "_email", "_shown")).alias("_e"))
    known = users.join(one.select(F.col("_to").alias("user_id"), "_e.*"), "user_id", "left")
    pick = {"ldap_dn": "_dn", "email": "_email", "display_name": "_shown"}
    updated = known.select(*[F.coalesce(pick[c], c).alias(c) if c in pick else c for c in users.columns])
    fresh = {"user_id": F.concat(F.lit("ldap:"), "_dn"), "username": F.col("_name"), "is_active": F.lit(True), **{k: F.col(v) for k, v in pick.items()}}
    added = hits.where("_to is null").select(*[fresh.get(c, F.lit(None)).cast(t).alias(c) for c, t in users.dtypes])
    return updated.unionByName(added)


def members(groups: DataFrame, group: str) -> DataFrame:
    """(member): everyone in a group (group, member), through groups in groups of any depth; circles end."""
    edges = groups.select(F.col("group").alias("g"), F.col("member").alias("m"))
    found = new = settled(edges.where(F.col("g") == group).select("m").distinct())
    while new.limit(1).count():
        new = settled(new.select(F.col("m").alias("g")).join(edges, "g").select("m").distinct().join(found, "m", "left_anti"))
        found = found.union(new)
    return found.select(F.col("m").alias("member"))
