"""Queries on sessions, usage, streams, image references and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import manifest, service
from ..sources import tables
from ..streaming import locks, usage
from .lineage import checkpoint_dir
from .registry import query, table

NOW = "timestamp '2024-01-10 00:00:00'"


def heartbeats(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("api_key_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "event_type", "value")


def _sessions(spark, d):
    h = heartbeats(spark, d)
    return h.select("id", "api_key_id", F.col("ts").alias("created_at"), F.col("ts").alias("last_heartbeat_at"), (F.col("ts") + F.expr("interval 30 days")).alias("expires_at"))


def _now(spark, d):
    """The middle of the events' time: half of the sessions have expired then."""
    r = table(spark, d, "events").agg(((F.unix_micros(F.max("ts").cast("timestamp")) + F.unix_micros(F.min("ts").cast("timestamp"))) / 2).cast("long").alias("m"))
    return F.timestamp_micros(F.lit(r.first().m)) + F.expr("interval 30 days")


_MID = "(select make_timestamp(((epoch_us(max(ts)) + epoch_us(min(ts))) // 2)::bigint) + interval 30 days from events)"


@query("session_latest", f"select api_key_id, id from (select user_id as api_key_id, event_id as id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where ts + interval 30 days > {_MID}) where k = 1")
def _(spark, d):
    return service.latest_session(_sessions(spark, d), _now(spark, d)).select("api_key_id", "id")


@query("session_live", f"select event_id as id from events where ts + interval 30 days > {_MID}")
def _(spark, d):
    return service.purge_expired(_sessions(spark, d), _now(spark, d)).select("id")


@query("valid_keys", "select event_id from events where user_id % 3 = 0 and user_id % 2 = 0")
def _(spark, d):
    e = table(spark, d, "events")
    secret = F.format_string("k%06d-secret", F.col("user_id").cast("int"))
    keys = e.select("user_id").distinct().select(F.substring(secret, 1, 8).alias("key_prefix"), F.sha2(secret, 256).alias("key_hash"), F.when(F.col("user_id") % 3 == 0, "active").otherwise("revoked").alias("status"), F.when(F.col("user_id") % 2 == 1, F.lit("2000-01-01").cast("timestamp")).alias("expires_at"))
    return service.valid_keys(e.select("event_id", secret.alias("secret")), keys, F.lit("2024-01-01").cast("timestamp")).select("event_id")


_ISLANDS = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hours then 0 else 1 end as new from events),
i as (select user_id, ts, sum(new) over (partition by user_id order by ts) as i from g)
select user_id as api_key_id, epoch_us(min(ts))::bigint as start_us, epoch_us(max(ts) + interval 6 hours)::bigint as end_us, count(*)::bigint as beats from i group by user_id, i"""


def _micros(df):
    return df.select("api_key_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "beats")


@query("heartbeat_sessions", _ISLANDS)
def _(spark, d):
    return _micros(service.sessions(heartbeats(spark, d), "api_key_id", "ts", "6 hours"))


def _log(spark, d):
    path = F.element_at(F.create_map(*(F.lit(x) for kv in (("view", "/viz/aggregate"), ("click", "/stat/run"), ("purchase", "/ml/run")) for x in kv)), F.col("event_type"))
    return heartbeats(spark, d).select("id", "api_key_id", F.col("ts").alias("created_at"), F.coalesce(path, F.lit("/api/x")).alias("endpoint"), F.when(F.col("id") % 11 == 0, 500).otherwise(200).alias("status_code"), (F.col("id") % 97).cast("int").alias("response_time_ms"))


_ROLLUP = "select case event_type when 'view' then 'viz.aggregate' when 'click' then 'stat' when 'purchase' then 'ml' else 'api' end as feature, epoch_us(time_bucket(interval 1 hour, ts))::bigint as start_us, count(*)::bigint as requests, count(*) filter (event_id % 11 = 0)::bigint as errors, round(avg(event_id % 97), 6) as mean_ms from events group by all"


def _hours(df):
    return df.select("feature", F.unix_micros("start").alias("start_us"), "requests", "errors", F.round("mean_ms", 6).alias("mean_ms"))


@query("usage_rollup", _ROLLUP)
def _(spark, d):
    return _hours(service.usage_rollup(_log(spark, d), window="1 hour"))


@query("over_limit", "select user_id as api_key_id, 'day' as period, epoch_us(date_trunc('day', ts)::timestamp)::bigint as start_us, count(*)::bigint as n from events group by all having count(*) > 2")
def _(spark, d):
    return service.over_limit(_log(spark, d), "api_key_id", "created_at", 60, 2).select("api_key_id", "period", F.unix_micros("start").alias("start_us"), "n")


@query("latest_rows", "select event_id as id from events order by ts desc, event_id desc limit 200")
def _(spark, d):
    return service.latest_rows(_log(spark, d), "created_at", "id").select("id")


def _streamed(spark, frame, time):
    """frame as a stream of files, and one late row that moves the watermark past all of it."""
    folder = f"{checkpoint_dir(spark)}/source-{uuid.uuid4().hex}"
    frame.repartitionByRange(4, time).write.parquet(folder)
    last = frame.orderBy(F.desc(time)).limit(1).withColumn(time, F.col(time) + F.expr("interval 3650 days"))
    last.write.mode("append").parquet(folder)
    return usage.read_stream(spark, folder, frame.schema, 1000)


@query("stream_sessions", _ISLANDS)
def _(spark, d):
    h = heartbeats(spark, d).select("api_key_id", "ts")
    return _micros(usage.drained(usage.session_stream(_streamed(spark, h, "ts"), "api_key_id", "ts", "6 hours", "7 hours")))


@query("stream_usage", _ROLLUP)
def _(spark, d):
    return _hours(usage.drained(usage.usage_stream(_streamed(spark, _log(spark, d), "created_at"), window="1 hour")))


@query("manifest_features", r"select page_id, 'remote' as kind, regexp_extract(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '[^/.][^/]*\.([^./]*)$', 1) as ext, length(url)::int as ref_len, length(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1))::int as basename_len from pages")
def _(spark, d):
    return manifest.manifest_features(table(spark, d, "pages").select("page_id", "url"), "url").select("page_id", "kind", "ext", "ref_len", "basename_len")


@query("manifest_hashes", "with h as (select page_id, sha1(trim(url)) as h from pages) select page_id, round(('0x' || h[1:8])::bigint / 4294967295.0, 6) as hash_0, round(('0x' || h[9:16])::bigint / 4294967295.0, 6) as hash_1 from h")
def _(spark, d):
    return manifest.manifest_features(table(spark, d, "pages").select("page_id", "url"), "url").select("page_id", "hash_0", "hash_1")


@query("manifest_summary", "select count(*)::bigint as \"references\", 0::bigint as processed, count(*)::bigint as fallback, 0::bigint as failed, 0::double as mean_byte_size, round(avg(length(url)), 6) as mean_ref_len from pages")
def _(spark, d):
    f = manifest.manifest_summary(manifest.manifest_features(table(spark, d, "pages").select("page_id", "url"), "url"))
    return f.select("references", "processed", "fallback", "failed", "mean_byte_size", F.round("mean_ref_len", 6).alias("mean_ref_len"))


@query("label_counts", "select trim(lang) as label, count(*)::bigint as count from documents where trim(lang) <> '' group by 1")
def _(spark, d):
    return manifest.label_counts(table(spark, d, "documents"), "lang")


@query("text_summary", r"select count(*)::bigint as rows, count(nullif(trim(text), ''))::bigint as extracted, round(avg(length(trim(text))) filter (trim(text) <> ''), 3) as mean_length, round(avg(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda t: t <> ''))) filter (trim(text) <> ''), 3) as mean_tokens from documents")
def _(spark, d):
    return manifest.text_summary(table(spark, d, "documents"), "text")


_LOCKS = """with recursive h as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (select user_id, event_id, k, event_type as owner, ts + interval 12 hours as expires, false as locked from h where k = 1
union all select h.user_id, h.event_id, h.k, case when l.locked then s.owner else h.event_type end, case when l.locked then s.expires else h.ts + interval 12 hours end, l.locked
from s join h on h.user_id = s.user_id and h.k = s.k + 1, lateral (select h.ts < s.expires and h.event_type <> s.owner as locked) l)
select event_id as id, locked from s"""


@query("usage_appended", "select strftime(ts::date, '%Y-%m-%d') as day, count(*)::bigint as requests, count(distinct event_id)::bigint as ids from events group by 1")
def _(spark, d):
    folder = f"{checkpoint_dir(spark)}/usage-{uuid.uuid4().hex}"
    log = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"))
    for own in (F.col("event_type") == "click", F.coalesce(F.col("event_type") != "click", F.lit(True))):
        tables.append_usage(log.where(own), folder)
    stored = spark.read.parquet(folder)
    return stored.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("event_id").alias("ids"))


@query("stream_locks", _LOCKS)
def _(spark, d):
    h = heartbeats(spark, d).select("api_key_id", "event_type", "ts", "id")
    found = usage.drained(locks.lock_stream(_streamed(spark, h, "ts"), "api_key_id", "event_type", "ts", "id", 12 * 3600))
    return found.where("event = 'heartbeat'").select("id", "locked")


@query("session_locks", _LOCKS)
def _(spark, d):
    return service.session_locks(heartbeats(spark, d), "api_key_id", "event_type", "ts", "id", 12 * 3600).select("id", "locked")


@query("inline_images", "select page_id, 'inline' as kind, 'png' as ext, strlen('data' || page_id)::int as byte_size from pages")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("data:image/png;base64,"), F.base64(F.concat(F.lit("data"), "page_id").cast("binary"))).alias("ref"))
    return manifest.manifest_features(p, "ref").select("page_id", "kind", "ext", "byte_size")


@query("image_sizes", "select page_id, page_id::int as width, 10::int as height, round(page_id / 10.0, 6)::double as aspect from pages where page_id > 0 union all select page_id, 0, 10, 0 from pages where page_id = 0")
def _(spark, d):
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("page_id"), 8, "0"), F.lit("0000000A"))
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("data:image/png;base64,"), F.base64(F.unhex(head))).alias("ref"))
    return manifest.manifest_features(p, "ref").select("page_id", "width", "height", "aspect")


@query("filename_text", r"with b as (select page_id, regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) as f from pages) select page_id, trim(regexp_replace(case when f like '_%.%' then regexp_replace(f, '\.[^.]*$', '') else f end, '[_.-]+', ' ', 'g')) as text from b")
def _(spark, d):
    return manifest.reference_text(table(spark, d, "pages"), "url").select("page_id", "text")


@query("top_tokens", r"select t as token, count(*)::bigint as n from (select unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+')) as t from documents) where t <> '' group by 1 order by 2 desc, 1 limit 8")
def _(spark, d):
    return manifest.top_tokens(table(spark, d, "documents"), "text")
