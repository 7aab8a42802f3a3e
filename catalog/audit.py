"""Audit log and rate limits, batch and streaming (G, W6, A12, S8, R2, R3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import corpus
from catalog.base import block, query, quoted, settings, sql, state_partitions
from catalog.maintain import shown, shown_sql
from seekspan.functions import fixed, text
from seekspan.operators import audit, ratelimit
from seekspan.session import scratch_dir
from seekspan.sources import tables
from seekspan.streaming.audit import stream_audit, stream_failures
from seekspan.streaming.index import file_stream

# Failures are sparse in the given events, so the windows are long here; the defaults are a minute.
WEEK = 7 * 24 * 3600
GATE = 3


@query("g1_format_audit", sql('SELECT line FROM audit_full', "audit_full"))
def g1(spark, d):
    return audit.format_audit(corpus.audit_events(spark, d), ["repo", "files", "user"]).select("line")


PARSED_SQL = 'stamp AS ts, op, repo, files, "user", line AS raw'


def parsed(df):
    kv = lambda k: F.get(F.array(F.col("kv")[k]), F.lit(0)).alias(k)
    return df.select(shown("ts"), "op", kv("repo"), kv("files"), kv("user"), "raw")


@query("g2_parse_audit", sql(f"SELECT {PARSED_SQL} FROM audit_parsed", "audit_parsed"))
def g2(spark, d):
    return parsed(audit.parse_audit(corpus.audit_lines(spark, d)))


@query(
    "g3_shorten_query",
    "SELECT item_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS query FROM benchmark",
)
def g3(spark, d):
    return corpus.table(spark, d, "benchmark").select("item_id", text.shorten_query("text").alias("query"))


VALID_SQL = f"coalesce(op IN ({quoted(fixed.AUDIT_OPS)}), false)"


@query(
    "g4_known_operations",
    sql(f"SELECT CASE WHEN {VALID_SQL} THEN 'ok' ELSE 'rejected' END AS part, line AS raw FROM audit_parsed", "audit_parsed"),
)
def g4(spark, d):
    ok, rejected = audit.split_valid(audit.parse_audit(corpus.audit_lines(spark, d)))
    return ok.select(F.lit("ok").alias("part"), "raw").union(rejected.select(F.lit("rejected").alias("part"), "raw"))


@query(
    "a12_audit_counts",
    sql(
        f"SELECT substr(stamp, 1, 10) AS day, op, count(*) AS events FROM audit_parsed WHERE {VALID_SQL} GROUP BY ALL",
        "audit_parsed",
    ),
)
def a12(spark, d):
    ok, _ = audit.split_valid(audit.parse_audit(corpus.audit_lines(spark, d)))
    return audit.audit_counts(ok)


RETAINED_DAYS = 20


@query(
    "s8_audit_log",
    sql(
        f"""SELECT strftime(ts, '%Y-%m-%d') AS day, line FROM audit_full
  WHERE ts::DATE >= (SELECT max(ts)::DATE FROM audit_full) - {RETAINED_DAYS}""",
        "audit_full",
    ),
)
def s8(spark, d):
    """Written by day with gzip, read back, and cut to the retention period."""
    path = scratch_dir(spark, "audit")
    lines = audit.format_audit(corpus.audit_events(spark, d), ["repo", "files", "user"])
    tables.write_audit(lines, path)
    newest = lines.agg(F.max("ts").alias("now")).first()["now"]
    return tables.retain(tables.read_audit_lines(spark, path), F.lit(newest), RETAINED_DAYS).select("day", "line")


@query(
    "s8_expire",
    sql(
        f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS lines FROM audit_full
  WHERE ts::DATE >= (SELECT max(ts)::DATE FROM audit_full) - {RETAINED_DAYS} GROUP BY 1""",
        "audit_full",
    ),
)
def s8_expire(spark, d):
    """The days that are left in storage after expired ones have been deleted."""
    path = scratch_dir(spark, "audit")
    lines = audit.format_audit(corpus.audit_events(spark, d), ["repo", "files", "user"])
    tables.write_audit(lines, path)
    tables.expire(spark, path, lines.agg(F.max("ts").alias("now")).first()["now"], RETAINED_DAYS)
    return tables.read_audit_lines(spark, path).groupBy("day").agg(F.count(F.lit(1)).alias("lines"))


block(
    "failures",
    f"""SELECT a.ip, a.ts, a.event_id, count(*)::INT AS failures FROM attempts a
  JOIN attempts b ON b.ip = a.ip AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL {WEEK} SECOND GROUP BY ALL""",
    "attempts",
)


@query("w6_failure_counts", sql("SELECT ip, event_id, failures FROM failures", "failures"))
def w6(spark, d):
    return ratelimit.failure_counts(corpus.attempts(spark, d), WEEK).select("ip", "event_id", "failures")


@query(
    "w6_failure_counts_hot_key",
    """WITH a AS (SELECT event_id, ts, value, 'all' AS ip FROM events)
SELECT event_id, (SELECT count(*) FROM a b WHERE b.ts <= a.ts AND b.ts > a.ts - INTERVAL 3600 SECOND)::INT AS failures FROM a""",
)
def w6_hot(spark, d):
    """All events under one key, in a window of an hour: the key is spread over its hours."""
    one = corpus.table(spark, d, "events").select(F.lit("all").alias("ip"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return ratelimit.failure_counts(one, 3600).select("event_id", "failures")


@query(
    "g5_first_alert",
    sql(
        f"""SELECT ip, {shown_sql("min(ts)", "alert_at")}, arg_min(failures, ts) AS failures FROM failures
  WHERE failures >= {GATE} GROUP BY ip""",
        "failures",
    ),
)
def g5(spark, d):
    rows = ratelimit.first_alert(corpus.attempts(spark, d), GATE, WEEK)
    return rows.withColumn("alert_at", F.date_format("alert_at", "yyyy-MM-dd HH:mm:ss"))


def gate_sql(source: str, reset: str) -> str:
    """Admission per attempt: a recursion over each key's attempts whose state is the list of recorded times."""
    kept = f"[r for r in recent if r > o.t - {WEEK * 1_000_000}]"
    block(
        f"ordered_{source}",
        f"""SELECT ip, event_id, epoch_us(ts) AS t, {reset} AS reset,
  row_number() OVER (PARTITION BY ip ORDER BY ts, event_id) AS n FROM {source}""",
        source,
    )
    block(
        f"walk_{source}",
        f"""SELECT ip, event_id, n, true AS admitted, CASE WHEN reset THEN []::BIGINT[] ELSE [t] END AS recent
    FROM ordered_{source} WHERE n = 1
  UNION ALL
  SELECT o.ip, o.event_id, o.n, len({kept}) < {GATE},
    CASE WHEN len({kept}) >= {GATE} THEN {kept} WHEN o.reset THEN []::BIGINT[] ELSE list_append({kept}, o.t) END
  FROM walk_{source} w JOIN ordered_{source} o ON o.ip = w.ip AND o.n = w.n + 1""",
        f"ordered_{source}",
    )
    return sql(f"SELECT ip, event_id, admitted FROM walk_{source}", f"walk_{source}")


@query("g6_rate_gate", gate_sql("attempts", "false"))
def g6(spark, d):
    return ratelimit.rate_gate(corpus.attempts(spark, d), GATE, WEEK).select("ip", "event_id", "admitted")


block(
    "mixed_attempts",
    """SELECT '10.0.0.' || user_id AS ip, ts, event_id, event_type = 'signup' AS success FROM events""",
)


@query("g7_reset_after_success", gate_sql("mixed_attempts", "success"))
def g7(spark, d):
    """All events as attempts; a signup is a success and clears the key."""
    rows = corpus.table(spark, d, "events").select(
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.when(F.col("event_type") == "signup", "success").otherwise("failure").alias("kind"),
    )
    return ratelimit.rate_gate(rows, GATE, WEEK).select("ip", "event_id", "admitted")


# --- streams -----------------------------------------------------------------------------------------------------------


def drain(stream, spark, name, mode="append"):
    """Run a streaming query to its end into a Parquet table."""
    out = scratch_dir(spark, name)
    with settings(spark, **state_partitions(spark)):
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option(
            "checkpointLocation", scratch_dir(spark, "progress")
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("r2_stream_audit", sql(f"SELECT {PARSED_SQL} FROM audit_parsed WHERE {VALID_SQL}", "audit_parsed"))
def r2(spark, d):
    """Audit lines arrive as text files; the parsed lines of known operations are read back."""
    inbox, out = scratch_dir(spark, "inbox"), scratch_dir(spark, "audit")
    corpus.audit_lines(spark, d).select("line").write.text(inbox)
    lines = spark.readStream.text(inbox).select(F.col("value").alias("line"))
    stream_audit(lines, out, scratch_dir(spark, "progress")).awaitTermination()
    stored = spark.read.schema(f"{audit_schema()}, day string").parquet(out)
    return parsed(stored.filter(F.col("day") != "rejected"))


def audit_schema() -> str:
    return "ts timestamp, op string, kv map<string,string>, raw string"


def live_attempts(spark, d):
    events = file_stream(spark, d, corpus.table(spark, d, "events"), "events.parquet")
    return events.filter(F.col("event_type") == "error").select(
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def window_columns(df):
    return df.select("ip", shown("window_start"), shown("window_end"), "failures")


# windows are final once they end before the newest event minus the allowed delay (in milliseconds)
CLOSED_SQL = "window_end <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) FROM attempts) - INTERVAL 10 MINUTE"


@query(
    "r3_stream_failures",
    sql(
        f"""SELECT ip, {shown_sql("window_start")}, {shown_sql("window_end")}, failures FROM (
  SELECT ip, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
    count(*) AS failures FROM attempts GROUP BY ALL) WHERE {CLOSED_SQL}""",
        "attempts",
    ),
)
def r3(spark, d):
    return window_columns(drain(stream_failures(live_attempts(spark, d), "1 day"), spark, "failures"))


@query(
    "r3_stream_failures_sliding",
    sql(
        f"""SELECT ip, {shown_sql("window_start")}, {shown_sql("window_end")}, failures FROM (
  SELECT ip, window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS failures FROM (
    SELECT ip, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * unnest(range(4))) AS window_start FROM attempts)
  GROUP BY ALL) WHERE {CLOSED_SQL}""",
        "attempts",
    ),
)
def r3_sliding(spark, d):
    return window_columns(drain(stream_failures(live_attempts(spark, d), "1 day", "6 hours"), spark, "failures"))


@query(
    "r3_stream_failures_session",
    sql(
        f"""SELECT ip, {shown_sql("window_start")}, {shown_sql("window_end")}, failures FROM (
  SELECT ip, min(ts) AS window_start, max(ts) + INTERVAL 1 DAY AS window_end, count(*) AS failures FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY ip ORDER BY ts, event_id) AS session FROM (
      SELECT *, (coalesce(ts >= lag(ts) OVER (PARTITION BY ip ORDER BY ts, event_id) + INTERVAL 1 DAY, true))::INT AS fresh
      FROM attempts)) GROUP BY ip, session) WHERE {CLOSED_SQL}""",
        "attempts",
    ),
)
def r3_session(spark, d):
    return window_columns(drain(stream_failures(live_attempts(spark, d), "1 day", session=True), spark, "failures"))


@query("g6_stream_gate", gate_sql("attempts", "false"))
def g6_stream(spark, d):
    """The gate as keyed state over the event stream."""
    from seekspan.streaming.gate import stream_gate

    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    options = {"spark__sql__streaming__stateStore__providerClass": rocks, "spark__sql__streaming__noDataMicroBatches__enabled": "false"}
    with settings(spark, **options):
        rows = drain(stream_gate(live_attempts(spark, d), GATE, WEEK), spark, "gate")
    return rows.select("ip", "event_id", "admitted")
