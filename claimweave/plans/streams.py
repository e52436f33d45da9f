"""Streams over the event log, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import windows
from claimweave.plans import bindings as b
from claimweave.plans.catalogue import Tables, query
from claimweave.session import scratch_path
from claimweave.streaming import admission, logs, tables

WINDOW, LIMIT = 6 * 3600.0, 2


class Log(Tables):
    """Tables whose ``events`` are read as a stream."""

    @property
    def events(self) -> DataFrame:
        return logs.read_log(self.spark, self.folder, "events.parquet")


def hits(t: Tables) -> DataFrame:
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at")
    return t.events.select(F.col("user_id").alias("client"), F.col("event_id").alias("hit"), at)


@query("latest_decision_stream", "K-1", f"WITH {b.REVIEWS_SQL}, {b.LATEST_SQL} SELECT * FROM latest")
def latest_decision_stream(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "latest")
    table = tables.UpsertTable(t.spark, f"{base}/table", ["target_type", "target_id"])
    logs.run_batches(logs.latest_changes(b.reviews(Log(t.spark, t.folder))), "update", table.write, f"{base}/checkpoint")
    return table.current().drop("version")


ADMISSION_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, tm, i, [tm] AS hits, true AS admitted, CAST(0 AS BIGINT) AS wait FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, tm, i, CASE WHEN len(live) < 2 THEN list_append(live, tm) ELSE live END, len(live) < 2,
    CASE WHEN len(live) < 2 THEN 0 ELSE greatest(1, CAST(trunc(21600 - (tm - live[1])) AS BIGINT) + 1) END
  FROM (SELECT e.user_id, e.event_id, e.tm, e.i, list_filter(r.hits, lambda h: e.tm - h < 21600) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id AS client, event_id AS hit, admitted, wait FROM r"""


@query("sliding_admission_stream", "K-2", ADMISSION_SQL)
def sliding_admission_stream(t: Tables) -> DataFrame:
    stream = admission.admission_stream(hits(Log(t.spark, t.folder)), WINDOW, LIMIT)
    return logs.drain(stream, "admission").drop("at")


@query("sliding_admission_batch", "K-2", ADMISSION_SQL)
def sliding_admission_batch(t: Tables) -> DataFrame:
    return admission.admission_batch(hits(t), WINDOW, LIMIT).drop("at")


@query("hits_in_window", "K-2", """
SELECT user_id AS client, event_id AS hit, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def hits_in_window(t: Tables) -> DataFrame:
    return admission.hits_in_window(hits(t), WINDOW)


def charges(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("amount"))


SPEND_SQL = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(sum(value), 2) AS spent, round(greatest(0, 1500 - sum(value)), 2) AS remaining, sum(value) > 1500 AS over_cap,
  date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 1 DAY AS closed
FROM events WHERE event_type = 'purchase' GROUP BY date_trunc('day', ts)"""


def rounded(df: DataFrame, closed: bool) -> DataFrame:
    return df.select("day", F.round("spent", 2).alias("spent"), F.round("remaining", 2).alias("remaining"), "over_cap", F.lit(closed).alias("closed"))


@query("daily_spend_stream", "K-3", SPEND_SQL)
def daily_spend_stream(t: Tables) -> DataFrame:
    """Closed days as the ledger appended them, and the days that are still open."""
    base = scratch_path(t.spark, "spend")
    ledger = tables.DayLedger(t.spark, f"{base}/table", "1 day")
    logs.run_batches(charges(Log(t.spark, t.folder)), "append", ledger.write, f"{base}/checkpoint")
    return rounded(logs.spend_view(ledger.closed_days(), 1500.0), True).unionByName(rounded(logs.spend_view(ledger.open_days(), 1500.0), False))


@query("running_daily_spend", "K-3", """
WITH s AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, value, coalesce(sum(value) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events WHERE event_type = 'purchase')
SELECT event_id, day, round(before, 2) + 0.0 AS before, before + value <= 1500 AS within_cap FROM s""")
def running_daily_spend(t: Tables) -> DataFrame:
    rows = t.events.filter("event_type = 'purchase'").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    out = windows.running_total(rows, ["day"], "event_id", F.col("value"), "before")
    return out.select("event_id", "day", (F.round("before", 2) + F.lit(0.0)).alias("before"), (F.col("before") + F.col("value") <= 1500).alias("within_cap"))
