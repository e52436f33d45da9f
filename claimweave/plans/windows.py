"""Sort-then-pick queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import web
from claimweave.operators import windows
from claimweave.plans import bindings as b
from claimweave.plans.catalogue import query
from claimweave.plans.filters import HOST_SQL


@query("latest_review", "E-1", f"WITH {b.REVIEWS_SQL}, {b.LATEST_SQL} SELECT * FROM latest")
def latest_review(t):
    return windows.latest_per_key(b.reviews(t), ["target_type", "target_id"], ["reviewed_at", "id"])


@query("effective_state", "E-2", f"WITH {b.STATES_SQL} SELECT * FROM states")
def effective_state(t):
    return windows.effective_state(b.targets(t), b.reviews(t))


@query("first_representative", "E-4", f"""WITH {b.CLAIMS_SQL}
SELECT subject, object, min(evidence) AS evidence, min_by(statement_status, evidence) AS statement_status FROM claims GROUP BY 1, 2""")
def first_representative(t):
    rows = b.claims(t).select("subject", "object", "evidence", "statement_status")
    return windows.first_per_key(rows, ["subject", "object"], ["evidence"])


@query("first_seen", "E-5", """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def first_seen(t):
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    return windows.first_per_key(rows, ["user_id", "event_type"], ["event_id"])


@query("latest_version", "E-6", f"""WITH v AS (SELECT {HOST_SQL} AS host, regexp_extract(url, '/(\\d+)', 1) AS v FROM pages)
SELECT host, max(v) AS version, CAST(max(CAST(v AS BIGINT)) AS VARCHAR) AS numeric_version FROM v WHERE v <> '' GROUP BY 1""")
def latest_version(t):
    rows = t.pages.select(web.domain(F.col("url")).alias("host"), F.regexp_extract("url", r"/(\d+)", 1).alias("v"))
    rows = rows.filter("v <> ''")
    as_text = windows.latest_version(rows, ["host"], "v")
    as_number = windows.latest_version(rows, ["host"], "v", numeric=True).withColumnRenamed("version", "numeric_version")
    return as_text.join(as_number, "host")


@query("line_numbers", "E-7", """SELECT doc_id, n AS line_number, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""")
def line_numbers(t):
    return windows.numbered_lines(t.documents, "doc_id", "text")


@query("window_numbering", "E-8", """SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1
  THEN role || '#window' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE role END AS view_id FROM conversations""")
def window_numbering(t):
    rows = t.conversations.select("conv_id", "role", "turn")
    return windows.window_names(rows, ["conv_id", "role"], "turn", F.col("role"), "view_id").select("conv_id", "turn", "view_id")


@query("best_alias", "E-9", """WITH a AS (
  SELECT 'part:' || p_partkey AS entity, p_name AS alias, CASE WHEN p_name = 'red widget' THEN 0 WHEN p_name LIKE 'red%' THEN 1 ELSE 2 END AS rank, 0 AS pos FROM part WHERE contains(p_name, 'red')
  UNION ALL SELECT 'part:' || p_partkey, p_name || ' (' || p_brand || ')', CASE WHEN p_name LIKE 'red%' THEN 1 ELSE 2 END, 1 FROM part WHERE contains(p_name, 'red'))
SELECT entity, alias, rank, pos FROM a QUALIFY row_number() OVER (PARTITION BY entity ORDER BY rank, pos) = 1""")
def best_alias(t):
    p = t.part.select(
        F.concat(F.lit("part:"), "p_partkey").alias("entity"),
        F.posexplode(F.array("p_name", F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))).alias("pos", "alias"))
    rank = F.when(F.col("alias") == "red widget", 0).when(F.col("alias").startswith("red"), 1).when(
        F.col("alias").contains("red"), 2)
    return windows.best_alias(p.withColumn("rank", rank).filter("rank is not null")).select("entity", "alias", "rank", "pos")


@query("section_offsets", "E-10", """SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(text) AS stop
FROM conversations""")
def section_offsets(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("len"))
    out = windows.running_total(rows, ["conv_id"], "turn", F.col("len") + 2, "start")
    return out.select("conv_id", "turn", "start", (F.col("start") + F.col("len")).alias("stop"))
