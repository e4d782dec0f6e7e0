"""Feature sessions over the events: users are projects, a part of the payload gives branches and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as O
from .adapter import table
from .catalog import register


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of projects with a branch (a third on a trunk, a third on none) and up to three files."""
    k = F.get_json_object("props", "$.k").cast("int")
    branch = F.when(k % 3 == 0, F.concat(F.lit("feat/"), (k % 4).cast("string"))).when(k % 3 == 1, "main")
    files = F.when(F.col("event_type").isin("view", "click"), F.array_distinct(F.transform(F.array(k % 5, k % 7, k % 4), lambda x: F.concat(F.lit("f"), x.cast("string")))))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", branch.alias("branch"), files.alias("files"))


#: One event a step and project; the state is the list of features in the order of their first events.
_FOLD = """WITH RECURSIVE k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events),
 e AS (SELECT user_id p, event_id id, epoch_us(ts) t, CASE k % 3 WHEN 0 THEN 'feat/' || (k % 4) WHEN 1 THEN 'main' END b,
  CASE WHEN event_type IN ('view', 'click') THEN list_distinct(['f' || (k % 5), 'f' || (k % 7), 'f' || (k % 4)]) ELSE [] END f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM k),
 s(p, n, o, id, feature, rule) AS (
  SELECT DISTINCT p, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, b VARCHAR, f VARCHAR[], t BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM e
  UNION ALL
  SELECT p, n, CASE WHEN c IS NULL THEN list_append(o, {'id': id, 'b': b, 'f': f, 't': t}) ELSE list_transform(o, lambda x: CASE WHEN x.id = c THEN {'id': x.id, 'b': x.b, 'f': x.f, 't': t} ELSE x END) END, id, coalesce(c, id),
   CASE WHEN c IS NULL THEN 'new' WHEN named THEN 'branch' WHEN overlapping IS NOT NULL THEN 'files' ELSE 'recent' END
  FROM (SELECT *, CASE WHEN named THEN list_filter(o, lambda x: x.b = b)[1].id ELSE coalesce(overlapping, list_filter(near, lambda x: x.t = newest)[1].id) END c
   FROM (SELECT *, list_filter(o, lambda x: len(f) > 0 AND t - x.t < 14400000000 AND len(list_intersect(f, x.f)) > 0.4 * len(list_distinct(f || x.f)))[1].id overlapping, list_max(list_transform(near, lambda x: x.t)) newest
    FROM (SELECT *, coalesce(b LIKE 'feat/%', false) named, list_filter(o, lambda x: t - x.t < 7200000000) near
     FROM (SELECT e.p, e.n, e.id, e.t, e.b, e.f, list_filter(s.o, lambda x: e.t - x.t <= 604800000000) o FROM s JOIN e ON e.p = s.p AND e.n = s.n + 1) v) w) y) z),
 a AS (SELECT p, id, feature, rule FROM s WHERE n > 0)"""


@register("feature_sessions", f"{_FOLD} SELECT p AS user_id, id AS event_id, feature, rule FROM a")
def feature_sessions(spark, d):
    """Which feature each event belongs to, and by which rule."""
    found = O.feature_sessions(work(spark, d), "user_id", "event_id", "ts", "branch", "files")
    return found.select(F.col("project").alias("user_id"), F.col("id").alias("event_id"), "feature", "rule")


@register(
    "feature_summaries",
    f"""{_FOLD}, j AS (SELECT a.p, feature, a.id, t, b, f FROM a JOIN e ON a.p = e.p AND a.id = e.id), x AS (SELECT p, feature, count(DISTINCT u) n_files FROM (SELECT p, feature, unnest(f) u FROM j) q GROUP BY 1, 2)
 SELECT g.p AS user_id, g.feature, branch, first_seen, last_seen, n_events, coalesce(n_files, 0) n_files, CASE WHEN last_seen < (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 'stale' ELSE 'active' END status
 FROM (SELECT p, feature, arg_min(coalesce(b, ''), row(t, id)) branch, make_timestamp(min(t)) first_seen, make_timestamp(max(t)) last_seen, count(*) n_events FROM j GROUP BY 1, 2) g LEFT JOIN x ON g.p = x.p AND g.feature = x.feature""",
)
def feature_summaries(spark, d):
    """Span, size and state of each feature at the newest event."""
    events = work(spark, d).withColumn("branch", F.coalesce("branch", F.lit("")))
    found = O.feature_summaries(O.feature_sessions(events, "user_id", "event_id", "ts", "branch", "files"), events.agg(F.max("ts").alias("as_of")))
    return found.withColumnRenamed("project", "user_id").withColumns({"first_seen": F.col("first_seen").cast("timestamp_ntz"), "last_seen": F.col("last_seen").cast("timestamp_ntz")})
