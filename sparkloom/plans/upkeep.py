"""Queries over the row-level operators: upserts, staleness, sequence ids, names, paths, smoothing and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..operators import scores as SC
from ..operators import statistics as ST
from ..operators import texts as TX
from ..sources import connectors, events as EV
from .adapter import exact, r, table
from .adapter import with_exact as ex
from .catalog import register
from .knowledge import TOK


@register("upserted_decisions", "SELECT o_custkey AS id, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def upserted_decisions(spark, d):
    """Rows by id, the last written."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus", "o_orderdate")
    return EV.upsert_latest(o, ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey", "o_orderstatus")


@register("sequence_ids", ex(" SELECT id, CAST(row_number() OVER (PARTITION BY session ORDER BY ts, id) - 1 AS BIGINT) AS sequence_id FROM ex"))
def sequence_ids(spark, d):
    e = exact(spark, d).withColumn("session", F.col("session").cast("string"))
    return EV.sequence_ids(e, "session", ["ts", "id"]).select("id", F.col("sequence_id").cast("long").alias("sequence_id"))


@register("stale_features", "WITH f AS (SELECT o_custkey, max(o_orderdate) last_seen FROM orders GROUP BY 1), n AS (SELECT max(o_orderdate) as_of FROM orders) SELECT o_custkey, last_seen, CASE WHEN last_seen < as_of - INTERVAL 180 DAY THEN 'stale' ELSE 'active' END AS status FROM f, n")
def stale_features(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    f = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen")).withColumn("status", F.lit("active"))
    return connectors.mark_stale(f, o.agg(F.max("o_orderdate").alias("as_of")), 180).select("o_custkey", "last_seen", "status")


@register("inverted_terms", f"WITH t AS (SELECT item_id, unnest(list_filter({TOK.format('text')}, lambda x: NOT list_contains({list(S.STOP_WORDS)}, x))) w FROM benchmark) SELECT CASE WHEN length(w) >= 4 THEN regexp_replace(w, '(?:{'|'.join(S.SUFFIXES)})$', '') ELSE w END AS term, item_id, count(*) AS tf FROM t GROUP BY 1, 2")
def inverted_terms(spark, d):
    return TX.inverted_index(table(spark, d, "benchmark"), "item_id", "text")


@register("normal_names", "SELECT trim(regexp_replace(regexp_replace(lower(trim(p_name || '  V' || p_size)), '\\s+v?[0-9]+([.][0-9]+)*$', ''), '\\s+', ' ', 'g')) AS name, count(*) n FROM part GROUP BY 1")
def normal_names(spark, d):
    name = S.normal_name(F.concat("p_name", F.lit("  V"), F.col("p_size").cast("string")))
    return table(spark, d, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


_ROOTS = [("p0", "blog"), ("p1", "m"), ("p2", "www"), ("p3", "m/en")]


@register("project_paths", "WITH p AS (SELECT DISTINCT split_part(regexp_extract(url, '://([^?#]*)', 1), '.', 1) || regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path FROM pages) SELECT path, CASE WHEN path = 'm/en' OR path LIKE 'm/en/%' THEN 'p3' WHEN path = 'm' OR path LIKE 'm/%' THEN 'p1' WHEN path = 'blog' OR path LIKE 'blog/%' THEN 'p0' WHEN path = 'www' OR path LIKE 'www/%' THEN 'p2' ELSE 'unregistered:' || path END AS project_id FROM p")
def project_paths(spark, d):
    """The project whose root is the longest prefix of a path, by whole segments."""
    host = F.split(F.regexp_extract("url", "://([^?#]*)", 1), r"\.")[0]
    paths = table(spark, d, "pages").select(F.concat(host, F.regexp_extract("url", "://[^/]*([^?#]*)", 1)).alias("path")).distinct()
    return EV.match_projects(paths, spark.createDataFrame(_ROOTS, "project_id string, root string"))


@register("lagged_correlation", ex(f", s AS (SELECT day, CAST(count(*) FILTER (source = 'ai') AS DOUBLE) x, CAST(count(*) FILTER (source = 'git') AS DOUBLE) y FROM ex GROUP BY 1), j AS (SELECT a.x, a.y, b.y AS z FROM s a LEFT JOIN s b ON b.day = a.day + 1), c AS (SELECT count(*) n, coalesce(corr(x, y), 0) r0, coalesce(corr(x, z), 0) r1 FROM j) SELECT n, {r('r0')} AS r0, {r('r1')} AS r1, abs(r1) > abs(r0) + 0.1 AS follows FROM c"))
def lagged_correlation(spark, d):
    s = exact(spark, d).groupBy("day").agg(F.count_if(F.col("source") == "ai").cast("double").alias("x"), F.count_if(F.col("source") == "git").cast("double").alias("y"))
    return ST.lag_correlation(s, "day", "x", "y")


@register("daily_z_scores", ex(f", s AS (SELECT project, day, count(*) n FROM ex GROUP BY 1, 2), m AS (SELECT project, avg(n) a, stddev_pop(n) sd FROM s GROUP BY 1) SELECT s.project, day, {r('CASE WHEN sd > 0 THEN (n - a) / sd ELSE 0 END')} AS z FROM s JOIN m ON s.project = m.project"))
def daily_z_scores(spark, d):
    s = exact(spark, d).groupBy("project", "day").agg(F.count("*").alias("n"))
    m = s.groupBy("project").agg(F.avg("n").alias("a"), F.stddev_pop("n").alias("sd"))
    return s.join(F.broadcast(m), "project").select("project", "day", N.half_up(N.z_score(F.col("n"), F.col("a"), F.col("sd")), 4).alias("z"))


@register("smoothed_days", ex(f", s AS (SELECT project, day, CAST(count(*) AS DOUBLE) n, row_number() OVER (PARTITION BY project ORDER BY day) i FROM ex GROUP BY 1, 2) SELECT a.project, a.i - 1 AS place, {r('sum(b.n * CASE WHEN b.i = 1 THEN pow(0.7, a.i - 1) ELSE 0.3 * pow(0.7, a.i - b.i) END)')} AS smoothed FROM s a JOIN s b ON a.project = b.project AND b.i <= a.i GROUP BY a.project, a.i"))
def smoothed_days(spark, d):
    """Exponential smoothing of a project's daily counts, seeded with the first."""
    s = exact(spark, d).groupBy("project", "day").agg(F.count("*").cast("double").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"])
    return s.groupBy("project").agg(N.exponential_smoothing(ordered).alias("v")).select("project", F.posexplode("v").alias("place", "x")).select("project", F.col("place").cast("long").alias("place"), N.half_up(F.col("x"), 4).alias("smoothed"))


@register("weekly_confidences", f"WITH c AS (SELECT p_partkey, CASE WHEN p_size <= 14 THEN 0.9 ELSE 0.9 * pow(0.7, (p_size - 14) / 7.0) END x FROM part) SELECT p_partkey, CASE WHEN x >= 0.3 THEN {r('x')} END AS confidence FROM c")
def weekly_confidences(spark, d):
    return table(spark, d, "part").select("p_partkey", N.half_up(N.weekly_confidence(F.lit(0.9), F.col("p_size").cast("double")), 4).alias("confidence"))


@register("source_confidences", f"SELECT o_custkey, {r('list_reduce(list_prepend(0.5::DOUBLE, list(CASE o_orderstatus WHEN $$F$$ THEN 2.0::DOUBLE WHEN $$O$$ THEN 0.8::DOUBLE ELSE 1.2::DOUBLE END ORDER BY o_orderdate, o_orderkey)), lambda p, x: greatest(0.05, least(0.99, p / (1 - p) * x / (1 + p / (1 - p) * x))))').replace('$$', chr(39))} AS confidence FROM orders GROUP BY 1")
def source_confidences(spark, d):
    """Confidence after each source in turn, by likelihood ratios."""
    s = F.col("o_orderstatus")
    ratio = F.when(s == "F", 2.0).when(s == "O", 0.8).otherwise(1.2)
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", ratio.alias("x")))).alias("v"))
    return o.select("o_custkey", N.half_up(N.odds_update(0.5, F.transform("v", lambda x: x["x"])), 4).alias("confidence"))


@register("merged_arrays", "WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) v FROM orders WHERE year(o_orderdate) < 1997 GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) v FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.v, []), coalesce(b.v, [])))), ',') AS v FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def merged_arrays(spark, d):
    o = table(spark, d, "orders")
    side = lambda x: o.where(x).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("v"))
    both = SC.merge_states(side(F.year("o_orderdate") < 1997), side(F.year("o_orderdate") >= 1997), ["o_custkey"], {"v": "union"})
    return both.select("o_custkey", F.array_join(F.array_sort("v"), ",").alias("v"))
