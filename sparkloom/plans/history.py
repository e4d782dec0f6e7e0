"""Queries over states in time and the knowledge graph's reads: domains, trajectories, timelines, inference and mappings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as RU
from ..functions import strings as S
from ..operators import histories as H
from .adapter import exact, parts, r, table
from .adapter import with_exact as ex
from .catalog import register


#: Suppliers up to which they are broadcast.
BROADCAST_SUPPLIERS = 500_000


def _whole(x: str) -> str:
    return f"CAST({r(x, 0)} AS BIGINT)"


# --- domains, loops and radar


@register("entity_loops", ex(f", u AS (SELECT user_id, count(*) mentions, count(*) FILTER (outcome = 'success' AND ts >= as_of - INTERVAL 7 DAY) facts FROM ex, newest GROUP BY 1) SELECT user_id, mentions, facts, {r('greatest(0, mentions - facts) / mentions')} AS risk FROM u WHERE mentions >= 3 AND greatest(0, mentions - facts) / mentions > 0.7"))
def entity_loops(spark, d):
    e = exact(spark, d)
    recent = (F.col("outcome") == "success") & (F.col("ts") >= F.col("as_of") - F.expr("interval 7 days"))
    u = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of")))).groupBy("user_id").agg(F.count("*").alias("mentions"), F.count_if(recent).alias("facts"))
    risk = F.greatest(F.lit(0), F.col("mentions") - F.col("facts")) / F.col("mentions")
    return u.where((F.col("mentions") >= 3) & (risk > 0.7)).withColumn("risk", N.half_up(risk, 4))


_RADAR = f", dom AS (SELECT branch, {_whole('greatest(0, least(100, 10 * (sum(s4) / count(*) / 1000)))')} AS score, count(*) n FROM ex GROUP BY 1), a AS (SELECT {_whole('sum(s4) / count(*) / 100')} AS overall FROM ex WHERE source = 'other')"


@register("knowledge_radar", ex(_RADAR + " SELECT branch, score, n, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence, overall FROM dom, a"))
def knowledge_radar(spark, d):
    """A score for each domain, and overall the mean assessment."""
    e = exact(spark, d)
    overall = e.where("source = 'other'").agg(N.half_up(F.sum("s4") / F.count("*") / 100).cast("long").alias("overall"))
    return H.radar(e, "branch").join(F.broadcast(overall))


@register("radar_blind_spots", ex(_RADAR + ", p AS (SELECT project, user_id AS module, " + _whole("sum(s4) / count(*) / 100") + " AS score, count(*) n FROM ex GROUP BY 1, 2) SELECT project, module, score FROM p WHERE score < 40 AND n >= 3"))
def radar_blind_spots(spark, d):
    p = exact(spark, d).groupBy("project", F.col("user_id").alias("module")).agg(N.half_up(F.sum("s4") / F.count("*") / 100).cast("long").alias("score"), F.count("*").alias("n"))
    return p.where("score < 40 and n >= 3").drop("n")


@register("pushback_averages", ex(f" SELECT project, {r('count(*) FILTER (outcome = $$failed$$) / count(*)').replace('$$', chr(39))} AS pushback FROM ex, newest WHERE ts >= as_of - INTERVAL 14 DAY GROUP BY 1"))
def pushback_averages(spark, d):
    e = exact(spark, d)
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of")))).where(F.col("ts") >= F.col("as_of") - F.expr("interval 14 days"))
    return recent.groupBy("project").agg(N.half_up(F.count_if(F.col("outcome") == "failed") / F.count("*"), 4).alias("pushback"))


@register("direction_by_directory", ex(f", p AS (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') a FROM pages), m AS (SELECT array_to_string(a[1:least(3, greatest(len(a) - 1, 1))], '/') AS dir, s4 FROM p JOIN ex ON page_id = id) SELECT dir, count(*) n, {r('sum(s4) / count(*) / 1e4')} AS direction FROM m GROUP BY 1 HAVING count(*) >= 2"))
def direction_by_directory(spark, d):
    paths = table(spark, d, "pages").select(F.col("page_id").alias("id"), S.module_of(F.regexp_extract("url", "://([^?#]*)", 1)).alias("dir"))
    return paths.join(exact(spark, d).select("id", "s4"), "id").groupBy("dir").agg(F.count("*").alias("n"), N.half_up(F.sum("s4") / F.count("*") / 1e4, 4).alias("direction")).where("n >= 2")


@register("first_run_report", ex(f", a AS (SELECT branch, count(*) FILTER (tc <= 1) / count(*) rate, count(*) n FROM ex GROUP BY 1) SELECT 'source' AS section, source AS name, CAST(count(*) AS DOUBLE) AS value FROM ex GROUP BY ALL UNION ALL SELECT 'density', '', {r('sum(s4) / count(*) / 1e4')} FROM ex UNION ALL SELECT 'domain', CAST(branch AS VARCHAR), n FROM a UNION ALL SELECT 'accepted', CAST(arg_max(branch, row(rate, -branch)) AS VARCHAR), {r('max(rate)')} FROM a WHERE n >= 3"))
def first_run_report(spark, d):
    """What a first look at a corpus of events tells: sources, density, domains, and the domain whose results are taken as they are."""
    e = exact(spark, d)
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    a = e.groupBy("branch").agg((F.count_if(F.col("tc") <= 1) / F.count("*")).alias("rate"), F.count("*").alias("n"))
    top = a.where("n >= 3").agg(F.max_by("branch", F.struct("rate", -F.col("branch"))).alias("branch"), F.max("rate").alias("rate"))
    parts = [row(e.groupBy("source").count(), "source", F.col("source"), F.col("count")), row(e.agg((F.sum("s4") / F.count("*") / 1e4).alias("x")), "density", F.lit(""), N.half_up(F.col("x"), 4)), row(a, "domain", F.col("branch"), F.col("n")), row(top, "accepted", F.col("branch"), N.half_up(F.col("rate"), 4))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("domain_complexity", ex(", u AS (SELECT user_id, count(*) FILTER (phase = 'click') i, count(*) FILTER (phase = 'signup') f, count(*) FILTER (phase = 'purchase') dn, 5 * (sum(s4) / count(*) / 1e4) q FROM ex GROUP BY 1), p AS (SELECT user_id, CASE WHEN i >= 10 THEN 3 WHEN i >= 5 THEN 2 WHEN i >= 2 THEN 1 ELSE 0 END + CASE WHEN f >= 20 THEN 3 WHEN f >= 10 THEN 2 WHEN f >= 5 THEN 1 ELSE 0 END + CASE WHEN f > 0 AND dn / f >= 0.3 THEN 2 WHEN f > 0 AND dn / f >= 0.15 THEN 1 ELSE 0 END + CASE WHEN q <= 2 AND i >= 3 THEN 1 ELSE 0 END k FROM u) SELECT user_id, CAST(CASE WHEN k >= 7 THEN 0.5 WHEN k >= 5 THEN 0.7 WHEN k >= 2 THEN 1.0 ELSE 1.5 END AS DOUBLE) AS modifier FROM p"))
def domain_complexity(spark, d):
    n = lambda p: F.count_if(F.col("phase") == p)
    u = exact(spark, d).groupBy("user_id").agg(n("click").alias("i"), n("signup").alias("f"), n("purchase").alias("dn"), (5 * (F.sum("s4") / F.count("*") / 1e4)).alias("q"))
    return u.select("user_id", RU.complexity(F.col("i"), F.col("f"), F.col("dn"), F.col("q")).alias("modifier"))


_LEVEL = "greatest(CASE WHEN {n} <= 5 THEN 0 WHEN {n} <= 15 THEN 1 ELSE 2 END, CASE WHEN {a} <= 1.5 THEN 0 WHEN {a} <= 3.0 THEN 1 ELSE 2 END)"


@register("tracked_domains", f"""WITH x AS (SELECT c_custkey % 25 AS domain, year(o_orderdate) < 1997 AS old, CAST(o_orderdate AS DATE) AS day, l.n AS alts FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'), g AS (SELECT domain, count(*) FILTER (old) fo, avg(alts) FILTER (old) ao, max(day) FILTER (old) lo, count(*) FILTER (NOT old) fn, avg(alts) FILTER (NOT old) an, max(day) FILTER (NOT old) ln FROM x GROUP BY 1), t AS (SELECT sum(fn) t FROM g),
 v AS (SELECT *, fo + fn AS f, {_LEVEL.format(n='(fo + fn)', a='coalesce(an, 0)')} AS lv, CASE WHEN fo > 0 THEN {_LEVEL.format(n='fo', a='ao')} END AS lo_ FROM g WHERE fn > 0) SELECT domain, f AS frequency, {r('fn / t')} AS share, greatest(coalesce(lo, ln), ln) AS last_seen, CASE lv WHEN 0 THEN 'shallow' WHEN 1 THEN 'moderate' ELSE 'deep' END AS depth, CASE WHEN fo = 0 THEN 'stable' WHEN lv > lo_ THEN 'deepening' WHEN f / fo > 1.5 AND lv >= lo_ THEN 'broadening' ELSE 'stable' END AS trend FROM v, t""")
def tracked_domains(spark, d):
    """Domains of decisions before and after a date, merged: frequency, share, depth and how the depth moves."""
    o, c, l = (table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    alternatives = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("alternatives"))
    met = o.where("o_orderpriority = '1-URGENT'").join(c.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 25).alias("domain")), "o_custkey").join(alternatives, "o_orderkey")
    return H.tracked_domains(met.select("domain", F.to_date("o_orderdate").alias("day"), "alternatives", (F.year("o_orderdate") < 1997).alias("old")))


# --- sessions and states in time


@register("session_loop_risks", ex(f", o AS (SELECT session, s4 / 1e4 AS s, phase, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) k, count(*) OVER (PARTITION BY session) n, lag(s4 / 1e4) OVER (PARTITION BY session ORDER BY ts, id) p, lag(phase) OVER (PARTITION BY session ORDER BY ts, id) pp FROM ex), g AS (SELECT session, max(n) n, avg(s) FILTER (k <= 5) a, count(*) FILTER (k <= least(n, 5) - 1 AND s < p - 0.05) f, least(max(n), 5) AS w, count(*) FILTER (pp IS NOT NULL AND pp <> phase) c FROM o GROUP BY 1) SELECT session, n, {r('least(1, CASE WHEN n > 10 THEN 0.2 ELSE 0 END + CASE WHEN n > 20 THEN 0.2 ELSE 0 END + CASE WHEN n >= 3 AND f >= w * 0.6 THEN 0.3 ELSE 0 END + CASE WHEN a < 0.3 THEN 0.2 ELSE 0 END + CASE WHEN a < 0.15 THEN 0.1 ELSE 0 END + CASE WHEN c >= 4 THEN 0.1 ELSE 0 END)', 2)} AS risk FROM g"))
def session_loop_risks(spark, d):
    return H.session_risk(exact(spark, d).withColumn("s", F.col("s4") / 1e4), "session", ["ts", "id"], "s", "phase")


@register("previous_day_threads", ex(f", t AS (SELECT day, list(DISTINCT branch || '-' || tool || '-' || hour(ts) ORDER BY branch || '-' || tool || '-' || hour(ts)) w FROM ex WHERE s4 >= 8000 GROUP BY 1) SELECT a.day, {r('len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))')} AS similarity, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.35 AS continued FROM t a JOIN t b ON b.day = a.day - 1"))
def previous_day_threads(spark, d):
    """How much of a day's threads were there the day before."""
    word = F.concat_ws("-", F.col("branch").cast("string"), "tool", F.hour("ts").cast("string"))
    t = exact(spark, d).where("s4 >= 8000").groupBy("day").agg(F.collect_set(word).alias("w"))
    before = t.select(F.date_add("day", 1).alias("day"), F.col("w").alias("v"))
    like = S.jaccard(F.col("w"), F.col("v"))
    return t.join(before, "day").select("day", N.half_up(like, 4).alias("similarity"), (like >= 0.35).alias("continued"))


@register("trajectory_points", ex(f", u AS (SELECT user_id, min(ts) a, max(ts) b, arg_max(s4, row(ts, id)) / 1e4 AS now FROM ex GROUP BY 1), p AS (SELECT user_id, CAST(a AS DATE) d1, CAST(make_timestamp((epoch_us(a) + epoch_us(b)) // 2) AS DATE) d2, CAST(b AS DATE) d3, now FROM u) SELECT user_id, d1 AS day, 0.1 AS level FROM p UNION ALL SELECT user_id, d2, {r('now * 0.6')} FROM p WHERE d1 <> d3 AND d2 <> d1 AND d2 <> d3 UNION ALL SELECT user_id, d3, {r('now')} FROM p"))
def trajectory_points(spark, d):
    order = F.struct("ts", "id")
    u = exact(spark, d).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), (F.max_by("s4", order) / 1e4).alias("now"))
    return H.trajectory(u, "user_id")


@register("day_shapes", ex(""", g AS (SELECT day, count(DISTINCT branch) b, count(DISTINCT tool) dm, count(*) FILTER (s4 >= 9000) alt, count(*) FILTER (source = 'git') c, count(*) FILTER (source = 'ai') ai FROM ex GROUP BY 1), hh AS (SELECT day, hour(ts) h, count(*) n FROM ex GROUP BY 1, 2), pk AS (SELECT day, arg_min(h, row(-n, h)) AS peak FROM hh GROUP BY 1), o AS (SELECT day, branch, row_number() OVER (PARTITION BY day ORDER BY ts, id) k, count(*) OVER (PARTITION BY day) // 2 AS m FROM ex), hf AS (SELECT day, count(DISTINCT branch) FILTER (k <= m) e, count(DISTINCT branch) FILTER (k > m) l FROM o GROUP BY 1)
 SELECT day, CAST(peak AS INTEGER) peak, CASE WHEN dm <= 2 AND b <= 2 AND alt < 3 THEN CASE WHEN c >= 5 OR ai >= 3 THEN 'deep-dive' ELSE 'routine' END WHEN alt >= 5 AND b >= 3 THEN CASE WHEN l < e THEN 'convergence' ELSE 'exploration' END WHEN dm >= 4 AND b >= 3 THEN 'scattered' WHEN alt >= 3 THEN 'exploration' ELSE 'routine' END AS arc FROM g JOIN pk USING (day) JOIN hf USING (day)"""))
def day_shapes(spark, d):
    """The busiest hour of a day and the arc of its work."""
    return H.day_shapes(exact(spark, d))


@register("local_days", ex(" SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_day, count(*) n FROM ex GROUP BY 1"))
def local_days(spark, d):
    """Days of a place five hours west."""
    return exact(spark, d).groupBy(F.to_date(F.from_utc_timestamp("ts", "-05:00")).alias("local_day")).agg(F.count("*").alias("n"))


@register("state_changes", ex(", s AS (SELECT user_id, id, ts, tool, branch, tc, lag(tool) OVER w pt, lag(branch) OVER w pb, lag(tc) OVER w pc, lag(id) OVER w pid FROM ex WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), c AS (SELECT user_id, id, ts, concat_ws(',', CASE WHEN tool <> pt THEN 'tool:' || pt || '>' || tool END, CASE WHEN branch <> pb THEN 'branch:' || pb || '>' || branch END, CASE WHEN tc <> pc THEN 'turns:' || pc || '>' || tc END) change FROM s WHERE pid IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) i FROM c WHERE change <> '') SELECT user_id, id, change FROM k WHERE i <= 20"))
def state_changes(spark, d):
    """The last twenty changes of state of each user, as key:from>to."""
    states = exact(spark, d).select("user_id", "id", "ts", "tool", "branch", F.col("tc").alias("turns"))
    return H.state_changes(states, "user_id", ["ts", "id"], ["tool", "branch", "turns"], 20).select("user_id", "id", "change")


# --- reads of the graph


@register("capability_map", ex(" SELECT user_id, arg_max(turns, row(ts, id)) AS level, count(*) n FROM ex GROUP BY 1"))
def capability_map(spark, d):
    """A field of the latest JSON state of each entity."""
    e = table(spark, d, "events")
    latest = F.max_by("props", F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(F.get_json_object(latest, "$.k").cast("int").alias("level"), F.count("*").alias("n"))


@register("active_patterns", "SELECT p_partkey, p_type, count(DISTINCT l_orderkey) AS applied FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size >= 40 GROUP BY 1, 2")
def active_patterns(spark, d):
    active = table(spark, d, "part").where("p_size >= 40").select(F.col("p_partkey"), "p_type")
    met = active.join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey"), "p_partkey")
    return met.groupBy("p_partkey", "p_type").agg(F.countDistinct("l_orderkey").alias("applied"))


@register("entity_timelines", "WITH k AS (SELECT l_partkey, l_orderkey, l_shipdate, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) place FROM lineitem) SELECT l_partkey, place, l_orderkey FROM k WHERE place <= 5")
def entity_timelines(spark, d):
    """The five newest links of each entity."""
    from ..operators.evidence import newest

    links = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return newest(links, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], 5).select("l_partkey", "place", "l_orderkey")


@register("graph_stats", "SELECT 'entity' AS what, 'part' AS type, count(*) n FROM part UNION ALL SELECT 'entity', 'supplier', count(*) FROM supplier UNION ALL SELECT 'entity', 'order', count(*) FROM orders UNION ALL SELECT 'edge', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag")
def graph_stats(spark, d):
    entity = lambda name, t: table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit("entity").alias("what"), F.lit(name).alias("type"), "n")
    edges = table(spark, d, "lineitem").groupBy(F.lit("edge").alias("what"), F.col("l_returnflag").alias("type")).agg(F.count("*").alias("n"))
    return entity("part", "part").unionByName(entity("supplier", "supplier")).unionByName(entity("order", "orders")).unionByName(edges)


@register("maturity_timeline", ex(f", h AS (SELECT project, day, sum(s4) / count(*) / 1e4 AS s FROM ex GROUP BY 1, 2) SELECT project, day, row_number() OVER (PARTITION BY project ORDER BY day) AS place, CAST(CASE WHEN s >= 0.7 THEN 4 WHEN s >= 0.45 THEN 3 WHEN s >= 0.2 THEN 2 ELSE 1 END AS INTEGER) AS level FROM h"))
def maturity_timeline(spark, d):
    h = exact(spark, d).groupBy("project", "day").agg((F.sum("s4") / F.count("*") / 1e4).alias("s"))
    level = F.when(F.col("s") >= 0.7, 4).when(F.col("s") >= 0.45, 3).when(F.col("s") >= 0.2, 2).otherwise(1)
    return h.select("project", "day", F.row_number().over(Window.partitionBy("project").orderBy("day")).cast("long").alias("place"), level.alias("level"))


@register("inferred_causes", ex(", p AS (SELECT id, user_id, ts FROM ex WHERE source = 'git'), q AS (SELECT user_id, ts FROM ex WHERE outcome = 'failed') SELECT p.id, count(*) n FROM p JOIN q ON q.user_id = p.user_id AND q.ts > p.ts AND epoch_us(q.ts) - epoch_us(p.ts) < 259200000000 GROUP BY 1 HAVING count(*) >= 3"))
def inferred_causes(spark, d):
    """Patterns followed by three or more diagnostics of the same feature within three days."""
    e = exact(spark, d).where("source = 'git' or outcome = 'failed'")
    return H.followed_by(e, "id", ["user_id"], "ts", F.col("source") == "git", F.col("outcome") == "failed", 3 * 86_400_000_000, 3)


@register("decision_quality", f"WITH v AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') rev, count(DISTINCT l_suppkey) s, count(DISTINCT s_nationkey) n, count(DISTINCT n_regionkey) g FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT l_orderkey, rev AS revisions, s + n + g AS reach, {r('greatest(0, 1 - rev * 0.25) * 0.4 + least(1, (s + n + g) * 0.1) * 0.3 + (1 - least(1, rev * 0.2)) * 0.3', 3)} AS composite FROM v")
def decision_quality(spark, d):
    """Durability by revisions, and effect by how much lies downstream (suppliers, their nations and regions)."""
    s, n, l = (table(spark, d, t) for t in ("supplier", "nation", "lineitem"))
    down = s.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    down = F.broadcast(down) if s.count() <= BROADCAST_SUPPLIERS else down
    # Lines are dealt out by order once; an order's sets are small, and three distinct counts would shuffle each line four times.
    met = l.select("l_orderkey", "l_suppkey", "l_returnflag").join(down, "l_suppkey").repartition(parts(l), "l_orderkey")
    v = met.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("revisions"), (F.size(F.collect_set("l_suppkey")) + F.size(F.collect_set("s_nationkey")) + F.size(F.collect_set("n_regionkey"))).cast("long").alias("reach"))
    return v.withColumn("composite", N.half_up(H.decision_quality(F.col("revisions"), F.col("reach")), 3))


@register("session_work_units", ex(" SELECT session, count(*) n_events, min(ts) started, max(ts) ended, arg_max(branch, row(ts, id)) AS feature FROM ex WHERE source = 'ai' GROUP BY 1"))
def session_work_units(spark, d):
    """Sessions as work units with an edge to the feature they ended in."""
    s = exact(spark, d).where("source = 'ai'")
    return s.groupBy("session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max_by("branch", F.struct("ts", "id")).alias("feature"))


@register("feature_entities", "WITH f AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), c AS (SELECT rtrim(path, '/') AS path FROM f), k AS (SELECT DISTINCT path FROM c) SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM k WHERE path <> ''")
def feature_entities(spark, d):
    """Paths as features, each with an edge to the path above."""
    path = F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "")
    return table(spark, d, "pages").select(path.alias("path")).distinct().where("path <> ''").select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"))


@register("decision_entities", "SELECT 'dec-' || o_orderkey AS entity, 'decision' AS kind, o_orderpriority AS domain, CAST(o_orderdate AS DATE) AS day FROM orders")
def decision_entities(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("dec-"), F.col("o_orderkey").cast("string")).alias("entity"), F.lit("decision").alias("kind"), F.col("o_orderpriority").alias("domain"), F.to_date("o_orderdate").alias("day"))


@register("chained_query", f"WITH a AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 3), b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM a)) SELECT p_brand, count(*) n, {r('sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) / count(*) / 100.0', 2)} AS price FROM b JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def chained_query(spark, d):
    """Steps that pass their results on: the commonest brands, their orders, what these cost."""
    part, l, o = (table(spark, d, t) for t in ("part", "lineitem", "orders"))
    top = part.groupBy("p_brand").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "p_brand").limit(3).select("p_brand")
    mine = part.join(F.broadcast(top), "p_brand").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    found = l.select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(mine, "l_partkey").select("o_orderkey", "p_brand").distinct()
    cents = F.rint(F.col("o_totalprice") * 100).cast("long")
    return found.join(o.select("o_orderkey", cents.alias("c")), "o_orderkey").groupBy("p_brand").agg(F.count("*").alias("n"), N.half_up(F.sum("c") / F.count("*") / 100.0, 2).alias("price"))


@register("relevant_entities", ex(f", e AS (SELECT user_id, arg_max(branch, row(ts, id)) br, arg_max(tool, row(ts, id)) kind, count(*) n, sum(s4) / count(*) / 1e4 AS w, max(ts) last FROM ex GROUP BY 1) SELECT user_id, {r('least(1, 0.4 * w + CASE WHEN br IN (1, 3) THEN 0.2 ELSE 0 END + CASE WHEN last >= as_of - INTERVAL 1 HOUR THEN 0.15 ELSE 0 END + CASE WHEN kind = $$view$$ THEN 0.1 ELSE 0 END + CASE WHEN n > 190 THEN 0.1 ELSE 0 END)').replace('$$', chr(39))} AS score FROM e, newest"))
def relevant_entities(spark, d):
    e = exact(spark, d)
    order = F.struct("ts", "id")
    g = e.groupBy("user_id").agg(F.max_by("branch", order).alias("br"), F.max_by("tool", order).alias("kind"), F.count("*").alias("n"), (F.sum("s4") / F.count("*") / 1e4).alias("w"), F.max("ts").alias("last")).join(F.broadcast(e.agg(F.max("ts").alias("as_of"))))
    kind = F.when(F.col("kind") == "view", "capability").otherwise("decision")
    score = RU.relevance(F.col("w"), F.col("br").isin(1, 3), F.col("last") >= F.col("as_of") - F.expr("interval 1 hour"), F.lit("exploring"), kind, F.col("n") > 190)
    return g.select("user_id", N.half_up(score, 4).alias("score"))


@register("knowledge_reads", "SELECT l_suppkey AS subject, count(*) n, min(l_shipdate) AS first FROM lineitem WHERE l_suppkey IN (3, 5, 8) AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_linestatus = 'O' GROUP BY 1")
def knowledge_reads(spark, d):
    """Facts by subject, time and whether they still hold; every predicate may be left out."""
    facts = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_shipdate").alias("valid_at"), (F.col("l_linestatus") == "O").alias("active"))
    found = H.read_facts(facts, subjects=[3, 5, 8], since="1996-01-01", active_only=True)
    return found.groupBy("subject").agg(F.count("*").alias("n"), F.min("valid_at").alias("first"))


@register("running_profile", ex(f" SELECT project, count(*) n, {r('sum(CASE WHEN source = $$ai$$ THEN s4 ELSE 0 END) / count(*) / 1e4').replace('$$', chr(39))} AS direction, count(DISTINCT branch) AS domains FROM ex GROUP BY 1"))
def running_profile(spark, d):
    """Running averages by all events, also those without the value: missing values count as nothing, not as absent."""
    e = exact(spark, d).withColumn("known", F.when(F.col("source") == "ai", F.col("s4")))
    g = e.groupBy("project").agg(F.count("*").alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("s"), F.countDistinct("branch").alias("domains"))
    return g.select("project", "n", N.half_up(F.col("s") / F.col("n") / 1e4, 4).alias("direction"), "domains")


@register("incremental_ingest", "SELECT CAST(ts AS DATE) AS event_date, count(*) n, min(CAST(event_id AS BIGINT)) AS first, count(DISTINCT user_id) AS projects FROM events GROUP BY 1")
def incremental_ingest(spark, d):
    """Events as day files, ingested in three runs: the first half, then what comes later (also to days already there), then again."""
    import uuid

    from ..sources import ingest
    from ..sources.places import shared_folder

    base = f"{shared_folder(spark)}/sparkloom/ingest-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("projectId"), stamp.alias("timestamp"), F.lit("git").alias("source"), F.col("event_type").alias("type"), F.struct(F.col("event_type").alias("summary")).alias("content"), F.col("props").alias("metadata")))
    lines = e.select(line.alias("value"), F.to_date("ts").alias("event_date"), (F.hour("ts") < 12).alias("early"))
    for early in (True, False):
        part = lines.where(F.col("early") == early).drop("early")
        part.repartition("event_date").write.mode("append").partitionBy("event_date").text(f"{base}/log")
        ingest.materialise(spark, f"{base}/log", f"{base}/table")
    ingest.materialise(spark, f"{base}/log", f"{base}/table")
    found = ingest.materialised(spark, f"{base}/table")
    return found.groupBy("event_date").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"), F.countDistinct("project_id").alias("projects"))
