"""Queries for the evidence behind insights: filters by term and time, lineage, fuzzy joins, noise and decision predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import evidence as E
from ..operators import rollups as R
from .adapter import exact, r, table
from .adapter import with_exact as ex
from .catalog import register

#: Documents as dated insights.
_NOTES = "notes AS (SELECT doc_id, text AS summary, source AS intent, DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS day FROM documents), latest AS (SELECT max(day) AS as_of FROM notes)"
_TERMS = ["ention", "chauque", "License", "src3"]
_SQL_TERMS = "(SELECT unnest(['ention','chauque','License','src3']) term)"


def _notes(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("summary"), F.col("source").alias("intent"), day.alias("day"))


_HITS = f"WITH {_NOTES}, m AS (SELECT doc_id, day, term FROM notes, {_SQL_TERMS} q WHERE contains(summary, term) OR contains(intent, term))"


@register("substring_evidence", f"{_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY day DESC, doc_id DESC) place FROM m) SELECT term, place, doc_id, day FROM k WHERE place <= 20")
def substring_evidence(spark, d):
    """The twenty newest notes for each term."""
    return E.newest(E.mentions(_notes(spark, d), _TERMS, "summary", "intent").select("term", "doc_id", "day"), ["term"], ["day", "doc_id"], 20)


@register("loop_evidence", f"{_HITS} SELECT term, count(*) n, min(doc_id) least FROM m, latest WHERE day >= as_of - INTERVAL 7 DAY GROUP BY 1")
def loop_evidence(spark, d):
    """As far as seven days back from the newest note."""
    notes = _notes(spark, d)
    recent = notes.join(F.broadcast(notes.agg(F.max("day").alias("as_of")))).where(F.col("day") >= F.date_sub("as_of", 7))
    return E.mentions(recent, _TERMS, "summary", "intent").groupBy("term").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@register("blind_spot_evidence", f"{_HITS} SELECT term, count(*) n, max(day) last FROM m GROUP BY 1")
def blind_spot_evidence(spark, d):
    return E.mentions(_notes(spark, d), _TERMS, "summary", "intent").groupBy("term").agg(F.count("*").alias("n"), F.max("day").alias("last"))


@register("radar_evidence", f"WITH {_NOTES} SELECT intent AS domain, term, count(*) n FROM notes, {_SQL_TERMS} q WHERE contains(summary, term) GROUP BY 1, 2")
def radar_evidence(spark, d):
    return E.mentions(_notes(spark, d), _TERMS, "summary").groupBy(F.col("intent").alias("domain"), "term").agg(F.count("*").alias("n"))


_DECISION = "Ention eauque des ou la chauque en des les rèe aichan pour que"


@register("replay_evidence", f"WITH {_NOTES}, q AS (SELECT unnest(['src7', '{_DECISION[:50]}']) term) SELECT doc_id, term FROM notes, q WHERE contains(summary, term) OR contains(intent, term)")
def replay_evidence(spark, d):
    """The term is the domain or the first fifty characters of the decision."""
    return E.mentions(_notes(spark, d), ["src7", _DECISION[:50]], "summary", "intent").select("doc_id", "term")


_IDS = [40, 7, 512, 3, 88, 901, 15]


@register("fetched_in_order", ex(f", q AS (SELECT unnest({_IDS}) AS id, generate_subscripts({_IDS}, 1) - 1 AS place) SELECT ex.id, CAST(place AS BIGINT) place, {r('(1 - 0.5 * place / 7) * (s4 / 1e4)')} contribution, CASE WHEN place = 0 THEN 'primary' WHEN place < 3 THEN 'corroborating' ELSE 'supporting' END AS role FROM ex JOIN q ON ex.id = q.id"))
def fetched_in_order(spark, d):
    from ..functions.numeric import half_up

    found = E.fetched(exact(spark, d), "id", _IDS, F.col("s4") / 1e4)
    return found.withColumn("contribution", half_up(F.col("contribution"), 4))


@register("lineage_by_insight", "SELECT l_partkey AS insight, count(*) n, min(l_orderkey) least, max(l_orderkey) last FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) q GROUP BY 1")
def lineage_by_insight(spark, d):
    """Parts as insights, orders as the events they rest on."""
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("insight"), "l_orderkey").distinct()
    return links.groupBy("insight").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"), F.max("l_orderkey").alias("last"))


@register("lineage_by_event", "SELECT l_orderkey AS event, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) insights FROM lineitem GROUP BY 1")
def lineage_by_event(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").cast("string").alias("p"))
    return links.groupBy("event").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("insights"))


@register("duration_literals", "WITH q AS (SELECT p_partkey, (p_size % 9) || CASE p_size % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'w' WHEN 2 THEN 'm' ELSE 'x' END AS lit FROM part) SELECT p_partkey, CASE right(lit, 1) WHEN 'd' THEN 1 WHEN 'w' THEN 7 WHEN 'm' THEN 30 END * CAST(left(lit, 1) AS INTEGER) AS given, CASE WHEN right(lit, 1) = 'x' THEN 7 ELSE CASE right(lit, 1) WHEN 'd' THEN 1 WHEN 'w' THEN 7 ELSE 30 END * CAST(left(lit, 1) AS INTEGER) END AS days FROM q")
def duration_literals(spark, d):
    unit = F.col("p_size") % 4
    lit = F.concat((F.col("p_size") % 9).cast("string"), F.when(unit == 0, "d").when(unit == 1, "w").when(unit == 2, "m").otherwise("x"))
    return table(spark, d, "part").select("p_partkey", F.nullif(E.duration_days(lit, -1), F.lit(-1)).alias("given"), E.duration_days(lit).alias("days"))


_SENTENCES = """s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'We switched from ' || p_name || ' to ' || p_brand WHEN 1 THEN 'Chose ' || p_name || ' rather than ' || p_brand WHEN 2 THEN 'The project uses ' || p_name WHEN 3 THEN 'let me look at ' || p_name WHEN 4 THEN 'Replaced ' || p_name || ' with ' || p_brand ELSE 'deprecated ' || p_name || ' in favor of ' || p_brand END AS t FROM part)"""


def _sentences(spark, d):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 6
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    t = F.when(kind == 0, say("We switched from ", name, " to ", brand)).when(kind == 1, say("Chose ", name, " rather than ", brand)).when(kind == 2, say("The project uses ", name)).when(kind == 3, say("let me look at ", name)).when(kind == 4, say("Replaced ", name, " with ", brand)).otherwise(say("deprecated ", name, " in favor of ", brand))
    return table(spark, d, "part").select("p_partkey", t.alias("t"))


@register("superseded_names", f"WITH {_SENTENCES} SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN regexp_extract(t, 'from (.+?) to ', 1) WHEN 4 THEN regexp_extract(t, 'Replaced (.+?) with ', 1) WHEN 5 THEN regexp_extract(t, 'deprecated (.+?) in favor', 1) END AS old FROM s")
def superseded_names(spark, d):
    return _sentences(spark, d).select("p_partkey", S.superseded(F.col("t")).alias("old"))


@register("decision_sentences", f"WITH {_SENTENCES} SELECT p_partkey % 6 AS kind, count(*) n, p_partkey % 6 IN (2, 3) AS noisy, p_partkey % 6 IN (0, 1, 4) AS decision FROM s GROUP BY ALL")
def decision_sentences(spark, d):
    """Sentences that read like prompts, and those that state a decision (a capital first, and a word of choosing)."""
    s = _sentences(spark, d)
    return s.groupBy((F.col("p_partkey") % 6).alias("kind"), S.noisy(F.col("t")).alias("noisy"), S.decides(F.col("t")).alias("decision")).agg(F.count("*").alias("n"))


@register("project_labels", "SELECT c_custkey, c_nationkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def project_labels(spark, d):
    """Names for ids; ids without a name stand for themselves."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(names, "c_nationkey", "left").select("c_custkey", "c_nationkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("label"))


_PAGES = "pg AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)"


@register("signals_with_events", f"WITH {_PAGES} SELECT i.doc_id, count(page_id) n, min(page_id) AS first FROM (SELECT doc_id, lang FROM documents) i LEFT JOIN pg ON pg.page_id = i.doc_id AND contains(path, '/' || lang || '/') GROUP BY 1")
def signals_with_events(spark, d):
    """Signals with their event where the event's path mentions what they are about."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    docs = table(spark, d, "documents").select("doc_id", "lang")
    met = docs.join(pages, (F.col("doc_id") == F.col("page_id")) & F.col("path").contains(F.concat(F.lit("/"), "lang", F.lit("/"))), "left")
    return met.groupBy("doc_id").agg(F.count("page_id").alias("n"), F.min("page_id").alias("first"))


@register("related_conversations", f"WITH {_PAGES}, f AS (SELECT DISTINCT regexp_extract(path, '([^/]+)/?$', 1) AS base FROM pg), w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) word FROM conversations) SELECT conv_id, count(*) n FROM w JOIN (SELECT DISTINCT regexp_extract(split_part(path, '/', 1), '^(?:www\\.|m\\.|blog\\.)?([a-z]+)', 1) AS base FROM pg) h ON word = base GROUP BY 1")
def related_conversations(spark, d):
    """Conversations that mention a page's own host name; words are joined, texts are never searched for every name."""
    host = F.regexp_extract(F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")[0], r"^(?:www\.|m\.|blog\.)?([a-z]+)", 1)
    names = table(spark, d, "pages").select(host.alias("word")).distinct()
    words = table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.join(names, "word").groupBy("conv_id").agg(F.count("*").alias("n"))


@register("without_echoes", ex(", p AS (SELECT * FROM ex WHERE source = 'git'), a AS (SELECT * FROM ex WHERE source = 'ai') SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.project = p.project AND abs(epoch_us(a.ts) - epoch_us(p.ts)) <= 60000000 AND len(list_intersect([CAST(a.project AS VARCHAR), CAST(a.branch AS VARCHAR), CAST(a.tc AS VARCHAR)], [CAST(p.project AS VARCHAR), CAST(p.branch AS VARCHAR), CAST(p.tc AS VARCHAR)])) / len(list_distinct(list_concat([CAST(a.project AS VARCHAR), CAST(a.branch AS VARCHAR), CAST(a.tc AS VARCHAR)], [CAST(p.project AS VARCHAR), CAST(p.branch AS VARCHAR), CAST(p.tc AS VARCHAR)]))) >= 0.3)"))
def without_echoes(spark, d):
    """Commits that no AI event of the project, a minute around, says as well."""
    terms = F.array_distinct(F.array(*[F.col(c).cast("string") for c in ("project", "branch", "tc")]))
    events = exact(spark, d).withColumn("terms", terms)
    return E.without_echoes(events.where("source = 'git'"), events.where("source = 'ai'"), ["project"], "ts", "terms", 60, 0.3).select("id")


@register("richest_turns", "SELECT conv_id, arg_max(turn, row(length(text), turn)) turn, max(length(text)) AS n_chars FROM conversations GROUP BY 1")
def richest_turns(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    return E.richest(turns, ["conv_id"], F.col("n_chars"), F.col("turn"))


@register("causal_chains", ex(""", c AS (SELECT 1 AS finder, id FROM ex WHERE outcome = 'failed' AND s4 < 1000 UNION ALL SELECT 2, id FROM ex WHERE source = 'git' AND tc = 9 UNION ALL SELECT 3, id FROM ex WHERE source = 'ai' AND s4 >= 9900 UNION ALL SELECT 4, id FROM ex WHERE tc = 0 AND s4 < 500) SELECT finder, id FROM c ORDER BY finder, id LIMIT 200"""))
def causal_chains(spark, d):
    """What four finders give, one after the other, up to the first two hundred."""
    e = exact(spark, d)
    found = ["outcome = 'failed' and s4 < 1000", "source = 'git' and tc = 9", "source = 'ai' and s4 >= 9900", "tc = 0 and s4 < 500"]
    rows = [e.where(x).select(F.lit(i + 1).alias("finder"), "id") for i, x in enumerate(found)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).orderBy("finder", "id").limit(200)


@register("insert_ignored_bridges", "SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2")
def insert_ignored_bridges(spark, d):
    """Bridge rows as a set: what is there already is not inserted again."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    there, fresh = rows.where("l_linenumber <= 2"), rows.where("l_linenumber > 2")
    keys = ["l_orderkey", "l_partkey"]
    kept = R.insert_ignored(there, fresh, keys, "l_linenumber")
    return kept.withColumnRenamed("l_linenumber", "first")


@register("feature_counters", ex(", n AS (SELECT branch, count(*) n_events, max(ts) last_seen FROM ex GROUP BY 1) SELECT branch, n_events, last_seen, CASE WHEN last_seen < as_of - INTERVAL 1 HOUR THEN 'stale' ELSE 'active' END AS status FROM n, newest"))
def feature_counters(spark, d):
    """Features with their counters recomputed, and stale where nothing has come for an hour."""
    e = exact(spark, d)
    n = e.groupBy("branch").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_seen"))
    return n.join(F.broadcast(R.as_of(e))).select("branch", "n_events", "last_seen", F.when(F.col("last_seen") < F.col("as_of") - F.expr("interval 1 hour"), "stale").otherwise("active").alias("status"))


@register("tool_call_summaries", ex(", n AS (SELECT session, tool, count(*) n FROM ex GROUP BY 1, 2) SELECT session, string_agg(tool || ' x' || n, ', ' ORDER BY n DESC, tool) AS calls, CAST(sum(n) AS BIGINT) AS n_calls FROM n GROUP BY 1"))
def tool_call_summaries(spark, d):
    """The tools of a session with how often each was called, most first."""
    n = exact(spark, d).groupBy("session", "tool").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "tool", "n")))
    calls = F.array_join(F.transform(ordered, lambda x: F.concat(x["tool"], F.lit(" x"), x["n"].cast("string"))), ", ")
    return n.groupBy("session").agg(calls.alias("calls"), F.sum("n").alias("n_calls"))


@register("evolved_schema", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice FROM orders")
def evolved_schema(spark, d):
    """Tables of an older and a newer schema in one: columns that either lacks are null."""
    o = table(spark, d, "orders")
    return R.evolved(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("decision_log_ids", "SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS id, o_orderkey FROM orders")
def decision_log_ids(spark, d):
    """Ids of logged decisions: the date and a running number in it."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return R.dated_ids(o, "day", ["o_orderkey"]).select("id", "o_orderkey")


@register("metric_snapshots", ex(", s AS (SELECT day, project, id, sum(s4) OVER (PARTITION BY day, project ORDER BY ts, id) total, row_number() OVER (PARTITION BY day, project ORDER BY ts DESC, id DESC) k FROM ex) SELECT day, project, id AS at, CAST(total AS BIGINT) AS total FROM s WHERE k = 1"))
def metric_snapshots(spark, d):
    """Of all snapshots of a day and project the last one written."""
    e = exact(spark, d)
    return e.groupBy("day", "project").agg(F.max_by("id", F.struct("ts", "id")).alias("at"), F.sum("s4").alias("total"))


@register("fact_log", "SELECT l_linestatus AS status, count(*) n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def fact_log(spark, d):
    """Facts as JSON lines and back; lines that do not parse are left out."""
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    lines = l.select(F.to_json(F.struct(F.col("l_orderkey").alias("subject"), F.lit("returned").alias("predicate"), F.col("l_linestatus").alias("object"))).alias("value")).unionByName(spark.createDataFrame([("not json",), ("",)], "value string"))
    facts = lines.select(F.from_json("value", "subject bigint, predicate string, object string").alias("f")).where("f.subject is not null").select("f.*")
    return facts.groupBy(F.col("object").alias("status")).agg(F.count("*").alias("n"), F.sum("subject").alias("keys"))


@register("rapid_fix_sessions", ex(", f AS (SELECT project, ts, id, lag(ts) OVER (PARTITION BY project ORDER BY ts, id) p FROM ex WHERE source = 'git' AND s4 < 4000), g AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts, id) AS grp FROM f) SELECT project, CAST(grp AS BIGINT) AS grp, count(*) n_fixes, min(id) AS first FROM g GROUP BY 1, 2 HAVING count(*) >= 2"))
def rapid_fix_sessions(spark, d):
    """Two or more fixing commits (a low score stands for the word) with at most thirty minutes between them."""
    fixes = exact(spark, d).where("source = 'git' and s4 < 4000")
    return R.rapid_groups(fixes, ["project"], "ts", "id", 1800, 2)


@register("similar_decisions", f"WITH t AS (SELECT item_id, text, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)) w FROM benchmark), q AS (SELECT ['the','and','tion','that','des','of','ing'] AS w), s AS (SELECT item_id, {r('0.4 * (len(list_intersect(t.w, q.w)) / len(list_distinct(list_concat(t.w, q.w)))) + 0.3 * contains(text, $$the $$)::INT + 0.2 * least(1, len(t.w) / 100) + 0.1 * contains(text, $$tion$$)::INT').replace('$$', chr(39))} AS score FROM t, q) SELECT item_id, score FROM s WHERE score > 0 ORDER BY score DESC, item_id LIMIT 10")
def similar_decisions(spark, d):
    """The ten decisions most like a problem: its words (0.4), its domain (0.3), its style (0.2) and its trade-off (0.1)."""
    from ..functions.numeric import half_up

    words = S.token_set(F.col("text"))
    problem = F.array(*[F.lit(w) for w in ("the", "and", "tion", "that", "des", "of", "ing")])
    yes = lambda x: F.when(F.col("text").contains(x), 1).otherwise(0)
    score = 0.4 * S.jaccard(words, problem) + 0.3 * yes("the ") + 0.2 * F.least(F.lit(1.0), F.size(words) / 100) + 0.1 * yes("tion")
    return table(spark, d, "benchmark").select("item_id", half_up(score, 4).alias("score")).where("score > 0").orderBy(F.desc("score"), "item_id").limit(10)
