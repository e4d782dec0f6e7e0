"""Queries over domains, prompts, patterns and quality: smaller aggregates that analyzers are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..operators import dialogue as D
from ..operators import rollups as R
from ..operators import scores as SC
from ..operators import texts as TX
from .adapter import events, r, table
from .adapter import with_events as ev
from .catalog import register

TOK = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)"


@register("weekly_domain_means", ev(f""", w AS (SELECT branch, isoyear(ts) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR),2,'0') AS week, avg(turns) t, count(*) n FROM ev WHERE source='ai' GROUP BY 1,2), k AS (SELECT branch FROM w GROUP BY 1 HAVING count(*) >= 2) SELECT branch, week, {r('t')} mean_turns, n FROM w WHERE branch IN (SELECT branch FROM k)"""))
def weekly_domain_means(spark, d):
    w = events(spark, d).where("source = 'ai'").groupBy("branch", S.iso_week(F.to_date("ts")).alias("week")).agg(N.half_up(F.avg("turns"), 4).alias("mean_turns"), F.count("*").alias("n"))
    enough = w.groupBy("branch").agg(F.count("*").alias("k")).where("k >= 2")
    return w.join(enough.select("branch"), "branch", "left_semi")


@register("strategy_by_type", ev(f""", x AS (SELECT phase, branch, count(*) n FROM ev GROUP BY 1,2), m AS (SELECT phase, arg_max(branch, row(n, branch)) usual FROM x GROUP BY 1) SELECT phase, count(*) n, {r('avg(score)')} specificity, {r("count(*) FILTER (outcome='success')/count(*)::DOUBLE")} success, {r('avg(turns)', 2)} mean_turns, count(DISTINCT branch) n_strategies, any_value(usual) usual FROM ev JOIN m USING (phase) GROUP BY 1"""))
def strategy_by_type(spark, d):
    e = events(spark, d)
    usual = e.groupBy("phase", "branch").agg(F.count("*").alias("n")).groupBy("phase").agg(F.max_by("branch", F.struct("n", "branch")).alias("usual"))
    out = e.groupBy("phase").agg(
        F.count("*").alias("n"), N.half_up(F.avg("score"), 4).alias("specificity"), N.half_up(F.count_if(F.col("outcome") == "success") / F.count("*"), 4).alias("success"),
        N.half_up(F.avg("turns"), 2).alias("mean_turns"), F.countDistinct("branch").alias("n_strategies"),
    )
    return out.join(usual, "phase")


@register("effectiveness_scores", ev(f"SELECT id, {r('score*(1-least(1.0,0.2*(turns%6)))*(1+0.3*value/500)', 2)} effectiveness FROM ev WHERE source='ai'"))
def effectiveness_scores(spark, d):
    e = events(spark, d).where("source = 'ai'")
    return e.select("id", N.half_up(F.col("score") * (1 - F.least(F.lit(1.0), 0.2 * (F.col("turns") % 6))) * (1 + 0.3 * F.col("value") / 500), 2).alias("effectiveness"))


@register("anti_patterns", ev(f""", x AS (SELECT project, count(*) n, count(*) FILTER (score<0.3)/count(*)::DOUBLE a, count(*) FILTER (turns<30)/count(*)::DOUBLE b FROM ev WHERE source='ai' GROUP BY 1) SELECT project, n, {r('a')} low_direction, {r('b')} short, a>0.4 OR b>0.6 AS flagged FROM x"""))
def anti_patterns(spark, d):
    x = events(spark, d).where("source = 'ai'").groupBy("project").agg(F.count("*").alias("n"), (F.count_if(F.col("score") < 0.3) / F.count("*")).alias("a"), (F.count_if(F.col("turns") < 30) / F.count("*")).alias("b"))
    return x.select("project", "n", N.half_up(F.col("a"), 4).alias("low_direction"), N.half_up(F.col("b"), 4).alias("short"), ((F.col("a") > 0.4) | (F.col("b") > 0.6)).alias("flagged"))


@register("blind_spots", ev(f""", x AS (SELECT user_id, count(*) n, avg(score) s, max(ts) l FROM ev GROUP BY 1), y AS (SELECT user_id, n, {r('10*s*CASE WHEN d>0 THEN 1/(1+d/9.0) ELSE 1 END/(10*s)')} kept, d FROM (SELECT *, date_diff('second', l, as_of)/86400.0 d FROM x, newest)) SELECT user_id, n, kept FROM y WHERE kept < 0.95 AND n >= 3"""))
def blind_spots(spark, d):
    e = events(spark, d)
    x = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("l")).join(F.broadcast(R.as_of(e)))
    days = (F.unix_timestamp("as_of") - F.unix_timestamp("l")) / 86400.0
    return x.select("user_id", "n", N.half_up(N.retrievability(days, F.lit(1.0)), 4).alias("kept")).where("kept < 0.95 and n >= 3")


@register("blind_spot_alerts_weekly", ev(", x AS (SELECT user_id, date_trunc('week', ts) AS week, count(*) FILTER (outcome='failed') n FROM ev GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY n DESC, user_id) AS rank FROM x WHERE n >= 2) SELECT CAST(week AS DATE) AS week, user_id, n, rank FROM k WHERE rank <= 2"))
def blind_spot_alerts_weekly(spark, d):
    x = events(spark, d).groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count_if(F.col("outcome") == "failed").alias("n")).where("n >= 2")
    w = Window.partitionBy("week").orderBy(F.desc("n"), "user_id")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2").select("week", "user_id", "n", "rank")


@register("cross_session_terms", f"""WITH t AS (SELECT DISTINCT conv_id, unnest({TOK.format('text')}) term FROM conversations) SELECT term, count(*) n FROM t GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, term LIMIT 10""")
def cross_session_terms(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.explode(S.tokens(F.col("text"))).alias("term")).distinct()
    return t.groupBy("term").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "term").limit(10)


@register("pattern_confidence", ev(f", x AS (SELECT branch, count(*) FILTER (score>=0.5) a, count(*) FILTER (score<0.2) b FROM ev GROUP BY 1) SELECT branch, a supporting, b contradicting, {r('a/(a+b)::DOUBLE*(1-1/(1+(a+b)/3.0))')} confidence FROM x"))
def pattern_confidence(spark, d):
    x = events(spark, d).groupBy("branch").agg(F.count_if(F.col("score") >= 0.5).alias("supporting"), F.count_if(F.col("score") < 0.2).alias("contradicting"))
    n = F.col("supporting") + F.col("contradicting")
    return x.select("branch", "supporting", "contradicting", N.half_up(F.col("supporting") / n * (1 - 1 / (1 + n / 3.0)), 4).alias("confidence"))


@register("preference_tally", f"""WITH p AS (SELECT least(p1.p_brand, p2.p_brand) a, greatest(p1.p_brand, p2.p_brand) b, p1.p_brand < p2.p_brand f FROM lineitem x JOIN lineitem y ON x.l_orderkey=y.l_orderkey AND y.l_linenumber=x.l_linenumber+1 JOIN part p1 ON x.l_partkey=p1.p_partkey JOIN part p2 ON y.l_partkey=p2.p_partkey WHERE p1.p_brand <> p2.p_brand)
 SELECT a, b, count(*) FILTER (f) forward, count(*) FILTER (NOT f) backward, {r('greatest(count(*) FILTER (f), count(*) FILTER (NOT f))/count(*)::DOUBLE')} confidence FROM p GROUP BY 1,2""")
def preference_tally(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    x, y = l.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("p_brand").alias("p")), l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"), F.col("p_brand").alias("q"))
    met = x.join(y, ["l_orderkey", "i"]).where("p != q").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count_if(F.col("p") < F.col("q")).alias("forward"), F.count_if(F.col("p") > F.col("q")).alias("backward"))
    return met.withColumn("confidence", N.half_up(F.greatest("forward", "backward") / (F.col("forward") + F.col("backward")), 4))


@register("domain_keywords", """WITH k(class, keyword) AS (VALUES ('a','the'),('a','of'),('a','and'),('b','der'),('b','die'),('b','und'),('c','la'),('c','de'),('c','que')), s AS (SELECT class, count(*) nk FROM k GROUP BY 1),
 t AS (SELECT doc_id, unnest(list_distinct(""" + TOK.format("text") + """)) keyword FROM documents), h AS (SELECT doc_id, class, floor(least(1.0, count(*)/greatest(1.0, 0.15*any_value(nk)))*1e4+0.5)/1e4 score FROM t JOIN k USING (keyword) JOIN s USING (class) GROUP BY 1,2),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class DESC) i FROM h) SELECT doc_id, max(class) FILTER (i=1) main, max(score) FILTER (i=1) score, max(class) FILTER (i=2 AND score > 0.3) AS second FROM o GROUP BY 1""")
def domain_keywords(spark, d):
    words = [("a", "the"), ("a", "of"), ("a", "and"), ("b", "der"), ("b", "die"), ("b", "und"), ("c", "la"), ("c", "de"), ("c", "que")]
    return TX.keyword_classes(table(spark, d, "documents"), "doc_id", "text", spark.createDataFrame(words, "class string, keyword string"))


@register("session_outcomes", """SELECT conv_id, CASE WHEN count(*) FILTER (contains(text,'|')) > 0 THEN 'success' WHEN bool_or(regexp_matches(text,'(?i)\\b(never ?mind|forget it|give up|abandon)')) THEN 'abandoned' WHEN count(*) > 5 THEN 'failed' ELSE 'partial' END outcome FROM conversations GROUP BY 1""")
def session_outcomes(spark, d):
    giving_up = F.max(F.when(F.col("text").rlike(r"(?i)\b(never ?mind|forget it|give up|abandon)"), "give up"))
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("text").contains("|")).alias("files"), F.count("*").alias("n"), giving_up.alias("words"))
    return per.select("conv_id", D.outcome(F.col("files"), F.col("n"), F.col("words")).alias("outcome"))


@register("value_receipt", ev(", h AS (SELECT unnest([1,7,30]) AS days) SELECT CAST(days AS INTEGER) AS days, count(*) FILTER (source='ai') n_ai, count(*) FILTER (source='git') n_git, count(*) FILTER (source='ai')*5 + count(*) FILTER (source='git')*10 AS minutes FROM ev, newest, h WHERE epoch_us(ts) > epoch_us(as_of) - days*86400000000 GROUP BY 1"))
def value_receipt(spark, d):
    e = events(spark, d)
    near = R.at(e, R.as_of(e)).select("source", "ts", "as_of", F.explode(F.array(F.lit(1), F.lit(7), F.lit(30))).alias("days"))
    near = near.where(F.unix_micros("ts") > F.unix_micros("as_of") - F.col("days") * F.lit(86400000000))
    ai, git = F.count_if(F.col("source") == "ai"), F.count_if(F.col("source") == "git")
    return near.groupBy("days").agg(ai.alias("n_ai"), git.alias("n_git"), (ai * 5 + git * 10).alias("minutes"))


@register("escalation_days", ev(f""", x AS (SELECT branch, CAST(ts AS DATE) dd, count(*) FILTER (outcome='failed') n FROM ev GROUP BY 1,2) SELECT branch, {r("regr_slope(n, date_diff('day', DATE '2024-01-01', dd))", 6)} slope, CAST(max(n) AS BIGINT) most FROM x GROUP BY 1"""))
def escalation_days(spark, d):
    x = events(spark, d).groupBy("branch", F.to_date("ts").alias("dd")).agg(F.count_if(F.col("outcome") == "failed").alias("n")).withColumn("i", F.date_diff("dd", F.lit("2024-01-01").cast("date")))
    return x.groupBy("branch").agg(N.half_up(F.covar_pop("n", "i") / F.var_pop("i"), 6).alias("slope"), F.max("n").alias("most"))


@register("projects_overview", ev(f"SELECT project, CAST(ts AS DATE) AS day, count(*) n, {r('avg(score)')} direction, {r('sum(cost)', 3)} AS cost, count(*) FILTER (source='git') commits, CASE WHEN count(*)>=10 THEN 'high' WHEN count(*)>=5 THEN 'medium' ELSE 'low' END confidence FROM ev GROUP BY 1,2"))
def projects_overview(spark, d):
    n = F.count("*")
    return events(spark, d).groupBy("project", F.to_date("ts").alias("day")).agg(n.alias("n"), N.half_up(F.avg("score"), 4).alias("direction"), N.half_up(F.sum("cost"), 3).alias("cost"), F.count_if(F.col("source") == "git").alias("commits"), SC.confidence_band(n).alias("confidence"))


@register("term_index_size", f"""WITH t AS (SELECT doc_id, unnest({TOK.format('text')}) w FROM documents) SELECT length(w) AS len, count(*) n, count(DISTINCT w) n_terms FROM t GROUP BY 1""")
def term_index_size(spark, d):
    t = table(spark, d, "documents").select(F.explode(S.tokens(F.col("text"))).alias("w"))
    return t.groupBy(F.length("w").cast("long").alias("len")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("n_terms"))


@register("breakthroughs", ev(""", x AS (SELECT user_id, CAST(ts AS DATE) dd, count(*) n FROM ev GROUP BY 1,2), y AS (SELECT *, lag(n) OVER w a, lag(n,2) OVER w b FROM x WINDOW w AS (PARTITION BY user_id ORDER BY dd)) SELECT user_id, dd AS day, n FROM y WHERE n >= 5 AND n >= 3*(a+b)/2.0"""))
def breakthroughs(spark, d):
    x = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    y = x.withColumns({"a": F.lag("n").over(w), "b": F.lag("n", 2).over(w)})
    return y.where("n >= 5 and n >= 3 * (a + b) / 2.0").select("user_id", "day", "n")
