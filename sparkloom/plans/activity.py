"""Queries over the event table: windows, spend, sessions, loops, churn and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..operators import rollups as R
from ..operators import statistics as ST
from ..operators import temporal as T
from .adapter import events, r, table
from .adapter import with_events as ev
from .catalog import register


@register("rolling_windows", ev(f""", w AS (SELECT unnest([1,8,24,168]) AS window_hours),
 x AS (SELECT window_hours, tool, count(*) n, count(*) FILTER (source='ai') na, sum(score) FILTER (source='ai') sa FROM ev, newest, w
 WHERE epoch_us(ts) > epoch_us(as_of) - window_hours * 3600000000 GROUP BY ALL)
 SELECT CAST(window_hours AS INTEGER) window_hours, CAST(sum(n) AS BIGINT) n_events, CAST(floor(100*sum(sa)/sum(na)+0.5) AS BIGINT) direction, string_agg(tool||':'||n, ',' ORDER BY tool||':'||n) tool_mix FROM x GROUP BY 1"""))
def rolling_windows(spark, d):
    e = events(spark, d)
    return R.rolling_windows(e, R.as_of(e))


@register("daily_event_profile", ev(f"""SELECT CAST(ts AS DATE) AS day, source, count(*) AS n, count(DISTINCT user_id) AS n_users, {r('avg(score)')} AS mean_score, {r('sum(value)', 2)} AS total FROM ev GROUP BY 1, 2"""))
def daily_event_profile(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day"), "source").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), N.half_up(F.avg("score"), 4).alias("mean_score"), N.half_up(F.sum("value"), 2).alias("total"))


@register("session_rollup", ev(f"""SELECT session, min(ts) started, max(ts) ended, count(*) n_events, max(turns) max_turns, arg_max(outcome, row(ts, id)) last_outcome, {r('sum(cost)', 3)} AS cost, string_agg(DISTINCT phase, ',' ORDER BY phase) phases FROM ev GROUP BY 1"""))
def session_rollup(spark, d):
    return R.session_rollup(events(spark, d)).withColumn("cost", N.half_up(F.col("cost"), 3))


@register("latest_event_per_user", ev("SELECT user_id, arg_max(id, row(ts, id)) id, max(ts) ts, arg_max(tool, row(ts, id)) tool FROM ev GROUP BY 1"))
def latest_event_per_user(spark, d):
    return R.latest(events(spark, d).select("user_id", "id", "ts", "tool"), ["user_id"], ["ts", "id"])


@register("daily_spend", ev(f"""SELECT CAST(ts AS DATE) AS day, coalesce(tool,'unknown') model, count(*) n, {r("count(*) * CASE WHEN tool LIKE '%view%' THEN 0.01 WHEN tool LIKE '%click%' THEN 0.03 ELSE 0.02 END", 2)} AS cost FROM ev GROUP BY 1,2, tool"""))
def daily_spend(spark, d):
    return R.priced(events(spark, d), {"view": 0.01, "click": 0.03}, 0.02, ["tool"])


for key in ("tool", "branch", "outcome", "project"):

    def share(spark, d, key=key):
        return R.share_by(events(spark, d), key)

    register(f"share_by_{key}", ev(f"SELECT {key}, count(*) n, CAST(floor(100.0*count(*)/(SELECT count(*) FROM ev)+0.5) AS BIGINT) AS percent FROM ev GROUP BY 1"))(share)


@register("waste_and_direction", ev(f"""SELECT project, count(*) n, {r('count(*) FILTER (score < 0.2) / count(*)::DOUBLE')} waste_ratio, {r('count(*) FILTER (score >= 0.5) / count(*)::DOUBLE')} directed_ratio,
 {r('count(*)::DOUBLE / nullif(count(*) FILTER (score >= 0.5), 0)')} cost_per_directed, {r('avg(score)')} mean_score FROM ev WHERE source='ai' GROUP BY 1"""))
def waste_and_direction(spark, d):
    return R.rates(events(spark, d).where("source = 'ai'"), by=["project"])


@register("direction_bands", ev("SELECT project, CASE WHEN score >= 0.6 THEN 'human' WHEN score >= 0.3 THEN 'shared' ELSE 'machine' END band, count(*) n FROM ev WHERE source='ai' GROUP BY 1,2"))
def direction_bands(spark, d):
    band = F.when(F.col("score") >= 0.6, "human").when(F.col("score") >= 0.3, "shared").otherwise("machine")
    return events(spark, d).where("source = 'ai'").groupBy("project", band.alias("band")).agg(F.count("*").alias("n"))


@register("direction_density_day", ev(f"""SELECT CAST(floor(100*avg(score)+0.5) AS BIGINT) density, count(*) n, CASE WHEN count(*)>=10 THEN 'high' WHEN count(*)>=5 THEN 'medium' ELSE 'low' END confidence FROM ev, newest WHERE source='ai' AND ts > as_of - INTERVAL 24 HOUR"""))
def direction_density_day(spark, d):
    e = events(spark, d)
    near = R.at(e, R.as_of(e)).where("source = 'ai' and ts > as_of - interval 24 hours")
    n = F.count("*")
    return near.agg(N.half_up(100 * F.avg("score")).cast("long").alias("density"), n.alias("n"), F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low").alias("confidence"))


@register("repeated_intents", ev("""SELECT turns, count(*) n, count(*) FILTER (outcome='failed') n_failed, (count(*) FILTER (outcome='failed') > 0.5*count(*) OR count(*) >= 5) stuck FROM ev, newest WHERE ts > as_of - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 3"""))
def repeated_intents(spark, d):
    e = events(spark, d)
    return R.repeated(R.at(e, R.as_of(e)).where("ts > as_of - interval 7 days"), "turns", F.col("outcome") == "failed")


@register("file_churn", ev(f""", t AS (SELECT turns AS file, ts, branch FROM ev WHERE source='git'), c AS (SELECT file, count(*) n, max(ts) last_, count(DISTINCT branch) nb FROM t GROUP BY 1),
 h AS (SELECT list_sort(list(n))[least(CAST(floor(count(*)*0.9) AS BIGINT), count(*)-1)+1] q FROM c)
 SELECT file, n, last_ AS last, nb AS n_branches, {r('n/30.0')} rate, n >= greatest(3, q) AS hot FROM c, h"""))
def file_churn(spark, d):
    return R.churn(events(spark, d).where("source = 'git'").select(F.col("turns").alias("file"), "ts", "branch"), 30.0)


@register("commit_hours", ev("SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) AS INTEGER) AS weekday, count(*) n FROM ev WHERE source='git' GROUP BY 1,2"))
def commit_hours(spark, d):
    return events(spark, d).where("source = 'git'").groupBy(F.hour("ts").alias("hour"), (F.weekday("ts") + 1).alias("weekday")).agg(F.count("*").alias("n"))


@register("commit_gaps", ev(f""", g AS (SELECT project, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY project ORDER BY ts, id) gap FROM ev WHERE source='git') SELECT project, count(gap) n, {r('avg(gap)/1e6', 2)} mean_gap, {r('median(gap)/1e6', 2)} median_gap FROM g GROUP BY 1"""))
def commit_gaps(spark, d):
    pairs = T.successors(events(spark, d).where("source = 'git'"), ["project"])
    return pairs.groupBy("project").agg(F.count("*").alias("n"), N.half_up(F.avg("seconds"), 2).alias("mean_gap"), N.half_up(F.median("seconds"), 2).alias("median_gap"))


@register("phase_baselines", ev(f"SELECT phase, count(*) n, {r('avg(score)')} mean, {r('stddev_pop(score)')} sd, count(*) >= 50 trusted FROM ev GROUP BY 1"))
def phase_baselines(spark, d):
    return events(spark, d).groupBy("phase").agg(F.count("*").alias("n"), N.half_up(F.avg("score"), 4).alias("mean"), N.half_up(F.stddev_pop("score"), 4).alias("sd"), (F.count("*") >= 50).alias("trusted"))


@register("phase_normalised", ev(f""", b AS (SELECT phase, avg(score) m, stddev_pop(score) s, count(*) n FROM ev GROUP BY 1) SELECT id, {r('CASE WHEN n >= 50 AND s > 0 THEN (score-m)/s ELSE score - 0.5 END')} z FROM ev JOIN b USING (phase)"""))
def phase_normalised(spark, d):
    e = events(spark, d)
    b = e.groupBy("phase").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count("*").alias("n"))
    z = F.when((F.col("n") >= 50) & (F.col("s") > 0), (F.col("score") - F.col("m")) / F.col("s")).otherwise(F.col("score") - 0.5)
    return e.join(b, "phase").select("id", N.half_up(z, 4).alias("z"))


@register("failed_sessions_retry", ev(""", st AS (SELECT user_id, count(*) FILTER (outcome='failed') retries FROM ev WHERE tool IN ('error','signup') GROUP BY 1 HAVING count(*) FILTER (outcome='failed') > 0)
 SELECT id, ts FROM ev LEFT JOIN st USING (user_id) WHERE source='ai' AND (retries IS NULL OR retries < 3)"""))
def failed_sessions_retry(spark, d):
    e = events(spark, d)
    status = e.where("tool in ('error', 'signup')").groupBy("user_id").agg(F.count_if(F.col("outcome") == "failed").alias("retries")).where("retries > 0")
    return e.where("source = 'ai'").join(status, "user_id", "left").where("retries is null or retries < 3").select("id", "ts")


@register("unanalysed_sessions", ev("SELECT DISTINCT session FROM ev WHERE session NOT IN (SELECT session FROM ev, newest WHERE source='git' AND ts > as_of - INTERVAL 2 DAY)"))
def unanalysed_sessions(spark, d):
    e = events(spark, d)
    done = R.at(e, R.as_of(e)).where("source = 'git' and ts > as_of - interval 2 days").select("session")
    return e.select("session").distinct().join(done, "session", "left_anti")


@register("gap_sessions", ev(""", g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800*1000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END f FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
 s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) n FROM g) SELECT user_id, CAST(n AS BIGINT) session_no, count(*) n_events, min(ts) started, max(ts) ended FROM s GROUP BY 1,2"""))
def gap_sessions(spark, d):
    return T.sessionise(events(spark, d), ["user_id"], 30).groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@register("rapid_fixes", ev(""", g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 14400::BIGINT*1000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END f FROM ev WHERE tool='error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
 s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) n FROM g) SELECT user_id, min(id) first_id, count(*) n FROM s GROUP BY user_id, s.n HAVING count(*) >= 2"""))
def rapid_fixes(spark, d):
    runs = T.sessionise(events(spark, d).where("tool = 'error'"), ["user_id"], 240)
    return runs.groupBy("user_id", "session_no").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n >= 2").drop("session_no")


@register("session_continuations", ev(f""", s AS (SELECT session, id from_id, lead(id) OVER w to_id, epoch_us(lead(ts) OVER w) - epoch_us(ts) u FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts, id)) SELECT session, from_id, to_id, u/1e6 AS seconds FROM s WHERE to_id IS NOT NULL"""))
def session_continuations(spark, d):
    return T.successors(events(spark, d), ["session"])


@register("triggered_commits", ev(""", m AS (SELECT a.project, a.id from_id, arg_min(b.id, row(b.ts, b.id)) to_id, min(epoch_us(b.ts) - epoch_us(a.ts))/1e6 AS seconds FROM ev a JOIN ev b ON a.project=b.project AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 5 MINUTE WHERE a.source='ai' AND b.source='git' GROUP BY 1,2) SELECT * FROM m"""))
def triggered_commits(spark, d):
    e = events(spark, d)
    return T.next_within(e.where("source = 'ai'"), e.where("source = 'git'"), ["project"], 300)


def _files(e):
    return e.withColumn("files", F.array(F.col("turns") % 20, (F.col("turns") * 7) % 20))


@register("ai_commit_links", ev(f""", f AS (SELECT *, list_distinct([turns % 20, (turns*7) % 20]) fs FROM ev),
 p AS (SELECT a.project, a.id from_id, b.id to_id, len(list_intersect(a.fs,b.fs)) k, len(list_intersect(a.fs,b.fs))::DOUBLE / least(len(a.fs),len(b.fs)) * (1 - (epoch_us(b.ts)-epoch_us(a.ts))/1800000000.0) st FROM f a JOIN f b ON a.project=b.project AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.source='ai' AND b.source='git')
 SELECT project, from_id, to_id, CAST(k AS BIGINT) n_shared, {r('st', 3)} strength FROM p WHERE k > 0 AND st > 0.1"""))
def ai_commit_links(spark, d):
    e = events(spark, d).withColumn("files", F.array_distinct(F.array(F.col("turns") % 20, (F.col("turns") * 7) % 20)))
    return T.interval_overlap_join(e.where("source = 'ai'"), e.where("source = 'git'"), ["project"], 1800)


@register("active_streaks", ev(""", x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) dd FROM ev), y AS (SELECT *, dd - CAST(row_number() OVER (PARTITION BY user_id ORDER BY dd) AS INTEGER) g FROM x) SELECT user_id, min(dd) first_day, max(dd) last_day, count(*) n_days FROM y GROUP BY user_id, g HAVING count(*) >= 3"""))
def active_streaks(spark, d):
    return T.streaks(events(spark, d).select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day", 3)


def _daily(spark, d):
    return events(spark, d).groupBy("tool", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.sum("value").alias("value"))


DAILY = ", dl AS (SELECT tool, CAST(ts AS DATE) AS day, count(*) n, avg(score) score, sum(value) value FROM ev GROUP BY 1,2)"


@register("moving_average_week", ev(DAILY + f", w AS (SELECT tool, day, avg(n) OVER x m, count(n) OVER x k FROM dl WINDOW x AS (PARTITION BY tool ORDER BY day ROWS 6 PRECEDING)) SELECT tool, day, {r('m', 2)} moving_average FROM w WHERE k = 7"))
def moving_average_week(spark, d):
    return T.moving_average(_daily(spark, d), ["tool"], "day", "n", 7)


@register("weighted_average_days", ev(DAILY + f", w AS (SELECT tool, day, n a, lag(n) OVER x b, lag(n,2) OVER x c FROM dl WINDOW x AS (PARTITION BY tool ORDER BY day)) SELECT tool, day, {r('(c*1.0+b*2.0+a*3.0)/6.0', 2)} weighted_average FROM w WHERE c IS NOT NULL"))
def weighted_average_days(spark, d):
    return T.weighted_moving_average(_daily(spark, d), ["tool"], "day", "n", [1.0, 2.0, 3.0])


@register("against_last_week", ev(DAILY + f", f AS (SELECT *, first_value(n) OVER (PARTITION BY tool ORDER BY day) f FROM dl) SELECT a.tool, a.day, a.n, coalesce(b.n, a.f) earlier, {r('100.0*(a.n-coalesce(b.n,a.f))/coalesce(b.n,a.f)', 2)} percent FROM f a LEFT JOIN dl b ON a.tool=b.tool AND b.day = a.day - 7"))
def against_last_week(spark, d):
    return T.against_days_back(_daily(spark, d), ["tool"], "day", "n", 7)


@register("velocity_of_halves", ev(DAILY + f""", p AS (SELECT tool, n, row_number() OVER (PARTITION BY tool ORDER BY day) i, count(*) OVER (PARTITION BY tool) k FROM dl), h AS (SELECT tool, count(*) n, avg(p.n) FILTER (i <= floor(k/2)) a, avg(p.n) FILTER (i > floor(k/2)) b FROM p GROUP BY 1)
 SELECT tool, n, {r('a')} early, {r('b')} late, {r('(b-a)/a')} AS change, CASE WHEN (b-a)/a > 0.1 THEN 'up' WHEN (b-a)/a < -0.1 THEN 'down' ELSE 'stable' END trend FROM h"""))
def velocity_of_halves(spark, d):
    return R.trend_of_halves(_daily(spark, d), ["tool"], "day", "n")


@register("half_split_shape", ev(f""", v AS (SELECT user_id, score, row_number() OVER w i, count(*) OVER (PARTITION BY user_id) k, sign(score - lag(score) OVER w) s, ts, id FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), q AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, id) p FROM v),
 h AS (SELECT user_id, count(*) n, count(*) FILTER (s*p < 0) sc, avg(score) FILTER (i <= floor(k/2)) a, avg(score) FILTER (i > floor(k/2)) b FROM q GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT *, CASE WHEN a <> 0 THEN (b-a)/abs(a) ELSE 0 END rel FROM h)
 SELECT user_id, n, sc sign_changes, {r('rel')} AS change, CASE WHEN rel > 0.3 THEN 'rising' WHEN rel < -0.3 THEN 'falling' WHEN sc >= 2 THEN 'oscillating' ELSE 'flat' END shape FROM c"""))
def half_split_shape(spark, d):
    return T.half_split(events(spark, d), ["user_id"], ["ts", "id"], "score")


@register("direction_trend_last5", ev(""", b AS (SELECT user_id, ts, id, score, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) k FROM ev), l AS (SELECT user_id, score - lag(score) OVER (PARTITION BY user_id ORDER BY ts, id) dd FROM b WHERE k <= 5),
 c AS (SELECT user_id, count(dd) n_steps, count(*) FILTER (dd >= 0.05) ups, count(*) FILTER (dd <= -0.05) downs FROM l GROUP BY 1) SELECT *, CASE WHEN n_steps > 0 AND ups >= 0.6*n_steps THEN 'rising' WHEN n_steps > 0 AND downs >= 0.6*n_steps THEN 'falling' ELSE 'steady' END trend FROM c"""))
def direction_trend_last5(spark, d):
    return T.direction_of_last(events(spark, d), ["user_id"], "score")


@register("series_summary", ev(f""", z AS (SELECT tool, count(*) n, min(value) least, max(value) most, avg(value) mean, quantile_cont(value,0.25) p25, median(value) med, quantile_cont(value,0.75) p75, quantile_cont(value,0.95) p95, stddev_samp(value) sd, skewness(value) sk FROM ev GROUP BY 1)
 SELECT tool, n, {r('least')} least, {r('most')} most, {r('mean')} mean, {r('p25')} p25, {r('med')} median, {r('p75')} p75, {r('p95')} p95, {r('sd')} sd, {r('p75-p25')} iqr, {r('sk')} skewness, {r('sd/abs(mean)')} cv FROM z"""))
def series_summary(spark, d):
    return ST.summary(events(spark, d), "value", ["tool"])


@register("daily_regression", ev(DAILY + f", x AS (SELECT tool, n, date_diff('day', DATE '2024-01-01', day) i FROM dl) SELECT tool, count(*) n, {r('regr_slope(x.n, i)', 6)} slope, {r('regr_intercept(x.n, i)')} intercept, {r('regr_r2(x.n, i)')} r2 FROM x GROUP BY 1"))
def daily_regression(spark, d):
    s = _daily(spark, d).withColumn("i", F.date_diff("day", F.lit("2024-01-01").cast("date")))
    return ST.regression(s, "i", "n", ["tool"])


@register("daily_correlations", ev(DAILY + f" SELECT a.tool a, b.tool b, count(*) n, {r('corr(a.score, b.score)')} r, {r('least(1.0, count(*)/20.0)')} confidence FROM dl a JOIN dl b ON a.day=b.day AND a.tool < b.tool GROUP BY 1,2 HAVING count(*) >= 7"))
def daily_correlations(spark, d):
    return ST.correlation_pairs(_daily(spark, d), "tool", "day", "score")


@register("spearman_by_project", ev(f", k AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY value, id) a, row_number() OVER (PARTITION BY project ORDER BY turns, id) b FROM ev) SELECT project, count(*) n, {r('corr(a, b)')} rho FROM k GROUP BY 1"))
def spearman_by_project(spark, d):
    return ST.spearman(events(spark, d), "value", "turns", "id", ["project"])


@register("value_outliers", ev(""", s AS (SELECT tool, avg(value) m, stddev_samp(value) sd, quantile_cont(value,0.25) q1, quantile_cont(value,0.75) q3 FROM ev GROUP BY 1), o AS (SELECT tool, id, value, abs(value-m) > 2.5*sd AS by_z, (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1)) by_iqr FROM ev JOIN s USING (tool)) SELECT * FROM o WHERE by_z OR by_iqr"""))
def value_outliers(spark, d):
    return ST.outliers(events(spark, d).select("tool", "id", "value"), "value", ["tool"])


@register("daily_trend_test", ev(DAILY + f""", p AS (SELECT a.tool, sum(sign(b.n-a.n)) s, count(*) k, median((b.n-a.n)/date_diff('day',a.day,b.day)::DOUBLE) sen FROM dl a JOIN dl b ON a.tool=b.tool AND a.day<b.day GROUP BY 1),
 t AS (SELECT tool, sum(c) n, sum(c*(c-1)*(2*c+5)) tied FROM (SELECT tool, n, count(*) c FROM dl GROUP BY 1,2) GROUP BY 1), v AS (SELECT *, (n*(n-1)*(2*n+5)-tied)/18.0 var FROM p JOIN t USING (tool) WHERE n >= 4),
 z AS (SELECT *, CASE WHEN var<=0 THEN 0 WHEN s>0 THEN (s-1)/sqrt(var) WHEN s<0 THEN (s+1)/sqrt(var) ELSE 0 END z FROM v), e AS (SELECT *, abs(z)/sqrt(2.0) x, 1/(1+0.3275911*abs(z)/sqrt(2.0)) q FROM z),
 c AS (SELECT *, 2*(1-(1+1-q*(0.254829592+q*(-0.284496736+q*(1.421413741+q*(-1.453152027+q*1.061405429))))*exp(-x*x))/2) p FROM e)
 SELECT tool, CAST(n AS BIGINT) n, CAST(s AS BIGINT) s, {r('s/k')} tau, {r('z')} z, {r('p')} p, {r('sen')} sen_slope, CASE WHEN p<0.05 AND s>0 THEN 'up' WHEN p<0.05 AND s<0 THEN 'down' ELSE 'none' END trend FROM c"""))
def daily_trend_test(spark, d):
    s = _daily(spark, d).withColumn("i", F.date_diff("day", F.lit("2024-01-01").cast("date")))
    return ST.mann_kendall(s, ["tool"], "i", "n")


@register("shrunk_scores", ev(f", m AS (SELECT user_id, count(*) n, avg(score) mean FROM ev GROUP BY 1), p AS (SELECT sum(n*mean)/sum(n) q FROM m) SELECT user_id, n, {r('mean')} mean, {r('(n*mean+10*q)/(n+10)')} shrunk FROM m, p"))
def shrunk_scores(spark, d):
    return ST.shrunk_means(events(spark, d), ["user_id"], "score")


@register("trait_contrast", ev(f""", s AS (SELECT project, count(*) FILTER (turns>=50) a, count(*) FILTER (turns<50) b, avg(score) FILTER (turns>=50) ma, avg(score) FILTER (turns<50) mb, var_samp(score) FILTER (turns>=50) va, var_samp(score) FILTER (turns<50) vb FROM ev GROUP BY 1),
 e AS (SELECT *, {r('(ma-mb)/sqrt(((a-1)*va+(b-1)*vb)/(a+b-2))')} eff FROM s WHERE a>=3 AND b>=3) SELECT project, a n_with, b n_without, {r('ma/mb')} ratio, eff effect, CASE WHEN abs(eff)>=0.8 THEN 'large' WHEN abs(eff)>=0.5 THEN 'medium' WHEN abs(eff)>=0.2 THEN 'small' ELSE 'negligible' END band FROM e"""))
def trait_contrast(spark, d):
    return ST.contrast(events(spark, d).withColumn("long", F.col("turns") >= 50), ["project"], "long", "score")


@register("forgetting_curve", ev(f""", l AS (SELECT user_id, count(*) n, date_diff('second', max(ts), (SELECT as_of FROM newest))/86400.0 d, least(10.0, avg(score)*10) base FROM ev GROUP BY 1) SELECT user_id, n, {r('CASE WHEN d > 0 THEN 1/(1+d/(9.0*(1+n/10.0))) ELSE 1 END')} retrievability,
 {r('greatest(base*CASE WHEN d > 0 THEN 1/(1+d/(9.0*(1+n/10.0))) ELSE 1 END, 2.0)')} current, CASE WHEN d<=7 THEN 1.0 WHEN d<=30 THEN 0.7 WHEN d<=90 THEN 0.3 ELSE 0.1 END::DOUBLE weight FROM l"""))
def forgetting_curve(spark, d):
    e = events(spark, d)
    last = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.least(F.lit(10.0), F.avg("score") * 10).alias("base"))
    aged = last.join(F.broadcast(R.as_of(e))).withColumn("days", (F.unix_timestamp("as_of") - F.unix_timestamp("last")) / 86400.0)
    stability = 1 + F.col("n") / 10.0
    return aged.select("user_id", "n", N.half_up(N.retrievability(F.col("days"), stability), 4).alias("retrievability"), N.half_up(N.decayed(F.col("base"), F.col("days"), stability, 2.0), 4).alias("current"), N.recency_weight(F.col("days")).alias("weight"))


@register("evidence_weight", ev(f"SELECT user_id, {r("least(1.0, sum(score*0.1*exp(-ln(2.0)*date_diff('second', ts, as_of)/86400.0/14)))")} weight FROM ev, newest GROUP BY 1"))
def evidence_weight(spark, d):
    e = events(spark, d)
    age = (F.unix_timestamp("as_of") - F.unix_timestamp("ts")) / 86400.0
    return R.at(e, R.as_of(e)).groupBy("user_id").agg(N.half_up(F.least(F.lit(1.0), F.sum(F.col("score") * 0.1 * N.half_life(age))), 4).alias("weight"))


@register("week_keys", ev("SELECT CAST(ts AS DATE) AS day, year(ts) || '-W' || lpad(CAST(CAST(floor((dayofyear(ts)-1)/7)+1 AS BIGINT) AS VARCHAR),2,'0') AS week, isoyear(ts) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR),2,'0') iso, count(*) n FROM ev GROUP BY ALL"))
def week_keys(spark, d):
    day = F.to_date("ts")
    return events(spark, d).groupBy(day.alias("day"), S.week_key(day).alias("week"), S.iso_week(day).alias("iso")).agg(F.count("*").alias("n"))


@register("heatmap_days", ev(""", c AS (SELECT CAST(ts AS DATE) dd, count(*) n FROM ev WHERE source = 'ai' GROUP BY 1), g AS (SELECT CAST(unnest(generate_series(CAST(as_of AS DATE) - 89, CAST(as_of AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM newest) SELECT day, coalesce(n,0) n, CASE WHEN coalesce(n,0)=0 THEN 0 WHEN n<=50 THEN 1 WHEN n<=130 THEN 2 WHEN n<=140 THEN 3 ELSE 4 END AS level FROM g LEFT JOIN c ON dd = day"""))
def heatmap_days(spark, d):
    e = events(spark, d)
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("source") == "ai").alias("n"))
    n = F.col("n")
    return R.calendar(days, "day", "n", 90).withColumn("level", F.when(n == 0, 0).when(n <= 50, 1).when(n <= 130, 2).when(n <= 140, 3).otherwise(4))


@register("hourly_snapshots", ev("SELECT date_trunc('hour', ts) AS hour, arg_max(id, row(ts,id)) last_id, count(*) n FROM ev, newest WHERE ts > as_of - INTERVAL 48 HOUR GROUP BY 1"))
def hourly_snapshots(spark, d):
    e = events(spark, d)
    return R.at(e, R.as_of(e)).where("ts > as_of - interval 48 hours").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("id", F.struct("ts", "id")).alias("last_id"), F.count("*").alias("n"))


@register("domain_pairs_by_day", ev(", x AS (SELECT DISTINCT CAST(ts AS DATE) dd, branch FROM ev) SELECT a.branch a, b.branch b, count(*) n, min(a.dd) first_day FROM x a JOIN x b ON a.dd=b.dd AND a.branch<b.branch GROUP BY 1,2"))
def domain_pairs_by_day(spark, d):
    x = events(spark, d).select(F.to_date("ts").alias("dd"), "branch").distinct()
    return x.withColumnRenamed("branch", "a").join(x.withColumnRenamed("branch", "b"), "dd").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("dd").alias("first_day"))


@register("recent_context", ev("SELECT id, ts, tool FROM ev, newest WHERE ts >= as_of - INTERVAL 2 HOUR AND project = 2"))
def recent_context(spark, d):
    e = events(spark, d)
    return R.at(e, R.as_of(e)).where("ts >= as_of - interval 2 hours and project = 2").select("id", "ts", "tool")


@register("history_page", ev("SELECT id, ts FROM ev WHERE source='ai' AND turns = 7 ORDER BY ts DESC, id LIMIT 50 OFFSET 10"))
def history_page(spark, d):
    return events(spark, d).where("source = 'ai' and turns = 7").orderBy(F.desc("ts"), "id").offset(10).limit(50).select("id", "ts")


@register("tool_entropy", ev(f", c AS (SELECT user_id, tool, count(*) n FROM ev GROUP BY 1,2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) p FROM c) SELECT user_id, {r('-sum(p*log2(p))')} entropy FROM p GROUP BY 1"))
def tool_entropy(spark, d):
    c = events(spark, d).groupBy("user_id", "tool").agg(F.count("*").alias("n"))
    whole = c.groupBy("user_id").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return c.join(whole, "user_id").groupBy("user_id").agg(N.half_up(-F.sum(p * F.log2(p)), 4).alias("entropy"))


@register("column_coverage", ev("SELECT source, count(*) n, count(turns) n_turns, count(score) n_score, count(*) FILTER (outcome='partial') n_partial FROM ev GROUP BY 1"))
def column_coverage(spark, d):
    return events(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count("turns").alias("n_turns"), F.count("score").alias("n_score"), F.count_if(F.col("outcome") == "partial").alias("n_partial"))


@register("cost_by_quality", ev(f""", q AS (SELECT CAST(ts AS DATE) dd, sum(cost)/sum(score) c FROM ev GROUP BY 1), m AS (SELECT a.dd AS day, a.c, avg(b.c) t FROM q a JOIN q b ON b.dd < a.dd AND b.dd >= a.dd - 7 GROUP BY 1,2)
 SELECT day, {r('c/t')} ratio, CASE WHEN c/t < 0.85 THEN 'better' WHEN c/t > 1.15 THEN 'worse' ELSE 'same' END band FROM m"""))
def cost_by_quality(spark, d):
    q = events(spark, d).groupBy(F.to_date("ts").alias("day")).agg((F.sum("cost") / F.sum("score")).alias("c"))
    back = q.select(F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 7))).alias("day"), F.col("c").alias("b"))
    m = q.join(back, "day").groupBy("day", "c").agg(F.avg("b").alias("t"))
    ratio = F.col("c") / F.col("t")
    return m.select("day", N.half_up(ratio, 4).alias("ratio"), F.when(ratio < 0.85, "better").when(ratio > 1.15, "worse").otherwise("same").alias("band"))
