"""Queries of spend, efficiency and their course over days, and the rules that correlate several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as RU
from ..operators import progress as P
from ..operators import scores as SC
from .adapter import exact, r
from .adapter import with_exact as ex
from .catalog import register


def _ai() -> Column:
    return F.col("source") == "ai"


def _whole(x: str) -> str:
    """SQL that rounds half up to a whole number."""
    return f"CAST({r(x, 0)} AS BIGINT)"


# --- spend


@register("trailing_spend", ex(", d AS (SELECT day, sum(cents) c FROM ex GROUP BY 1 ORDER BY day DESC LIMIT 7) SELECT count(*) n_days, CAST(sum(c) AS DOUBLE) / 100 AS total FROM d"))
def trailing_spend(spark, d):
    """The last seven days that have data, not the last seven of the calendar."""
    days = exact(spark, d).groupBy("day").agg(F.sum("cents").alias("c")).orderBy(F.desc("day")).limit(7)
    return days.agg(F.count("*").alias("n_days"), (F.sum("c").cast("double") / 100).alias("total"))


@register("spend_by_day_ranked", ex(", d AS (SELECT day, tool, sum(cents) c FROM ex GROUP BY 1, 2) SELECT day, tool, CAST(c AS DOUBLE)/100 AS cost, CAST(sum(c) OVER (PARTITION BY day) AS DOUBLE)/100 AS day_cost, row_number() OVER (PARTITION BY day ORDER BY c DESC, tool) AS place FROM d"))
def spend_by_day_ranked(spark, d):
    cost = exact(spark, d).groupBy("day", "tool").agg(F.sum("cents").alias("c"))
    day = Window.partitionBy("day")
    return cost.select("day", "tool", (F.col("c").cast("double") / 100).alias("cost"), (F.sum("c").over(day).cast("double") / 100).alias("day_cost"), F.row_number().over(day.orderBy(F.desc("c"), "tool")).cast("long").alias("place"))


@register("context_overhead", ex(f"SELECT project, {r('1 - sum(sec) / count(sec) / 60.0', 2)} AS overhead FROM ex WHERE source = 'ai' GROUP BY 1"))
def context_overhead(spark, d):
    return exact(spark, d).where(_ai()).groupBy("project").agg(N.half_up(1 - F.sum("sec") / F.count("sec") / 60.0, 2).alias("overhead"))


@register("period_length", ex(f"SELECT project, greatest(1, {_whole('(epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000')}) AS n_days FROM ex WHERE source = 'ai' GROUP BY 1"))
def period_length(spark, d):
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86400000000
    return exact(spark, d).where(_ai()).groupBy("project").agg(F.greatest(F.lit(1), N.half_up(span).cast("long")).alias("n_days"))


@register("abandoned_waste", ex("SELECT coalesce(tool, 'unknown') model, count(*) n, CAST(sum(cents) AS DOUBLE)/100 AS cost FROM ex WHERE source = 'ai' AND s4 < 500 GROUP BY 1"))
def abandoned_waste(spark, d):
    """What was spent on work that was given up (a direction score under 0.05 stands for that outcome)."""
    lost = exact(spark, d).where(_ai() & (F.col("s4") < 500))
    return lost.groupBy(F.coalesce("tool", F.lit("unknown")).alias("model")).agg(F.count("*").alias("n"), (F.sum("cents").cast("double") / 100).alias("cost"))


# --- efficiency


_DAY_METRICS = f""", w AS (SELECT ex.* FROM ex, newest WHERE source = 'ai' AND ts >= as_of - INTERVAL 24 HOUR), dep AS (SELECT project, sum(s4) / count(*) / 1e4 AS assessed FROM ex WHERE source = 'other' GROUP BY 1),
 m AS (SELECT project, count(*) n, {_whole('100 * (sum(s4) / count(*) / 1e4)')} direction, {_whole('100 * (count(*) FILTER (s4 >= 5000) / count(*))')} directed, {_whole('(1 - least(sum(tc) / count(tc), 10) / 10) * 100')} iteration, {_whole('100 * (sum(sec) / count(sec) / 60.0)')} leverage,
 1 + count(*) FILTER (phase = 'view') / count(*) * 0.5 - count(*) FILTER (phase = 'error') / count(*) * 0.3 AS phase, 1 - count(*) FILTER (outcome = 'failed') / count(*) * 0.2 AS adjusted FROM w GROUP BY 1),
 k AS (SELECT m.*, {_whole('100 * coalesce(assessed, 0)')} AS depth FROM m LEFT JOIN dep USING (project)),
 e AS (SELECT *, {_whole('greatest(0, least(100, (0.30 * direction + 0.20 * directed + 0.20 * iteration + 0.15 * leverage + 0.15 * depth) * phase * adjusted))')} AS efficiency FROM k)"""


def _efficiency(spark, d) -> DataFrame:
    events = exact(spark, d)
    assessed = events.where(F.col("source") == "other").groupBy("project").agg((F.sum("s4") / F.count("*") / 1e4).alias("assessed"))
    return P.efficiency_day(events.where(_ai()), events.agg(F.max("ts").alias("as_of")), assessed, ["project"])


@register("efficiency_day", ex(_DAY_METRICS + " SELECT project, n, direction, directed, iteration, leverage, depth, efficiency, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END confidence FROM e"))
def efficiency_day(spark, d):
    """The five metrics of the last 24 hours and their blend, as whole percents."""
    return _efficiency(spark, d).withColumn("confidence", SC.confidence_band(F.col("n")))


_HISTORY = f", h0 AS (SELECT day, {_whole('sum(s4) / count(*) / 100')} AS aes FROM ex GROUP BY 1 ORDER BY day DESC LIMIT 30), h AS (SELECT day, aes, row_number() OVER (ORDER BY day) i, count(*) OVER () n FROM h0)"


@register("efficiency_history", ex(_HISTORY + " SELECT i, day, aes FROM h"))
def efficiency_history(spark, d):
    return P.latest_snapshots(_snapshots(spark, d), "day", 30).select("i", "day", "aes")


def _snapshots(spark, d) -> DataFrame:
    return exact(spark, d).groupBy("day").agg(N.half_up(F.sum("s4") / F.count("*") / 100).cast("long").alias("aes"))


@register("weekly_trend", ex(_HISTORY + ", x AS (SELECT avg(aes) FILTER (i > n - 7) a, avg(aes) FILTER (i <= n - 7 AND i > n - 14) b, count(*) n, count(*) FILTER (i <= n - 7 AND i > n - 14) m FROM h) SELECT n, CASE WHEN n < 7 OR m < 3 THEN NULL WHEN a - b > 5 THEN 'improving' WHEN a - b < -5 THEN 'declining' ELSE 'stable' END trend FROM x"))
def weekly_trend(spark, d):
    return P.week_over_week(P.latest_snapshots(_snapshots(spark, d), "day", 30), "aes")


@register("comprehension_delta", ex(f"SELECT user_id, CASE WHEN count(*) < 2 THEN 50 ELSE {_whole('greatest(0, least(100, 50 + (arg_max(s4, row(ts, id)) - arg_min(s4, row(ts, id))) / 100.0))')} END AS delta FROM ex GROUP BY 1"))
def comprehension_delta(spark, d):
    order = F.struct("ts", "id")
    change = (F.max_by("s4", order) - F.min_by("s4", order)) / 100.0
    return exact(spark, d).groupBy("user_id").agg(F.when(F.count("*") < 2, 50).otherwise(N.half_up(N.clamp(50 + change, 0.0, 100.0)).cast("long")).alias("delta"))


@register("reasoning_velocity", ex(f", h AS (SELECT project, day, sum(s4) / count(*) / 100 AS rdi FROM ex GROUP BY 1, 2), q AS (SELECT project, rdi, row_number() OVER (PARTITION BY project ORDER BY day) - 1 AS x, row_number() OVER (PARTITION BY project ORDER BY day DESC) AS y FROM h WHERE rdi > 0), z AS (SELECT project, count(*) n, regr_slope(rdi, x) m, avg(rdi) AS mean FROM q WHERE y <= 30 GROUP BY 1) SELECT project, n, CASE WHEN n >= 7 THEN {_whole('m * n / mean * 100')} END AS percent, CASE WHEN n >= 7 THEN {r('m', 3)} END AS slope FROM z"))
def reasoning_velocity(spark, d):
    """Change of the daily mean over the last thirty days that have one, in percent of their mean; null for fewer than seven."""
    daily = exact(spark, d).groupBy("project", "day").agg((F.sum("s4") / F.count("*") / 100).alias("rdi"))
    return P.reasoning_velocity(daily.where("rdi > 0"), ["project"], "day", "rdi")


@register("slope_trends", ex(f", h AS (SELECT branch, day, sum(s4) / count(*) / 100 AS v FROM ex GROUP BY 1, 2), q AS (SELECT branch, v, row_number() OVER (PARTITION BY branch ORDER BY day) AS x FROM h), z AS (SELECT branch, count(*) n, regr_slope(v, x) m, stddev_pop(v) s FROM q GROUP BY 1) SELECT branch, n, {r('m', 2)} AS magnitude, CASE WHEN s > 0 AND abs(m) / (s / sqrt(n)) > 2 THEN CASE WHEN m > 0 THEN 'accelerating' ELSE 'decelerating' END ELSE 'stable' END direction, CASE WHEN n >= 14 THEN 'high' WHEN n >= 7 THEN 'medium' ELSE 'low' END confidence FROM z WHERE n >= 4"))
def slope_trends(spark, d):
    daily = exact(spark, d).groupBy("branch", "day").agg((F.sum("s4") / F.count("*") / 100).alias("v"))
    return P.slope_trend(daily, ["branch"], "day", "v")


@register("three_point_trends", ex(f", h AS (SELECT branch, day, sum(s4) / count(*) AS v FROM ex GROUP BY 1, 2), s AS (SELECT a.branch, sum(sign(b.v - a.v)) s FROM h a JOIN h b ON a.branch = b.branch AND a.day < b.day GROUP BY 1), c AS (SELECT branch, count(*) n FROM h GROUP BY 1), z AS (SELECT branch, n, coalesce(s, 0) s, (coalesce(s, 0) - sign(coalesce(s, 0))) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) z FROM c LEFT JOIN s USING (branch)), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) t FROM z), p AS (SELECT *, 2 * (1 - 0.5 * (1 + (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2)))) p FROM t) SELECT branch, n, CAST(s AS BIGINT) s, {r('p', 6)} AS p, CASE WHEN n < 3 THEN 'stable' WHEN s / (n * (n - 1) / 2) > 0.3 AND p < 0.05 THEN 'improving' WHEN s / (n * (n - 1) / 2) < -0.3 AND p < 0.05 THEN 'declining' ELSE 'stable' END trend FROM p"))
def three_point_trends(spark, d):
    """Mann-Kendall from three points on, without a correction for ties and with the second form of the normal distribution."""
    daily = exact(spark, d).groupBy("branch", "day").agg((F.sum("s4") / F.count("*")).alias("v"))
    return P.mann_kendall(daily, ["branch"], "day", "v")


@register("running_means", ex(f", q AS (SELECT user_id, s4, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) i, count(*) OVER (PARTITION BY user_id) n FROM ex) SELECT user_id, {r('sum(s4 * CASE WHEN i = 1 THEN pow(1/3, n - 1) ELSE 2/3 * pow(1/3, n - i) END) / 1e4')} AS mean FROM q GROUP BY 1"))
def running_means(spark, d):
    """After the first value, each new one weighs twice the old mean."""
    return P.leaning_mean(exact(spark, d), ["user_id"], ["ts", "id"], F.col("s4") / 1e4).select("user_id", N.half_up(F.col("mean"), 4).alias("mean"))


# --- reasoning depth, engagement, projection


_ORDERS = """ds AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderpriority AS domain, count(l_linenumber) AS alternatives, bool_or(l_returnflag = 'R') AS dead, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS recovered, bool_or(l_discount >= 0.08) AS traded FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"""


def _decisions(spark, d) -> DataFrame:
    """Orders as decisions: their lines are the alternatives, returned ones dead ends, high discounts trade-offs."""
    from .adapter import table

    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    met = o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("domain")).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    returned = F.col("l_returnflag") == "R"
    return met.groupBy("day", "o_orderkey", "domain").agg(F.count("l_linenumber").alias("alternatives"), F.bool_or(returned).alias("dead"), F.bool_or(returned & (F.col("l_linestatus") == "F")).alias("recovered"), F.bool_or(F.col("l_discount") >= 0.08).alias("traded"))


_RDI = """x AS (SELECT day, count(*) n, least(1, avg(alternatives) / 5) alt, least(1, count(*) FILTER (traded) / count(*)) trade, CASE WHEN count(*) FILTER (dead) = 0 THEN 0.5 ELSE count(*) FILTER (dead AND recovered) / count(*) FILTER (dead) END rec, CASE WHEN count(DISTINCT domain) >= 2 THEN 1.0 ELSE 0.0 END AS cross_,
 count(DISTINCT domain) AS span, sum((0.3 * least(1, 1 / 20) + 0.2 * least(1, alternatives / 5) + CASE WHEN traded THEN 0.2 ELSE 0 END) * least(1, alternatives / 5)) wa, sum(0.3 * least(1, 1 / 20) + 0.2 * least(1, alternatives / 5) + CASE WHEN traded THEN 0.2 ELSE 0 END) w FROM ds GROUP BY 1)"""


@register("reasoning_depth", f"WITH {_ORDERS}, {_RDI} SELECT day, n, {_whole('greatest(0, least(100, 100 * (0.3 * alt + 0.25 * trade + 0.25 * rec + 0.2 * cross_)))')} AS rdi, {_whole('greatest(0, least(100, 100 * (0.3 * wa / w + 0.25 * trade + 0.25 * rec + 0.2 * cross_)))')} AS gravity_rdi FROM x")
def reasoning_depth(spark, d):
    """Per day, the depth index, and the same with each decision's alternatives weighted by its gravity."""
    return RU.reasoning_depth(_decisions(spark, d), ["day"])


@register("engagement_quality", ex(", u AS (SELECT user_id, least(10, sum(s4) / count(*) / 500) steer, least(10, sum(tc) / count(tc)) under, count(*) FILTER (outcome = 'failed') push, count(*) FILTER (s4 < 500) stamps FROM ex GROUP BY 1) SELECT user_id, CAST(CASE WHEN steer + under >= 14 AND push > 0 THEN 5 WHEN steer + under >= 10 THEN 4 WHEN steer <= 3 AND push = 0 AND stamps > 2 THEN 1 WHEN steer + under <= 6 THEN 2 ELSE 3 END AS INTEGER) AS quality FROM u"))
def engagement_quality(spark, d):
    u = exact(spark, d).groupBy("user_id").agg(
        F.least(F.lit(10.0), F.sum("s4") / F.count("*") / 500).alias("steer"), F.least(F.lit(10.0), F.sum("tc") / F.count("tc")).alias("under"), F.count_if(F.col("outcome") == "failed").alias("push"), F.count_if(F.col("s4") < 500).alias("stamps")
    )
    return u.select("user_id", RU.engagement_quality(F.col("steer"), F.col("under"), F.col("push"), F.col("stamps")).alias("quality"))


@register("capability_projection", ex(f", h AS (SELECT branch, datediff('day', DATE '2024-01-01', day) x, sum(s4) / count(*) / 1e4 AS y FROM ex GROUP BY 1, 2), z AS (SELECT branch, count(*) n, regr_slope(y, x) m, max(x) last_x, arg_max(y, x) AS now FROM h GROUP BY 1) SELECT branch, n, CASE WHEN n >= 3 AND m > 0 AND now < 0.75 THEN {r('last_x + (0.75 - now) / m', 3)} END AS reached FROM z"))
def capability_projection(spark, d):
    """The day, counted from 2024-01-01, on which the line through a branch's daily means reaches 0.75; null if it does not."""
    daily = exact(spark, d).groupBy("branch", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("x")).agg((F.sum("s4") / F.count("*") / 1e4).alias("y"))
    return P.projected(daily, ["branch"], "x", "y", 0.75)


@register("feedback_thresholds", ex(f", f AS (SELECT tool, count(*) FILTER (s4 < 3000) / count(*) u FROM ex GROUP BY 1) SELECT tool, {r('CASE WHEN u > 0.3 THEN 0.3 + (u - 0.3) * (0.3 / (1 - 0.3)) ELSE 0.3 END')} AS threshold FROM f"))
def feedback_thresholds(spark, d):
    u = exact(spark, d).groupBy("tool").agg((F.count_if(F.col("s4") < 3000) / F.count("*")).alias("u"))
    return u.select("tool", N.half_up(RU.feedback_threshold(F.col("u")), 4).alias("threshold"))


_DUAL = f""", g AS (SELECT project, count(DISTINCT day) nd, count(*) FILTER (source = 'ai') na, count(*) FILTER (source = 'git') ng, sum(s4) FILTER (source = 'ai') / count(*) FILTER (source = 'ai') / 1e4 AS eff FROM ex GROUP BY 1),
 v AS (SELECT project, least(1, na / nd / 20) * 0.5 + least(1, eff) * 0.5 AS a, least(1, ng / nd / 10) * 0.6 + least(1, ng / na) * 0.4 AS b, least(1, ng / na) AS rate FROM g), y AS (SELECT *, CASE WHEN b > 0 THEN {r('a / b', 2)} WHEN a > 0 THEN 10 ELSE 1 END ratio FROM v)"""


@register("dual_velocity", ex(_DUAL + f" SELECT project, ratio, CASE WHEN a < 0.2 AND b < 0.2 THEN 'both-low' WHEN ratio > 2 THEN 'ai-heavy' WHEN ratio < 0.5 THEN 'git-heavy' ELSE 'balanced' END alignment, CASE WHEN a > 0 THEN {r('rate * b / a', 3)} ELSE 0 END AS translation FROM y"))
def dual_velocity(spark, d):
    n = lambda s: F.count_if(F.col("source") == s)
    g = exact(spark, d).groupBy("project").agg(F.countDistinct("day").alias("nd"), n("ai").alias("na"), n("git").alias("ng"), (F.sum(F.when(_ai(), F.col("s4"))) / n("ai") / 1e4).alias("eff"))
    return g.select("project", *RU.dual_velocity(F.col("na") / F.col("nd"), F.col("eff"), F.col("ng") / F.col("nd"), F.least(F.lit(1.0), F.col("ng") / F.col("na"))))


@register("ownership_adjusted", ex(f", g AS (SELECT project, least(1, count(DISTINCT user_id) / 40) AS own, 1 + 3 * (sum(s4) / count(*) / 1e4) AS phase FROM ex GROUP BY 1) SELECT project, {r('phase * (0.5 + own * 0.5)', 2)} AS adjusted, CASE WHEN own > 0.6 THEN 'genuine' WHEN own > 0.3 THEN 'mixed' ELSE 'hollow' END genuineness FROM g"))
def ownership_adjusted(spark, d):
    g = exact(spark, d).groupBy("project").agg(F.least(F.lit(1.0), F.countDistinct("user_id") / 40).alias("own"), (1 + 3 * (F.sum("s4") / F.count("*") / 1e4)).alias("phase"))
    return g.select("project", *RU.ownership_adjusted(F.col("phase"), F.col("own")))


# --- correlation rules over the outputs of several analyzers


_RULES = f""", dom AS (SELECT branch, {_whole('sum(s4) / count(*) / 100')} AS comp, count(*) n, count(*) FILTER (s4 < 2000) low, sum(cents) c FROM ex GROUP BY 1), tot AS (SELECT sum(c) c, sum(low) / sum(n) AS waste FROM dom),
 tr AS (SELECT CASE WHEN avg(aes) FILTER (i > n - 7) - avg(aes) FILTER (i <= n - 7 AND i > n - 14) < 0 THEN 'declining' ELSE 'other' END trend, max(aes) FILTER (i = n) AS aes FROM h),
 loops AS (SELECT branch, low AS occ FROM dom WHERE low / n > 0.2), half AS (SELECT branch, avg(tc) FILTER (k <= m) a, avg(tc) FILTER (k > m) b FROM (SELECT branch, tc, row_number() OVER (PARTITION BY branch ORDER BY ts, id) k, count(*) OVER (PARTITION BY branch) // 2 AS m FROM ex WHERE source = 'ai') q GROUP BY 1),
 res AS (SELECT 'efficiency-blind-spot' rule, CASE WHEN count(*) >= 2 OR max(aes) < 40 THEN 'critical' ELSE 'warning' END severity, min(branch) AS domain FROM dom, tr WHERE comp < 40 AND n >= 3 AND trend = 'declining' HAVING count(*) > 0
 UNION ALL SELECT 'cost-loop', CASE WHEN max(waste) > 0.4 THEN 'critical' ELSE 'warning' END, min(branch) FROM loops, tot WHERE waste >= 0.2 HAVING count(*) > 0
 UNION ALL SELECT 'velocity-comprehension', CASE WHEN min(comp) < 30 THEN 'warning' ELSE 'info' END, arg_min(branch, row(comp, branch)) FROM dom JOIN half USING (branch) WHERE b > a AND comp < 50 HAVING count(*) > 0
 UNION ALL SELECT 'pattern-efficiency', 'info', arg_max(branch, row(comp, branch)) FROM dom, tr WHERE aes >= 60 HAVING count(*) > 0
 UNION ALL SELECT 'expertise-cost', 'warning', arg_max(branch, row(dom.c, branch)) FROM dom, tot WHERE comp >= 40 AND 100.0 * dom.c / tot.c >= 10 HAVING count(*) > 0
 UNION ALL SELECT 'blind-spot-acceptance', 'critical', min(branch) FROM dom WHERE comp < 40 AND low / n > 0.25 HAVING count(*) > 0)"""


@register("correlation_rules", ex(_HISTORY + _RULES + " SELECT * FROM res"))
def correlation_rules(spark, d):
    """Six rules, each over the outputs of two analyzers; a rule gives a row if it holds."""
    events = exact(spark, d)
    domains = events.groupBy(F.col("branch").alias("domain")).agg(N.half_up(F.sum("s4") / F.count("*") / 100).cast("long").alias("comprehension"), F.count("*").alias("n"), F.count_if(F.col("s4") < 2000).alias("low"), F.sum("cents").alias("cost"))
    trend = P.week_over_week(P.latest_snapshots(_snapshots(spark, d), "day", 30), "aes", band=0.0).select("trend")
    latest = _snapshots(spark, d).agg(F.max_by("aes", "day").alias("aes"))
    halves = P.half_means(events.where(_ai()), ["branch"], ["ts", "id"], "tc").withColumnRenamed("branch", "domain")
    return RU.correlations(domains, trend.crossJoin(F.broadcast(latest)), halves, expert=40, share=10.0)
