"""Analyzers: named queries with their inputs, run in the order of their dependencies; composites of several metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import dialogue as D
from ..operators import rollups as R
from ..operators import scores as SC
from .adapter import events, r, table
from .adapter import with_events as ev
from .catalog import register


@dataclass
class Analyzer:
    """``run`` gets the events that pass its sources and the results of what it depends on; it needs ``least`` events."""

    name: str
    run: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    sources: tuple[str, ...] = ()
    depends: tuple[str, ...] = ()
    least: int = 0


@dataclass
class Graph:
    analyzers: dict[str, Analyzer] = field(default_factory=dict)

    def add(self, analyzer: Analyzer) -> None:
        self.analyzers[analyzer.name] = analyzer

    def order(self) -> list[str]:
        """Dependencies first, by name where they leave a choice; those on a cycle come last."""
        left = {n: set(a.depends) & set(self.analyzers) for n, a in self.analyzers.items()}
        out: list[str] = []
        while free := sorted(n for n, d in left.items() if not d):
            out.append(free[0])
            del left[free[0]]
            for d in left.values():
                d.discard(free[0])
        return out + sorted(left)

    def affected(self, changed: set[str]) -> list[str]:
        """What must run again when the results of some have changed."""
        dirty = set(changed)
        for name in self.order():
            if set(self.analyzers[name].depends) & dirty:
                dirty.add(name)
        return [n for n in self.order() if n in dirty]

    def plans(self, log: DataFrame) -> dict[str, DataFrame]:
        """Every analyzer's result as a lazy plan; nothing runs until one is used."""
        out: dict[str, DataFrame] = {}
        for name in self.order():
            a = self.analyzers[name]
            mine = log.where(F.col("source").isin(*a.sources)) if a.sources else log
            out[name] = a.run(mine, out)
        return out


def _efficiency(e: DataFrame) -> DataFrame:
    return SC.efficiency(e, ["project"], F.col("phase") == "view", F.col("phase") == "error", F.col("outcome") == "failed")


def _loops(e: DataFrame) -> DataFrame:
    return e.groupBy("project").agg(N.half_up(N.ratio(F.count_if(F.col("outcome") == "failed"), F.count("*"), 0.0), 4).alias("failed_share"))


def _velocity(e: DataFrame) -> DataFrame:
    daily = e.groupBy("project", F.to_date("ts").alias("day")).agg(F.avg("turns").alias("turns"))
    return R.trend_of_halves(daily, ["project"], "day", "turns").select("project", F.col("change").alias("velocity"), "trend")


def _autonomy(e: DataFrame) -> DataFrame:
    m = e.groupBy("project").agg(
        F.avg("score").alias("direction"), N.ratio(F.count_if(F.col("turns") < 50), F.count("*"), 0.0).alias("independence"), (F.countDistinct("branch") / 7.0).alias("breadth"), (1 - N.clamp(F.stddev_pop("score"))).alias("consistency")
    )
    return m.select("project", N.half_up(100 * SC.blend(SC.AUTONOMY), 2).alias("autonomy"))


def _maturity(e: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
    joined = done["efficiency"].select("project", "efficiency").join(done["loops"], "project").join(done["autonomy"], "project")
    return SC.maturity(joined, ["project"], {"efficiency": (3.0, 0.0, 100.0), "autonomy": (2.0, 0.0, 100.0), "failed_share": (1.0, 0.0, 1.0)})


def graph() -> Graph:
    g = Graph()
    g.add(Analyzer("efficiency", lambda e, _: _efficiency(e), least=5))
    g.add(Analyzer("loops", lambda e, _: _loops(e), least=10))
    g.add(Analyzer("velocity", lambda e, _: _velocity(e), ("ai",), least=10))
    g.add(Analyzer("autonomy", lambda e, _: _autonomy(e), least=5))
    g.add(Analyzer("maturity", _maturity, depends=("efficiency", "loops", "autonomy"), least=20))
    return g


EFF = """, m AS (SELECT project, count(*) n, 100*avg(score) direction, 100.0*count(*) FILTER (score>=0.5)/count(score) directed, 100*greatest(0,least(1,1-avg(turns)/100)) iteration, 100*greatest(0,least(1,avg(value)/100)) leverage, 100*greatest(0,least(1,stddev_pop(score)*2)) AS depth,
 1+0.5*count(*) FILTER (phase='view')/count(*)-0.3*count(*) FILTER (phase='error')/count(*) phase, 1-0.2*count(*) FILTER (outcome='failed')/count(*) outc FROM ev GROUP BY 1),
 ef AS (SELECT *, CAST(floor(greatest(0,least(100,(0.3*direction+0.2*directed+0.2*iteration+0.15*leverage+0.15*depth)*phase*outc))+0.5) AS BIGINT) efficiency FROM m)"""
AUT = f""", au AS (SELECT project, {r("100*(0.3*avg(score)+0.25*(count(*) FILTER (turns<50))/count(*)+0.2*count(DISTINCT branch)/7.0+0.25*(1-greatest(0,least(1,stddev_pop(score)))))", 2)} autonomy FROM ev GROUP BY 1)"""


@register("efficiency_score", ev(EFF + f" SELECT project, n, {r('direction')} direction, {r('directed')} directed, {r('iteration')} iteration, {r('leverage')} leverage, {r('depth')} AS depth, efficiency FROM ef"))
def efficiency_score(spark, d):
    return graph().plans(events(spark, d))["efficiency"]


@register("autonomy_index", ev(AUT + " SELECT * FROM au"))
def autonomy_index(spark, d):
    return graph().plans(events(spark, d))["autonomy"]


@register("project_velocity", ev(f""", dl AS (SELECT project, CAST(ts AS DATE) dd, avg(turns) t FROM ev WHERE source='ai' GROUP BY 1,2), p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY dd) i, count(*) OVER (PARTITION BY project) k FROM dl),
 h AS (SELECT project, avg(t) FILTER (i<=floor(k/2)) a, avg(t) FILTER (i>floor(k/2)) b FROM p GROUP BY 1) SELECT project, {r('(b-a)/a')} velocity, CASE WHEN (b-a)/a > 0.1 THEN 'up' WHEN (b-a)/a < -0.1 THEN 'down' ELSE 'stable' END trend FROM h"""))
def project_velocity(spark, d):
    return graph().plans(events(spark, d))["velocity"]


@register("maturity_level", ev(EFF + AUT + f""", lo AS (SELECT project, {r("count(*) FILTER (outcome='failed')/count(*)::DOUBLE")} fs FROM ev GROUP BY 1), c AS (SELECT project, {r('(3*efficiency/100.0+2*autonomy/100.0+fs)/6.0')} composite FROM ef JOIN au USING (project) JOIN lo USING (project))
 SELECT *, CAST(CASE WHEN composite>=0.7 THEN 4 WHEN composite>=0.45 THEN 3 WHEN composite>=0.2 THEN 2 ELSE 1 END AS BIGINT) AS level FROM c"""))
def maturity_level(spark, d):
    return graph().plans(events(spark, d))["maturity"]


@register("impact_triage", ev(f""", x AS (SELECT branch, avg(score) s, count(DISTINCT user_id)/100.0 re, count(*)/5000.0 fr, count(*) FILTER (outcome='failed')/count(*)::DOUBLE ff FROM ev GROUP BY 1) SELECT branch, {r('100*(0.3*ff+0.25*least(1,re)+0.2*least(1,fr)+0.15*s+0.1)', 1)} impact, CASE WHEN {r('100*s', 2)} >= 60 THEN 'low' WHEN {r('100*s', 2)} >= 35 THEN 'medium' ELSE 'high' END risk FROM x"""))
def impact_triage(spark, d):
    x = events(spark, d).groupBy("branch").agg(F.avg("score").alias("s"), (F.countDistinct("user_id") / 100.0).alias("re"), (F.count("*") / 5000.0).alias("fr"), N.ratio(F.count_if(F.col("outcome") == "failed"), F.count("*"), 0.0).alias("ff"))
    return x.select("branch", SC.impact(F.col("ff"), F.col("re"), F.col("fr"), F.col("s"), F.lit(1.0)).alias("impact"), SC.risk_bucket(N.half_up(100 * F.col("s"), 2)).alias("risk"))


@register("survival_quadrants", ev(f""", x AS (SELECT user_id, {r('100*avg(score)', 2)} a, {r("100*(1-count(*) FILTER (outcome='failed')/count(*)::DOUBLE)", 2)} b FROM ev GROUP BY 1) SELECT *, CASE WHEN a>=50 AND b>=80 THEN 'thriving' WHEN a>=50 THEN 'fast but fragile' WHEN b>=80 THEN 'slow but solid' ELSE 'at risk' END quadrant FROM x"""))
def survival_quadrants(spark, d):
    x = events(spark, d).groupBy("user_id").agg(N.half_up(100 * F.avg("score"), 2).alias("a"), N.half_up(100 * (1 - N.ratio(F.count_if(F.col("outcome") == "failed"), F.count("*"), 0.0)), 2).alias("b"))
    return x.withColumn("quadrant", SC.quadrant(F.col("a") / 50, F.col("b") / 80, 1.0))


@register("prompt_kinds", """SELECT CASE WHEN regexp_matches(text, '(?i)\\b(why|how|what|explain)\\b') THEN 'question' WHEN regexp_matches(text, '(?i)\\b(fix|bug|error|fail)') THEN 'debug' WHEN regexp_matches(text, '(?i)\\b(add|create|write|build|implement)\\b') THEN 'create' ELSE 'other' END kind, count(*) n, CAST(sum(length(text) - length(replace(text, '?', ''))) AS BIGINT) questions FROM conversations GROUP BY 1""")
def prompt_kinds(spark, d):
    f = D.prompt_features(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return f.groupBy("kind").agg(F.count("*").alias("n"), F.sum("questions").alias("questions"))


@register("prompt_specificity", f"""WITH t AS (SELECT *, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 1)) w FROM conversations)
 SELECT conv_id, turn, {r("((w>=10)::INT+(w>=30)::INT+(contains(text,'?'))::INT+regexp_matches(text,'(?m)^[[:space:]]*[-*0-9]')::INT+regexp_matches(text,'[A-Za-z_]+[(]|`')::INT+regexp_matches(text,'(?i)\\b(must|should|only|never|without)\\b')::INT+regexp_matches(text,'[0-9]')::INT+regexp_matches(text,'[A-Za-z0-9_]+[.][a-z]{1,4}\\b')::INT)/8.0").replace('{1,4}', '{1,4}')} specificity FROM t""")
def prompt_specificity(spark, d):
    return D.prompt_features(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "specificity")


_TOKENS = "list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= {0})"


@register("conversation_segments", f"""WITH t AS (SELECT conv_id, turn, text, list_distinct({_TOKENS.format(2)}) x FROM conversations), p AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) y FROM t),
 f AS (SELECT conv_id, turn, CASE WHEN y IS NULL OR len(list_intersect(x, y)) / greatest(1, len(list_distinct(list_concat(x, y)))) < 0.05 OR regexp_matches(text, '(?i)^(now|next|also|instead|actually|ok so)\\b') THEN 1 ELSE 0 END fresh FROM p),
 s AS (SELECT conv_id, turn, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f) SELECT conv_id, segment, min(turn) first_turn, max(turn) last_turn, count(*) n_turns FROM s GROUP BY 1, 2""")
def conversation_segments(spark, d):
    return D.segments(table(spark, d, "conversations"), "conv_id", "turn", "text")


def _said(pattern: str) -> str:
    return f"10 * coalesce(count(*) FILTER (role = 'user' AND regexp_matches(text, '(?i){pattern}')) / nullif(count(*) FILTER (role = 'user'), 0), 0)"


@register("conversation_comprehension", f"""WITH g AS (SELECT conv_id, count(*) FILTER (role = 'user') n_user, {_said('\\b(instead|should|change|use|make)\\b')} steering, {_said('\\b(because|since|why|therefore)\\b')} understanding, {_said('\\b(i think|not sure|maybe|confus)')} metacognition, {_said('\\b(i will|my own|already|i did)\\b')} independence,
 10 * coalesce(greatest(0, least(1, avg(len({_TOKENS.format(1)})) FILTER (role = 'user') / 50)), 0) engagement FROM conversations GROUP BY 1) SELECT conv_id, n_user, {r('steering', 2)} AS steering, {r('understanding', 2)} AS understanding, {r('metacognition', 2)} AS metacognition, {r('independence', 2)} AS independence, {r('engagement', 2)} AS engagement, {r('10 * (0.25 * steering + 0.25 * understanding + 0.15 * metacognition + 0.2 * independence + 0.15 * engagement)', 2)} AS overall FROM g""")
def conversation_comprehension(spark, d):
    return D.comprehension(table(spark, d, "conversations"), "conv_id", "role", "text")


@register("merged_user_states", ev(f""", o AS (SELECT user_id, avg(score) s, max(turns) m, count(*) c FROM ev WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), n AS (SELECT user_id, avg(score) s, max(turns) m, count(*) c FROM ev WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
 SELECT coalesce(o.user_id, n.user_id) user_id, {r('CASE WHEN o.s IS NULL THEN n.s WHEN n.s IS NULL THEN o.s ELSE 0.7*o.s+0.3*n.s END')} s, CASE WHEN o.m IS NULL THEN n.m WHEN n.m IS NULL THEN o.m ELSE greatest(o.m, n.m) END m, coalesce(o.c,0)+coalesce(n.c,0) c FROM o FULL JOIN n ON o.user_id=n.user_id"""))
def merged_user_states(spark, d):
    e = events(spark, d)
    side = lambda x: x.groupBy("user_id").agg(F.avg("score").alias("s"), F.max("turns").alias("m"), F.count("*").alias("c"))
    cut = F.lit("2024-01-16").cast("timestamp")
    out = SC.merge_states(side(e.where(F.col("ts") < cut)), side(e.where(F.col("ts") >= cut)), ["user_id"], {"s": "ewma", "m": "max", "c": "sum"})
    return out.withColumn("s", N.half_up(F.col("s"), 4))
