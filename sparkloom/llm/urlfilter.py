"""URL filters from a tree of path templates, in DataFrame functions only.

Rules (host, path prefix) decide first; the longest that fits wins.  The URLs that rules decide are the labelled examples of
the method, which judges all others:

1. Digit runs and overlong segments become wildcards, and equal (host, path) shapes are counted with their labels.
2. From the root down, level by level and as deep as paths go, a node's rare children become one wildcard where there are
   many.  Levels at which no node could change (few children, all of other depths beneath) are passed in one step, however
   long the paths are.  What results without the host is a pattern; its rate is the smoothed share of blocked labels over all hosts.
3. A branch's rate is the share of its own labels, smoothed towards the rates of its patterns.  Branches of a node that have
   the same depth beneath them, and whose rate does not differ significantly from that of the largest one, become one.
4. A template's purity is the share of blocked labels on its host, smoothed in the same way towards its patterns and, through
   these, towards the share in the whole corpus or one half, whichever is less: so labels reach the templates that are alike
   on hosts without labels, and what nobody labelled is not rejected.  At or above the threshold a template is rejected.

Defined results: a null url, or one without "://", has an empty host and path and no rule; with no labels at all the purity
of every template is 0 and everything is allowed; repeated rows are judged alike; null page_ids stay; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import scratch, written

#: (rule, verdict); a rule is a host and a path prefix.  They are checked one by one, so keep them to some hundreds.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: A node with more children than this folds those below the given share of its URLs into a wildcard.
FAN = 16
RARE = 0.02
#: Longest segment that stands for itself.
SEGMENT = 32
#: Weight of what a rate is smoothed towards, in labels, and the purity at which a template is rejected.
SMOOTHING = 10.0
PURITY = 0.8
#: Deviations by which two branches differ significantly.
Z = 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\x00"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    here = (F.col("host") == host) | F.col("host").endswith("." + host)
    return here & F.col("path").startswith(slash + path)


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and ruled (the rule's verdict)."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule = F.coalesce(*[F.when(_fits(r), F.lit(r)) for r, _ in ordered], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in ordered], F.lit(None).cast("string"))
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return found.withColumn("rule", rule).withColumn("ruled", verdict)


def shape(path: Column) -> Column:
    """The path with its digit runs and overlong segments generalised."""
    masked = F.regexp_replace(path, "[0-9]+", "{n}")
    return F.regexp_replace(masked, f"[^/]{{{SEGMENT + 1},}}", "{s}")


def _smoothed(blocked: str, allowed: str, towards: Column) -> Column:
    return (F.col(blocked) + SMOOTHING * towards) / (F.col(blocked) + F.col(allowed) + SMOOTHING)


def _rates(tree: DataFrame, key: str, prior: float) -> DataFrame:
    """``tree`` with ``pattern_rate``: the smoothed share of blocked labels of its pattern ``key`` over all hosts."""
    sums = written(tree.groupBy(key).agg(F.sum("b").alias("pb"), F.sum("a").alias("pa")), "patterns")
    rated = sums.select(key, _smoothed("pb", "pa", F.lit(prior)).alias("pattern_rate"))
    return tree.join(rated, key)


def _next_level(tree: DataFrame, level: int) -> int | None:
    """The next level at which some node could be generalised or merged: it has many children, or two with the same depth beneath."""
    rest = F.slice("segments", level, 1 << 30)
    rows = tree.where(F.size("segments") >= level).select("host", "template", rest.alias("rest")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("rest") - 1)))
    node = ["host", "template", "i", "stem"]
    last = F.size("rest") - F.col("i") - 1
    children = rows.withColumn("stem", F.xxhash64(F.slice("rest", F.lit(1), F.col("i")))).groupBy(*node, F.get("rest", F.col("i")).alias("segment")).agg(F.min(last).alias("low"), F.max(last).alias("high"))
    nodes = children.groupBy(*node, "low", "high").agg(F.count("*").alias("alike")).groupBy(*node).agg(F.sum("alike").alias("fan"), F.max("alike").alias("alike"))
    first = nodes.where((F.col("fan") > FAN) | (F.col("alike") > 1)).agg(F.min("i")).first()[0]
    return None if first is None else level + first


def _advanced(tree: DataFrame, level: int, to: int) -> DataFrame:
    """``tree`` with all templates and patterns as they are at level ``to``, where nothing between changes any.  A shape that is
    alone in its node before that is done, as it is where levels are taken one by one."""
    stem = F.slice("segments", level, to - 1 - level)
    open_ = F.size("segments") >= level
    through = tree.where(F.size("segments") >= to - 1).groupBy("host", "template", stem.alias("stem")).agg(F.count("*").alias("held")).where("held = 1").drop("held")
    met = tree.withColumn("stem", stem).join(through.withColumn("single", F.lit(True)), ["host", "template", "stem"], "left")
    single = F.coalesce("single", F.lit(False)) & (F.size("segments") >= to - 1)
    steps = F.when(single, F.slice("segments", level, 1 << 30)).otherwise(F.slice("segments", level, to - level))
    added = F.when(open_, F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise("")
    ended = F.when(single, F.slice("segments", 1, 1)).otherwise(F.col("segments"))
    return met.withColumns({"template": F.concat("template", added), "pattern": F.concat("pattern", added), "segments": ended}).select(tree.columns)


def template_tree(ruled: DataFrame) -> tuple[DataFrame, float]:
    """host, shape, template, pattern, n, b and a of every distinct shape (counts are those of the shape), and the prior."""
    counted = ruled.groupBy("host", shape(F.col("path")).alias("shape")).agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a")
    )
    with scratch(ruled.sparkSession) as kept:
        tree = written(counted.withColumns({"segments": F.split("shape", "/", -1), "template": F.lit(""), "pattern": F.lit("")}), "shapes")
        labels = tree.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).first()
        prior = min(0.5, labels.b / (labels.a + labels.b)) if (labels.a or 0) + (labels.b or 0) else 0.0
        node, ended, level = ["host", "template"], None, 2  # a path begins with a slash, so its first segment is empty
        while True:
            to = _next_level(tree, level)
            if to is None:  # what is left of the paths stays as it is
                tree = _advanced(tree, level, 1 << 20)
                break
            if to > level:
                tree, level = written(_advanced(tree, level, to), "shapes"), to
            here = tree.where(F.size("segments") >= level).withColumn("segment", F.element_at("segments", level))
            children = written(here.groupBy(*node, "segment").agg(F.sum("n").alias("m"), F.count("*").alias("shapes")), "children")
            fan = written(children.groupBy(*node).agg(F.count("*").alias("fan"), F.sum("m").alias("all"), F.sum("shapes").alias("held")), "fan")
            rare = (F.col("fan") > FAN) & (F.col("m") < RARE * F.col("all"))
            steps = children.drop("shapes").join(fan, node).select(*node, "segment", F.when(rare, "*").otherwise(F.col("segment")).alias("step"), (F.col("held") == 1).alias("alone"))
            stepped = here.join(written(steps, "steps"), [*node, "segment"])
            # Where a node holds one shape only, nothing below it can be generalised or merged: it is done.
            rest = F.concat(F.lit("/"), F.array_join(F.slice("segments", level, 1 << 30), "/"))
            step = F.when(F.col("alone"), rest).otherwise(F.concat(F.lit("/"), "step"))
            stepped = written(stepped.withColumns({"step": step, "pattern": F.concat("pattern", step)}).drop("segment"), "stepped")
            last = F.when(F.col("alone"), 0).otherwise(F.size("segments") - level)
            beneath = F.concat_ws("-", F.min(last), F.max(last)).alias("beneath")
            branches = _rates(stepped, "pattern", prior).groupBy(*node, "step").agg(
                F.sum("n").alias("m"), F.sum("b").alias("b"), F.sum("a").alias("a"), (F.sum(F.col("n") * F.col("pattern_rate")) / F.sum("n")).alias("towards"), beneath
            )
            rate = _smoothed("b", "a", F.col("towards"))
            branches = branches.withColumn("rate", rate).withColumn("spread", F.col("rate") * (1 - F.col("rate")) / (F.col("b") + F.col("a") + SMOOTHING + 1))
            branches = written(branches.select(*node, "step", "m", "beneath", "rate", "spread"), "branches")
            largest = branches.groupBy(*node, "beneath").agg(F.max_by(F.struct("step", "rate", "spread"), F.struct("m", "step")).alias("x"))
            judged = branches.join(written(largest, "largest"), [*node, "beneath"])
            alike = F.abs(F.col("rate") - F.col("x.rate")) <= Z * F.sqrt(F.col("spread") + F.col("x.spread"))
            names = judged.select(*node, "step", F.when(alike, F.concat(F.col("x.step"), F.lit("|"), "beneath")).otherwise(F.col("step")).alias("name"))
            grown = stepped.join(written(names, "names"), [*node, "step"]).withColumn("template", F.concat("template", "name"))
            grown = written(grown.withColumn("segments", F.when(F.col("alone"), F.slice("segments", 1, level)).otherwise(F.col("segments"))).select(*tree.columns), "shapes")
            over = tree.where(F.size("segments") < level)
            ended = over if ended is None else ended.unionByName(over)
            tree, level = grown, level + 1
        tree = written((tree if ended is None else ended.unionByName(tree)).withColumn("template", F.concat("host", "template")).drop("segments"), "tree")
        kept.append(tree)
    return tree, prior


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity."""
    ruled = with_rules(pages, rules)
    tree, prior = template_tree(ruled)
    sums = _rates(tree, "pattern", prior).groupBy("template").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), (F.sum(F.col("n") * F.col("pattern_rate")) / F.sum("n")).alias("towards"))
    purity = written(sums.select("template", F.round(_smoothed("b", "a", F.col("towards")), 9).alias("purity")), "purity")
    templates = written(tree.select("host", "shape", "template").join(purity, "template"), "templates")
    out = ruled.withColumn("shape", shape(F.col("path"))).join(templates, ["host", "shape"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op3(pages: DataFrame) -> DataFrame:
    """The contract's columns, a row per page, then the template and its purity."""
    return judge(pages)
