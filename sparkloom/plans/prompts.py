"""Queries over prompts and conversations: type scores, structure, decomposition, pieces, topics and patterns of words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import prompts as PR
from ..functions import rules as RU
from ..functions import strings as S
from ..operators import dialogue as D
from ..operators import evidence as E
from .adapter import exact, r, table
from .adapter import with_exact as ex
from .catalog import register

_USER = "role = 'user'"


def _q(p: str) -> str:
    return p.replace("'", "''")


_COUNTS = ", ".join(f"len(regexp_extract_all(text, '(?i){_q(p)}')) AS {k}" for k, p in PR.VERBS.items())
_SCORES = f"""t AS (SELECT *, {_COUNTS}, len(regexp_extract_all(text, '\\?')) / greatest(1, len(list_filter(string_split_regex(text, '[.!?\\n]'), lambda x: trim(x, ' ') <> ''))) q, len(regexp_extract_all(text, '{_q(PR.FILES)}')) f, regexp_matches(text, '(?i)\\bline\\s+\\d+\\b') ln FROM conversations),
 s AS (SELECT conv_id, turn, 0.25 * debugging + CASE WHEN ln THEN 0.3 ELSE 0 END debugging, 0.25 * building + CASE WHEN f > 3 THEN 0.15 ELSE 0 END building, 0.25 * discovery + CASE WHEN q > 0.5 THEN 0.4 WHEN q > 0.25 THEN 0.2 ELSE 0 END + CASE WHEN f = 0 AND q > 0.3 THEN 0.15 ELSE 0 END discovery,
 0.25 * refactoring + CASE WHEN ln THEN 0.15 ELSE 0 END refactoring, 0.25 * testing testing, 0.25 * review review, 0.25 * configuring configuring, 0.25 * explaining explaining FROM t), top AS (SELECT *, greatest(debugging, building, discovery, refactoring, testing, review, configuring, explaining) m FROM s),
 z AS (SELECT * REPLACE (CASE WHEN m = 0 THEN 0.05 ELSE discovery END AS discovery) FROM top)"""


@register("prompt_type_scores", f"WITH {_SCORES} SELECT conv_id, turn, {', '.join(f'{r(k)} AS {k}' for k in PR.VERBS)} FROM z")
def prompt_type_scores(spark, d):
    scores = PR.type_scores(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", *[N.half_up(v, 4).alias(k) for k, v in scores.items()])


_EXPS = " + ".join(f"exp(({k} - greatest(m, 0.05 * (m = 0)::INT)) / 1.5)" for k in PR.VERBS)


@register("prompt_type_shares", f"WITH {_SCORES} SELECT {', '.join(f'{r(f'avg(exp(({k} - greatest(m, 0.05 * (m = 0)::INT)) / 1.5) / ({_EXPS}))')} AS {k}' for k in PR.VERBS)} FROM z")
def prompt_type_shares(spark, d):
    """The mean of the softmax over the eight types."""
    shares = PR.softmax(PR.type_scores(F.col("text")))
    return table(spark, d, "conversations").agg(*[N.half_up(F.avg(v), 4).alias(k) for k, v in shares.items()])


@register("prompt_structures", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{_q(PR.HARD)}') AND regexp_matches(text, '{_q(PR.SOFT)}') THEN 'mixed' WHEN regexp_matches(text, '{_q(PR.HARD)}') THEN 'hard' WHEN regexp_matches(text, '{_q(PR.SOFT)}') THEN 'soft' ELSE 'none' END AS constraint_type,
 CAST(CASE WHEN len(regexp_extract_all(text, '(?m)^\\s*\\d+[.)]\\s')) > 0 THEN len(regexp_extract_all(text, '(?m)^\\s*\\d+[.)]\\s')) WHEN len(regexp_extract_all(text, '(?m)^\\s*[-*]\\s')) > 2 THEN 2 ELSE 1 END AS BIGINT) AS depth, CAST(len(regexp_extract_all(text, '{_q(PR.FILES)}')) AS BIGINT) AS files FROM conversations""")
def prompt_structures(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", PR.constraint(text).alias("constraint_type"), PR.depth(text).cast("long").alias("depth"), PR.hits(text, PR.FILES).cast("long").alias("files"))


@register("prompt_segments", f"""WITH l AS (SELECT conv_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) s FROM conversations), k AS (SELECT conv_id, CASE WHEN regexp_matches(s, '^\\s*```|^\\s{{4,}}\\S') THEN 'code' WHEN regexp_matches(s, '^\\s*\\d+[.)]\\s') THEN 'step' WHEN regexp_matches(s, '^\\s*[-*]\\s') THEN 'bullet' WHEN contains(s, '?') THEN 'question' WHEN regexp_matches(s, '{_q(PR.HARD)}') OR regexp_matches(s, '{_q(PR.SOFT)}') THEN 'constraint' WHEN regexp_matches(s, '{_q(PR.EXAMPLE)}') THEN 'example' ELSE 'statement' END AS kind FROM l) SELECT conv_id, kind, count(*) n FROM k GROUP BY 1, 2""")
def prompt_segments(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", F.explode(PR.decomposed(F.col("text"))).alias("x"))
    return pieces.groupBy("conv_id", "x.kind").agg(F.count("*").alias("n"))


@register("token_bags", f"WITH t AS (SELECT conv_id, turn, text, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) >= 2)) w FROM conversations), h AS (SELECT conv_id, turn, (list_contains(w, 'the') AND list_contains(w, 'and'))::INT + list_contains(w, 'que')::INT + contains(text, '?')::INT AS a, list_contains(w, 'des')::INT + list_contains(w, 'of')::INT AS s FROM t) SELECT conv_id, turn, CASE WHEN a = 0 THEN 0.0 ELSE {r('0.7 * a / 3 + 0.3 * s / 2')} END score FROM h")
def token_bags(spark, d):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= 2))
    return table(spark, d, "conversations").select("conv_id", "turn", N.half_up(RU.token_bag(words, ["the and", "que", "?"], ["des", "of"], F.col("text")), 4).alias("score"))


@register("learned_domains", """WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 6)) token FROM conversations), f AS (SELECT token, count(*) n FROM w GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, token) i FROM f QUALIFY i <= 10) SELECT string_agg(token, '-' ORDER BY i) FILTER (i <= 3) AS name, string_agg(token, ',' ORDER BY i) tokens, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS seen FROM k HAVING (SELECT count(*) FROM f) >= 3""")
def learned_domains(spark, d):
    """Words that no known domain explains and that come five times or more make a domain of their own, named by the first three."""
    words = table(spark, d, "conversations").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 6)).alias("token"))
    return D.learned_domain(words, "token", 5, 10)


@register("domains_of_paths", """WITH p AS (SELECT DISTINCT split_part(regexp_extract(url, '://([^?#]*)', 1), '/', 1) AS host, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path FROM pages), j AS (SELECT host, string_agg(path, ' ' ORDER BY path) paths FROM p GROUP BY 1) SELECT host, CASE WHEN regexp_matches(paths, '/es/[0-9]+\\.html') THEN 'spanish' WHEN regexp_matches(paths, '/de/[0-9]+/') THEN 'german' WHEN regexp_matches(paths, '/fr/') THEN 'french' ELSE 'general' END AS domain FROM j""")
def domains_of_paths(spark, d):
    """The first class whose pattern one of a host's paths has; equal to searching all of them joined, without joining them."""
    url = F.regexp_extract("url", "://([^?#]*)", 1)
    pages = table(spark, d, "pages").select(F.split(url, "/")[0].alias("host"), F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("path"))
    return D.first_class(pages, "host", "path", [("spanish", r"/es/[0-9]+\.html"), ("german", "/de/[0-9]+/"), ("french", "/fr/")])


@register("turn_pieces", "WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' | ') x FROM conversations), p AS (SELECT conv_id, turn, string_split(x, ' | ') a FROM t) SELECT conv_id, turn, generate_subscripts(a, 1) - 1 AS i, length(unnest(a)) AS n_chars FROM p")
def turn_pieces(spark, d):
    """Turns out of one text: a JSON list of them, else what stands between bars, else the text itself."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array(F.regexp_replace("text", "\n", " | "))).alias("detail"))
    return turns.select("conv_id", "turn", F.posexplode(D.turn_texts(F.col("detail"))).alias("i", "piece")).select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.length("piece").cast("long").alias("n_chars"))


@register("segment_topics", ex(", m AS (SELECT user_id, list_sort(list_distinct(list('mod' || branch))) a FROM ex GROUP BY 1) SELECT user_id, CASE WHEN len(a) <= 3 THEN array_to_string(a, ', ') ELSE array_to_string(a[1:3], ', ') || ' (+' || (len(a) - 3) || ' more)' END AS topic FROM m"))
def segment_topics(spark, d):
    modules = exact(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("mod"), F.col("branch").cast("string")))).alias("a"))
    return modules.select("user_id", D.topic(F.col("a"), F.lit("")).alias("topic"))


@register("context_switches", ex(", n AS (SELECT session, branch, lead(branch) OVER (PARTITION BY session ORDER BY ts, id) nxt FROM ex) SELECT session, count(*) FILTER (nxt IS NOT NULL AND nxt <> branch) switches, count(nxt) n FROM n GROUP BY 1"))
def context_switches(spark, d):
    """How often the next event of a session shares nothing with the one before."""
    following = F.lead("branch").over(Window.partitionBy("session").orderBy("ts", "id"))
    n = exact(spark, d).select("session", "branch", following.alias("nxt"))
    return n.groupBy("session").agg(F.count_if(F.col("nxt") != F.col("branch")).alias("switches"), F.count("nxt").alias("n"))


@register("diagnostic_buckets", ex(", k AS (SELECT 'loop' AS analyzer, regexp_replace(regexp_replace(trim(lower(substr('Stuck on ' || tool || ': branch #' || branch, 1, 60)), ' '), '[^a-z0-9 -]', '', 'g'), '\\s+', '-', 'g') prefix, count(*) n, max(ts) last_seen FROM ex WHERE s4 < 1000 GROUP BY ALL) SELECT analyzer || '::' || prefix || '::global' AS key, n, n // 5 AS promoted, n % 5 AS held, CASE WHEN n >= 5 THEN greatest(0, 3 - n % 5) ELSE 0 END AS cooldown, last_seen FROM k"))
def diagnostic_buckets(spark, d):
    """Counters by analyzer and slug of the message: promoted and reset at every fifth, then three rounds of rest."""
    e = exact(spark, d).where("s4 < 1000")
    prefix = S.slug(F.concat(F.lit("Stuck on "), "tool", F.lit(": branch #"), F.col("branch").cast("string")))
    n = e.groupBy(F.concat(F.lit("loop::"), prefix, F.lit("::global")).alias("key")).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return D.promoted(n, "n", 5, 3).select("key", "n", "promoted", "held", "cooldown", "last_seen")


#: Kinds of signals; words end where no ASCII letter or digit follows, as engines differ on others.
_KINDS = {k: f"(?i)(?:^|[^A-Za-z0-9_])(?:{w})(?:[^A-Za-z0-9_]|$)" for k, w in {"asking": "que|what", "doubt": "not|pas|nicht", "linking": "und|and|et"}.items()} | {"question": r"\?"}
_MARKS = ", ".join(f"regexp_matches(text, '{p}')::INT {k}" for k, p in _KINDS.items())


@register("metacognition", f"WITH u AS (SELECT conv_id, {_MARKS} FROM conversations WHERE role = 'user') SELECT conv_id, count(*) n_turns, {r(f'sum({" + ".join(_KINDS)}) / count(*)', 3)} AS density, {r(f'({" + ".join(f"max({k})" for k in _KINDS)}) / 7.0', 3)} AS breadth FROM u GROUP BY 1")
def metacognition(spark, d):
    """Signals by user turns, and the share of seven kinds that appear."""
    return D.metacognition(table(spark, d, "conversations").where(_USER), "conv_id", "text", _KINDS, 7)
