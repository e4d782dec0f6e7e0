"""Queries over decisions, text, vectors, graphs and bi-temporal facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..operators import facts as FA
from ..operators import graphs as G
from ..operators import rollups as R
from ..operators import texts as TX
from .adapter import parts, r, table
from .catalog import register

#: Tokens of the text functions, in SQL.
TOK = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)"


# --- features, bridges and decisions: orders are decisions, parts are features, lineitem is the bridge


@register("cost_by_feature", """SELECT p_brand, count(DISTINCT o_orderkey) n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def cost_by_feature(spark, d):
    o, l, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    n = parts(l, o)
    branded = l.select("l_orderkey", "l_partkey").repartition(n, "l_partkey").join(p.select("p_partkey", "p_brand").repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    # Orders are dealt out once: what is distinct within them is so in all.
    met = branded.select("l_orderkey", "p_brand").repartition(n, "l_orderkey").distinct().join(o.select(F.col("o_orderkey").alias("l_orderkey")).repartition(n, "l_orderkey"), "l_orderkey", "left_semi")
    return met.groupBy("p_brand").agg(F.count("*").alias("n"))


@register("decision_revisions", """SELECT o_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) linked FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY 1""")
def decision_revisions(spark, d):
    o, l = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    linked = l.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("linked"))
    return o.join(linked, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "linked")


@register("unlinked_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def unlinked_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("file_inverted_index", "SELECT l_partkey, count(DISTINCT l_orderkey) n, min(l_orderkey) first_order, max(l_orderkey) last_order FROM lineitem GROUP BY 1")
def file_inverted_index(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))


@register("expertise_map", f"""WITH x AS (SELECT c_nationkey, l_suppkey, count(*) n, count(*) FILTER (l_returnflag='R') mods FROM customer JOIN orders ON c_custkey=o_custkey JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1,2),
 y AS (SELECT *, {r('0.6*(n-mods)/n::DOUBLE + 0.3*least(1.0, (n-mods)/10.0) + CASE WHEN mods>0 THEN 0.1 ELSE 0 END')} score FROM x WHERE n >= 2) SELECT c_nationkey, l_suppkey, n, score, CASE WHEN score>=0.8 THEN 'expert' WHEN score>=0.6 THEN 'able' WHEN score>=0.4 THEN 'learning' ELSE 'new' END AS level FROM y""")
def expertise_map(spark, d):
    c, o, l = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    met = c.select("c_custkey", "c_nationkey").join(o.select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey")).join(l.select("l_orderkey", "l_suppkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = met.groupBy("c_nationkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("mods")).where("n >= 2")
    git = F.col("n") - F.col("mods")
    score = N.half_up(0.6 * git / F.col("n") + 0.3 * F.least(F.lit(1.0), git / 10.0) + F.when(F.col("mods") > 0, 0.1).otherwise(0.0), 4)
    y = x.select("c_nationkey", "l_suppkey", "n", score.alias("score"))
    s = F.col("score")
    return y.withColumn("level", F.when(s >= 0.8, "expert").when(s >= 0.6, "able").when(s >= 0.4, "learning").otherwise("new"))


@register("decision_conflicts", """SELECT a.o_custkey, a.o_orderkey a, b.o_orderkey b, a.o_orderpriority <> b.o_orderpriority AS differs FROM orders a JOIN orders b ON a.o_custkey=b.o_custkey AND a.o_orderkey<b.o_orderkey AND abs(epoch_us(a.o_orderdate)-epoch_us(b.o_orderdate)) < 604800000000""")
def decision_conflicts(spark, d):
    """Time is binned by the week, so that a decision meets its own and the neighbouring bins, never all of a customer."""
    week = 604800000000
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_orderpriority").withColumn("bin", F.floor(F.col("t") / week))
    a = o.select("o_custkey", "bin", F.col("o_orderkey").alias("a"), F.col("t").alias("ta"), F.col("o_orderpriority").alias("pa"))
    b = o.select("o_custkey", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("o_orderkey").alias("b"), F.col("t").alias("tb"), F.col("o_orderpriority").alias("pb"))
    met = a.join(b, ["o_custkey", "bin"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) < week))
    return met.select("o_custkey", "a", "b", (F.col("pa") != F.col("pb")).alias("differs"))


@register("decision_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '%URGENT%' AND o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def decision_page(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority like '%URGENT%' and o_orderdate >= timestamp '1996-01-01'")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_totalprice")


@register("evidence_union", "WITH u AS (SELECT l_orderkey k, l_quantity v FROM lineitem WHERE l_returnflag='R' UNION ALL SELECT l_orderkey, l_quantity*0.5 FROM lineitem WHERE l_returnflag='A') SELECT k, max(v) contribution, count(*) n FROM u GROUP BY 1")
def evidence_union(spark, d):
    l = table(spark, d, "lineitem")
    u = l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v")).unionByName(l.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") * 0.5).alias("v")))
    return u.groupBy("k").agg(F.max("v").alias("contribution"), F.count("*").alias("n"))


@register("prefer_first_source", "WITH u AS (SELECT o_custkey k, 1 p, min(o_orderkey) v FROM orders WHERE o_orderstatus='F' GROUP BY 1 UNION ALL SELECT o_custkey, 2, min(o_orderkey) FROM orders WHERE o_orderstatus='O' GROUP BY 1) SELECT k, arg_min(v, p) v, min(p) p FROM u GROUP BY 1")
def prefer_first_source(spark, d):
    o = table(spark, d, "orders")
    side = lambda s, p: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v")).withColumn("p", F.lit(p))
    return side("F", 1).unionByName(side("O", 2)).groupBy("k").agg(F.min_by("v", "p").alias("v"), F.min("p").alias("p"))


@register("yearly_changes", "WITH a AS (SELECT c_mktsegment s, list_sort(list_distinct(list(o_orderpriority))) x FROM orders JOIN customer ON o_custkey=c_custkey WHERE year(o_orderdate)=1996 GROUP BY 1), b AS (SELECT c_mktsegment s, list_sort(list_distinct(list(o_orderpriority))) x FROM orders JOIN customer ON o_custkey=c_custkey WHERE year(o_orderdate)=1997 GROUP BY 1) SELECT s, array_to_string(list_sort(list_filter(a.x, lambda v: NOT list_contains(b.x, v))), ',') gone, array_to_string(list_sort(list_filter(b.x, lambda v: NOT list_contains(a.x, v))), ',') fresh FROM a JOIN b USING (s)")
def yearly_changes(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("s")), "o_custkey")
    of = lambda y, n: o.where(F.year("o_orderdate") == y).groupBy("s").agg(F.collect_set("o_orderpriority").alias(n))
    gap = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return of(1996, "a").join(of(1997, "b"), "s").select("s", gap("a", "b").alias("gone"), gap("b", "a").alias("fresh"))


# --- text


@register("keyword_search", f"""WITH x AS (SELECT d.doc_id, d.text, date_diff('day', DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER), DATE '2024-03-01') AS age FROM documents d), c AS (SELECT *, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 + (length(lower(text)) - length(replace(lower(text), 'ment', ''))) // 4 AS hits FROM x)
 SELECT doc_id, {r('0.6*least(1.0, hits/greatest(1.0, length(text)/100.0)) + 0.4*greatest(0.1, 1.0-age/30.0)')} score FROM c WHERE hits > 0 ORDER BY score DESC, doc_id LIMIT 40""")
def keyword_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("ts"))
    now = spark.sql("select date'2024-03-01' as as_of")
    return TX.keyword_search(docs, "doc_id", "text", "ts", ["tion", "ment"], now, 30.0, 40)


@register("token_counts", f"SELECT doc_id, CAST(len({TOK.format('text')}) AS INTEGER) n_tokens, CAST(len(list_distinct({TOK.format('text')})) AS INTEGER) n_distinct FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(S.tokens(F.col("text"))).alias("n_tokens"), F.size(S.token_set(F.col("text"))).alias("n_distinct"))


@register("turn_changes", f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOK.format('text')}) x FROM conversations), p AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) y FROM t)
 SELECT conv_id, turn, {r("CASE WHEN len(list_distinct(list_concat(x,y)))=0 THEN 0.0 ELSE len(list_intersect(x,y))::DOUBLE / len(list_distinct(list_concat(x,y))) END")} similarity, CAST(len(x)-len(y) AS BIGINT) growth FROM p WHERE y IS NOT NULL""")
def turn_changes(spark, d):
    return TX.turn_changes(table(spark, d, "conversations"), "conv_id", "turn", "text")


@register("dialogue_profile", f"""WITH t AS (SELECT *, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 1)) w FROM conversations)
 SELECT conv_id, count(*) n_turns, count(*) FILTER (role='user') n_user, {r("coalesce(avg(w) FILTER (role='user'), 0)")} user_words, count(*) FILTER (role='user' AND text LIKE '%?%') n_questions, substr(arg_min(text, turn) FILTER (role='user'), 1, 40) summary, arg_max(role, turn) last_role FROM t GROUP BY 1""")
def dialogue_profile(spark, d):
    return TX.dialogue_profile(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@register("conversation_roles", "SELECT role, count(*) n, count(DISTINCT conv_id) n_conversations FROM conversations GROUP BY 1")
def conversation_roles(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"))


@register("similar_items", f"""WITH t AS (SELECT item_id, list_distinct({TOK.format('text')}) x FROM benchmark), p AS (SELECT a.item_id a, b.item_id b, len(list_intersect(a.x,b.x)) k, len(a.x) la, len(b.x) lb FROM t a JOIN t b ON a.item_id < b.item_id) SELECT a, b, CAST(k AS BIGINT) n_shared, {r('k/(la+lb-k)::DOUBLE')} jaccard FROM p WHERE k >= 3 AND k/(la+lb-k)::DOUBLE >= 0.12""")
def similar_items(spark, d):
    items = table(spark, d, "benchmark").select("item_id", S.token_set(F.col("text")).alias("terms"))
    return TX.similar_pairs(items, "item_id", "terms", 3, 0.12)


def _greedy(tokens: str, similar: str) -> str:
    """SQL of greedy deduplication: items in order, each kept unless it is similar to one that is kept."""
    return f"""WITH RECURSIVE t AS (SELECT item_id, {tokens} x FROM benchmark), p AS (SELECT a.item_id a, b.item_id b FROM t a JOIN t b ON a.item_id < b.item_id WHERE {similar}), nb AS (SELECT row_number() OVER (ORDER BY item_id) AS i, item_id, coalesce((SELECT list(a) FROM p WHERE b = item_id), []) AS earlier FROM t),
 g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT g.i + 1, CASE WHEN list_has_any(g.kept, nb.earlier) THEN g.kept ELSE list_append(g.kept, nb.item_id) END FROM g JOIN nb ON nb.i = g.i + 1), k AS (SELECT arg_max(kept, i) kept FROM g) SELECT item_id AS dropped, list_min(list_intersect(kept, earlier)) AS kept FROM nb, k WHERE list_has_any(kept, earlier)"""


_JACCARD = "len(list_intersect(a.x, b.x)) / greatest(1, len(list_distinct(list_concat(a.x, b.x))))"


@register("fuzzy_dedup_items", _greedy(f"list_distinct({TOK.format('text')})", f"{_JACCARD} >= 0.12"))
def fuzzy_dedup_items(spark, d):
    items = table(spark, d, "benchmark").select("item_id", S.token_set(F.col("text")).alias("terms"))
    return TX.canonical(TX.similar_pairs(items, "item_id", "terms", 1, 0.12))


_STEMS = f"list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({list(S.STOP_WORDS)}, w)), lambda w: CASE WHEN length(w) >= 4 THEN regexp_replace(w, '(?:{'|'.join(S.SUFFIXES)})$', '') ELSE w END))"


@register("stem_dedup_items", _greedy(_STEMS, f"{_JACCARD} >= 0.1"))
def stem_dedup_items(spark, d):
    """Greedy deduplication by stems, at a threshold that these texts reach."""
    items = table(spark, d, "benchmark").select("item_id", S.stems(F.col("text")).alias("terms"))
    return TX.canonical(TX.similar_pairs(items, "item_id", "terms", 1, 0.1))


@register("item_cosines", f"""WITH t AS (SELECT item_id, unnest({TOK.format('text')}) w FROM benchmark), f AS (SELECT item_id, w, count(*) n FROM t GROUP BY 1,2), m AS (SELECT item_id, sqrt(sum(n*n)) z FROM f GROUP BY 1), pr AS (SELECT item_id a, item_id+1 b FROM benchmark WHERE item_id+1 IN (SELECT item_id FROM benchmark)),
 dt AS (SELECT a, b, sum(x.n*y.n) s FROM pr JOIN f x ON x.item_id=a JOIN f y ON y.item_id=b AND x.w=y.w GROUP BY 1,2) SELECT pr.a, pr.b, {r('coalesce(s/(ma.z*mb.z), 0)')} cosine FROM pr LEFT JOIN dt USING (a,b) LEFT JOIN m ma ON ma.item_id=pr.a LEFT JOIN m mb ON mb.item_id=pr.b""")
def item_cosines(spark, d):
    b = table(spark, d, "benchmark")
    ids = b.select("item_id")
    pairs = ids.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b")).join(ids.select(F.col("item_id").alias("b")), "b", "left_semi").select("a", "b")
    return TX.tf_cosine(b, "item_id", "text", pairs, "a", "b")


@register("line_hashes", "SELECT item_id, substr(sha256(text), 1, 16) AS hash FROM benchmark")
def line_hashes(spark, d):
    return table(spark, d, "benchmark").select("item_id", S.line_hash(F.col("text")).alias("hash"))


@register("name_edits", "SELECT a.n_name a, b.n_name b, levenshtein(a.n_name, b.n_name) AS edits FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def name_edits(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"))


@register("url_modules", "SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS module, count(*) n FROM pages GROUP BY 1")
def url_modules(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("module")).agg(F.count("*").alias("n"))


@register("source_classes", "SELECT CASE WHEN regexp_matches(text, 'License') THEN 'legal' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numeric' WHEN regexp_matches(text, '\\|') THEN 'table' ELSE 'general' END AS class, count(*) n FROM documents GROUP BY 1")
def source_classes(spark, d):
    c = S.classify(F.col("text"), [("legal", "License"), ("numeric", "[0-9]{4}"), ("table", r"\|")])
    return table(spark, d, "documents").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@register("quality_contrast", f"SELECT lang, count(*) n, {r('avg(quality)')} quality, {r('avg(toxic)')} toxic, {r('avg(n_chars)', 2)} chars FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def quality_contrast(spark, d):
    met = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return met.groupBy("lang").agg(F.count("*").alias("n"), N.half_up(F.avg("quality"), 4).alias("quality"), N.half_up(F.avg("toxic"), 4).alias("toxic"), N.half_up(F.avg("n_chars"), 2).alias("chars"))


# --- vectors


@register("nearest_vectors", f"""WITH q AS (SELECT vec_id query, embedding e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, {r('list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[])', 6)} similarity FROM q JOIN embeddings ON vec_id <> query), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 5""")
def nearest_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return G.nearest(v.select("vec_id", "embedding"), "vec_id", "embedding", v.where("vec_id % 50 = 0"), 5)


@register("label_centroid_norms", f"WITH x AS (SELECT label, unnest(range(1,65)) i, embedding FROM embeddings), m AS (SELECT label, i, avg(embedding[i]::DOUBLE) v FROM x GROUP BY 1,2) SELECT label, {r('sqrt(sum(v*v))')} norm FROM m GROUP BY 1")
def label_centroid_norms(spark, d):
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("v"))
    return m.groupBy("label").agg(N.half_up(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("norm"))


@register("projected_vectors", f"SELECT vec_id, {r('list_avg(embedding[1:6]::DOUBLE[])')} first, {r('list_avg(embedding[61:64]::DOUBLE[])')} last FROM embeddings")
def projected_vectors(spark, d):
    short = N.chunk_means(F.transform("embedding", lambda x: x.cast("double")), 6)
    return table(spark, d, "embeddings").select("vec_id", short.alias("s")).select("vec_id", N.half_up(F.col("s")[0], 4).alias("first"), N.half_up(F.element_at("s", -1), 4).alias("last"))


# --- graph: nation of the customer buys from nation of the supplier


def _edges(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey")).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    return o.join(l, "o_orderkey").groupBy("src", "dst").agg(F.count("*").alias("weight"))


EDGES = "e AS (SELECT c_nationkey src, s_nationkey dst, count(*) weight FROM orders JOIN customer ON o_custkey=c_custkey JOIN lineitem ON o_orderkey=l_orderkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2)"


@register("trade_edges", f"WITH {EDGES} SELECT * FROM e")
def trade_edges(spark, d):
    return _edges(spark, d)


@register("trade_neighbourhood", f"WITH {EDGES}, k AS (SELECT dst, src, weight, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS rank FROM e) SELECT * FROM k WHERE rank <= 5")
def trade_neighbourhood(spark, d):
    return G.neighbourhood(_edges(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), 5)


@register("trade_hubs", f"WITH {EDGES} SELECT src node, count(*) degree, 'out' direction FROM e GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT dst, count(*), 'in' FROM e GROUP BY 1 HAVING count(*) >= 2")
def trade_hubs(spark, d):
    return G.hubs(_edges(spark, d), 2)


#: Customers (even nodes) and suppliers (odd ones) that trade, in both directions; weights fall with what they trade.
CHAIN = """p AS (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b, CAST(1 + 10 // count(*) AS DOUBLE) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
 c AS (SELECT a AS src, b AS dst, w AS weight FROM p UNION ALL SELECT b, a, w FROM p)"""


def _chain(spark, d):
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    met = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).agg(F.count("*").alias("n"))
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return met.select(F.explode(ways).alias("e"), (1 + F.floor(10 / F.col("n"))).cast("double").alias("weight")).select("e.src", "e.dst", "weight")


@register("reachable_nodes", f"WITH RECURSIVE {CHAIN}, w(node, hops) USING KEY (node) AS (SELECT CAST(3 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT c.dst, min(w.hops) + 1 FROM w JOIN c ON w.node = c.src LEFT JOIN recurring.w q ON q.node = c.dst WHERE q.node IS NULL GROUP BY 1) SELECT CAST(3 AS BIGINT) AS start, node, hops FROM w")
def reachable_nodes(spark, d):
    return G.reachable(_chain(spark, d), spark.createDataFrame([(3,)], "node bigint"))


@register("node_components", f"WITH RECURSIVE {CHAIN}, w(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM c UNION SELECT c.dst, min(w.component) FROM w JOIN c ON w.node = c.src JOIN recurring.w q ON q.node = c.dst WHERE w.component < q.component GROUP BY 1) SELECT node, component FROM w")
def node_components(spark, d):
    return G.connected(_chain(spark, d))


@register("least_distances", f"WITH RECURSIVE {CHAIN}, w(node, distance) USING KEY (node) AS (SELECT CAST(3 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT c.dst, min(w.distance + c.weight) FROM w JOIN c ON w.node = c.src LEFT JOIN recurring.w q ON q.node = c.dst WHERE q.node IS NULL OR w.distance + c.weight < q.distance GROUP BY 1) SELECT CAST(3 AS BIGINT) AS start, node, {r('distance')} AS distance FROM w")
def least_distances(spark, d):
    return G.shortest_paths(_chain(spark, d), spark.createDataFrame([(3,)], "node bigint")).withColumn("distance", N.half_up(F.col("distance"), 4))


@register("geo_hierarchy", "SELECT 'r'||r_name ancestor, 'n'||n_name descendant, CAST(1 AS BIGINT) AS depth FROM region JOIN nation ON r_regionkey=n_regionkey UNION ALL SELECT 'n'||n_name, 'c'||c_custkey, 1 FROM nation JOIN customer ON n_nationkey=c_nationkey UNION ALL SELECT 'r'||r_name, 'c'||c_custkey, 2 FROM region JOIN nation ON r_regionkey=n_regionkey JOIN customer ON n_nationkey=c_nationkey")
def geo_hierarchy(spark, d):
    rg, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    top = rg.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("r"), "r_name").alias("p"), F.concat(F.lit("n"), "n_name").alias("q"))
    low = n.join(c, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("n"), "n_name").alias("p"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("q"))
    return G.subtree(top.unionByName(low), "p", "q")


def _ranks(rounds: int) -> str:
    """SQL of the rounds, one after the other."""
    steps = ["n AS (SELECT DISTINCT src AS node FROM c), k AS (SELECT src, count(*) AS o FROM c GROUP BY 1), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce(sum(r{i}.rank / k.o), 0) AS rank FROM n LEFT JOIN c ON c.dst = n.node LEFT JOIN k ON k.src = c.src LEFT JOIN r{i} ON r{i}.node = c.src GROUP BY 1)")
    return ", ".join(steps)


@register("trade_pagerank", f"WITH {CHAIN}, {_ranks(10)} SELECT node, {r('rank', 8)} AS rank FROM r10")
def trade_pagerank(spark, d):
    """Every node has edges out, as trade goes both ways."""
    return G.pagerank(_chain(spark, d)).withColumn("rank", N.half_up(F.col("rank"), 8))


def _votes(rounds: int) -> str:
    steps = ["l0 AS (SELECT DISTINCT src AS node, src AS label FROM c)"]
    for i in range(rounds):
        steps.append(f"v{i} AS (SELECT c.src AS node, label, sum(2 * weight) AS w FROM c JOIN l{i} ON l{i}.node = c.dst GROUP BY 1, 2), l{i + 1} AS (SELECT node, arg_min(label, row(-w, label)) AS label FROM v{i} GROUP BY 1)")
    return ", ".join(steps)


@register("trade_communities", f"WITH {CHAIN}, {_votes(5)} SELECT node, label FROM l5")
def trade_communities(spark, d):
    return G.communities(_chain(spark, d))


# --- bi-temporal facts: a customer's order status is a fact until the next order


def _facts(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").cast("timestamp").alias("valid_at"))


FACTS = "f AS (SELECT o_orderkey id, o_custkey subject, 'status' predicate, o_orderstatus object, o_orderdate valid_at, lead(o_orderdate) OVER w invalid_at, lead(o_orderkey) OVER w superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


@register("superseded_facts", f"WITH {FACTS} SELECT * FROM f")
def superseded_facts(spark, d):
    return FA.supersede(_facts(spark, d))


@register("facts_valid_then", f"WITH {FACTS} SELECT id, subject, object FROM f WHERE valid_at <= TIMESTAMP '1998-01-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-01-01')")
def facts_valid_then(spark, d):
    then = spark.sql("select timestamp'1998-01-01 00:00:00' as as_of")
    return FA.valid_at(FA.supersede(_facts(spark, d)), then).select("id", "subject", "object")


@register("fact_contradictions", f"WITH {FACTS} SELECT a.id, a.superseded_by, a.subject, a.predicate, a.object, b.object new_object, date_diff('day', CAST(a.valid_at AS DATE), CAST(a.invalid_at AS DATE)) held_days FROM f a JOIN f b ON a.superseded_by=b.id WHERE a.object <> b.object")
def fact_contradictions(spark, d):
    return FA.contradictions(FA.supersede(_facts(spark, d)))


@register("entity_lifecycle", f"WITH x AS (SELECT l_partkey, count(*) n_mentions, count(DISTINCT l_suppkey) n_sources FROM lineitem GROUP BY 1) SELECT *, round(least(1.0, 0.3+0.15*n_sources), 4)::DOUBLE confidence, CASE WHEN least(1.0, 0.3+0.15*n_sources) >= 0.7 THEN 'confirmed' WHEN least(1.0, 0.3+0.15*n_sources) >= 0.5 THEN 'established' ELSE 'emerging' END stage FROM x")
def entity_lifecycle(spark, d):
    return FA.lifecycle(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@register("expiring_edges", f"WITH {FACTS} SELECT subject, count(*) n, count(*) FILTER (invalid_at IS NOT NULL AND invalid_at - valid_at < INTERVAL 30 DAY) n_quick FROM f GROUP BY 1 HAVING count(*) >= 3")
def expiring_edges(spark, d):
    f = FA.supersede(_facts(spark, d))
    quick = F.col("invalid_at").isNotNull() & (F.unix_micros("invalid_at") - F.unix_micros("valid_at") < 30 * 86400 * 1000000)
    return f.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(quick).alias("n_quick")).where("n >= 3")


@register("daily_comprehension", f"WITH x AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority p, avg(o_totalprice)/10000 s, count(*) n FROM orders GROUP BY 1,2) SELECT day, {r('least(100.0, 10*sum(s*n)/sum(n))')} score, arg_max(p, row(s, p)) best, arg_min(p, row(s, p)) worst FROM x GROUP BY 1")
def daily_comprehension(spark, d):
    x = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p")).agg((F.avg("o_totalprice") / 10000).alias("s"), F.count("*").alias("n"))
    return x.groupBy("day").agg(N.half_up(F.least(F.lit(100.0), 10 * F.sum(F.col("s") * F.col("n")) / F.sum("n")), 4).alias("score"), F.max_by("p", F.struct("s", "p")).alias("best"), F.min_by("p", F.struct("s", "p")).alias("worst"))


_NEAR = "q AS (SELECT vec_id query, label ql, embedding e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, ql, vec_id, label, " + r("list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[])", 6) + " similarity FROM q JOIN embeddings ON vec_id <> query), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s)"


@register("embedding_matches", f"WITH {_NEAR} SELECT q.query, vec_id AS matched FROM q LEFT JOIN k ON k.query = q.query AND k.rank = 1 AND 1 - k.similarity < 0.25")
def embedding_matches(spark, d):
    """For each asked vector the nearest of five, if it is near enough."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    near = G.nearest(v.select("vec_id", "embedding"), "vec_id", "embedding", asked.select("vec_id", "embedding"), 5)
    first = near.where((F.col("rank") == 1) & (1 - F.col("similarity") < 0.25)).select("query", F.col("vec_id").alias("matched"))
    return asked.select(F.col("vec_id").alias("query")).join(first, "query", "left")


@register("contradiction_candidates", f"WITH {_NEAR} SELECT query, vec_id, label FROM k WHERE rank <= 10 AND 1 - similarity <= 0.3 AND label <> ql")
def contradiction_candidates(spark, d):
    """Of the ten nearest within 0.3, those that say something else (another label)."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    near = G.nearest(v.select("vec_id", "embedding"), "vec_id", "embedding", asked.select("vec_id", "embedding"), 10).where(1 - F.col("similarity") <= 0.3)
    labels = v.select("vec_id", "label")
    met = near.join(labels, "vec_id").join(labels.withColumnsRenamed({"vec_id": "query", "label": "ql"}), "query")
    return met.where("label <> ql").select("query", "vec_id", "label")


@register("corroborated_items", _greedy(f"list_distinct({TOK.format('text')})", f"{_JACCARD} >= 0.1 AND a.item_id % 3 <> b.item_id % 3"))
def corroborated_items(spark, d):
    """Items that say what an earlier one of another source says, in groups by the first."""
    items = table(spark, d, "benchmark").select("item_id", S.token_set(F.col("text")).alias("terms"))
    pairs = TX.similar_pairs(items, "item_id", "terms", 1, 0.1)
    return TX.canonical(pairs.where(F.col("a") % 3 != F.col("b") % 3))
