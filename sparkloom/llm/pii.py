"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them.

Base spans (email, ip, card, phone) come from regular expressions, leftmost and without overlap.  They run inside the JVM
as forms of the same expressions that take linear time and no recursion: what a repeated group would match is first marked
by a private-use character of the same length.

The method: the words around a base span, on both sides, are its context.  Over the whole corpus, the disclosure of an entity
(kind and value) by a term is the pointwise information log2(P(entity | term) / P(entity)), estimated from the texts in which
the term stands in the entity's context, and all texts that have the one or the other; equal texts count once.  A term that
does so in at least ``SUPPORT`` texts, in at least a ``CERTAINTY`` share of the texts that have it, and with at least ``BITS``
of information, gives the entity away where the entity itself is removed.  Its occurrences in the corpus become spans of kind
"term", which ``sanitise`` generalises to a placeholder as it does the entities.

DataFrame functions only.  Defined results: null and empty texts have no spans; repeated rows get the same result each and
count once in the corpus; null doc_ids stay; other columns pass through, but for those named like the ones added, which are
replaced; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import unused, written

KINDS = ("email", "ip", "card", "phone")
#: Characters on either side of an entity whose words are its context.
CONTEXT_CHARS = 200
SUPPORT = 3
CERTAINTY = 0.5
BITS = 3.0
#: Revealing terms up to which their table is broadcast.
BROADCAST_TERMS = 100_000

_GAP, _FREE, _DOT = "\ue000", "\ue001", "\ue002"
_LOCAL = "A-Za-z0-9._%+" + _DOT + "-"


def _marked(text: Column, before: str, mark: str, after: str, by: str) -> Column:
    """``mark`` between ``before`` and ``after`` becomes ``by``; where the text has ``by`` itself, something neutral."""
    return F.regexp_replace(F.translate(text, by, _FREE), f"(?<={before}){mark}(?={after})", by)


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches: positions are sums of the lengths of what lies between and of the matches."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,value:string>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["m"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.aggregate(pairs, empty, add, lambda acc: acc["out"])


_NONE = "cast(array() as array<struct<start:int,value:string>>)"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def add(acc: Column, c: Column) -> Column:
        v = c.cast("int") * (1 + acc["odd"])
        return F.struct((acc["sum"] + F.when(v > 9, v - 9).otherwise(v)).alias("sum"), (1 - acc["odd"]).alias("odd"))

    return F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")), add, lambda acc: acc["sum"] % 10 == 0)


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare) <= 3, bare.try_cast("int")), F.lit(0)) <= 255)


def base_matches(text: Column) -> dict[str, Column]:
    """By kind, array<struct<start, value>> in order; texts that cannot hold a kind are not searched."""
    none = F.expr(_NONE)
    email = _found(
        _marked(text, "[A-Za-z0-9-]", r"\.", "[A-Za-z0-9-]", _DOT), rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]*+"
    )
    ip = F.filter(_found(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), lambda x: F.forall(F.split(x["value"], r"\."), _octet))
    card = F.filter(
        _found(_marked(text, "[0-9]", "[ -]", "[0-9]", _GAP), f"[0-9][0-9{_GAP}]++"),
        lambda x: F.length(_digits(x["value"])).between(16, 19) & _luhn(_digits(x["value"])),
    )
    phone = F.filter(_found(text, r"\+[0-9][ ().0-9-]+[0-9]"), lambda x: F.length(_digits(x["value"])).between(8, 15))
    return {
        "email": F.when(text.contains("@"), email).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), ip).otherwise(none),
        "card": F.when(text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), card).otherwise(none),
        "phone": F.when(text.contains("+"), phone).otherwise(none),
    }


def base_spans(documents: DataFrame) -> DataFrame:
    """Adds ``base``: array<struct<kind, start, end>> by kind, then start."""
    text = F.coalesce("text", F.lit(""))

    def spans(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end")))

    return documents.withColumn("base", F.concat(*[spans(k, m) for k, m in base_matches(text).items()]))


_WORD = r"[\p{L}\p{M}0-9]+"


def _terms(text: Column) -> Column:
    """The distinct lower-cased words of a text that have a letter."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))), lambda w: w.rlike(r"\p{L}"))


def revealing_terms(spanned: DataFrame) -> DataFrame:
    """term, entity (its hash), support, certainty and disclosure (bits) beyond the thresholds; ``spanned`` has text and base."""
    entities = spanned.where(F.size("base") > 0).select("text", F.xxhash64("text").alias("th"), F.explode("base").alias("e"))
    begin = F.greatest(F.lit(0), F.col("e.start") - CONTEXT_CHARS)
    # A word that the window's edge cuts is left out, unless the text ends there.
    before = F.regexp_replace(F.substring("text", begin + 1, F.col("e.start") - begin), F.when(begin > 0, "^" + _WORD).otherwise("^$"), F.lit(""))
    after = F.regexp_replace(F.substring("text", F.col("e.end") + 1, F.lit(CONTEXT_CHARS)), F.when(F.length("text") > F.col("e.end") + CONTEXT_CHARS, _WORD + "$").otherwise("^$"), F.lit(""))
    value = F.concat("e.kind", F.lit(":"), F.lower(F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))))
    near = entities.select("th", F.xxhash64(value).alias("entity"), _terms(F.concat(before, F.lit(" "), after)).alias("terms"))
    near = written(near, "contexts")
    held = near.select("entity", "th").distinct().groupBy("entity").agg(F.count("*").alias("held"))
    held = written(held.where(F.col("held") >= SUPPORT), "held")  # others cannot be met that often
    pairs = near.join(held, "entity").select("entity", "th", F.explode("terms").alias("term"))
    met = written(pairs.distinct().groupBy("entity", "term").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT), "met")
    # Texts that have a term in such a context are some of all that have it: that rules out common words before texts are searched.
    least = written(pairs.select("term", "th").distinct().groupBy("term").agg(F.count("*").alias("least")), "least")
    met = written(met.join(least, "term").where(F.col("support") >= CERTAINTY * F.col("least")).drop("least"), "met")
    known, n = _few(met.select("term").distinct())
    if n == 0:
        return met.selectExpr("term", "entity", "support", "0d certainty", "0d disclosure")
    texts = spanned.select(F.xxhash64("text").alias("th")).distinct().count()
    counts = spanned.select(F.xxhash64("text").alias("th"), F.explode(_terms(F.col("text"))).alias("term")).join(known, "term").distinct()
    counts = written(counts.groupBy("term").agg(F.count("*").alias("n")), "counts")
    certainty = F.col("support") / F.col("n")
    rated = met.join(counts, "term").join(held, "entity").select("term", "entity", "support", certainty.alias("certainty"), F.log2(certainty * texts / F.col("held")).alias("disclosure"))
    return written(rated.where((F.col("certainty") >= CERTAINTY) & (F.col("disclosure") >= BITS)), "revealing")


def _few(terms: DataFrame) -> tuple[DataFrame, int]:
    """Terms, written, marked for a broadcast if they are few; and how many they are."""
    terms = written(terms, "terms")
    n = terms.count()
    return (F.broadcast(terms) if n <= BROADCAST_TERMS else terms), n


def with_spans(documents: DataFrame) -> DataFrame:
    """Adds ``base`` and ``terms``: spans as array<struct<kind, start, end>>, terms without those that a base span covers."""
    documents = documents.drop("base", "terms")
    spanned = base_spans(documents)
    known, n = _few(revealing_terms(spanned).select("term").distinct())
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    if n == 0:
        return spanned.withColumn("terms", none)
    # Texts with such a term, once each, word by word: places are running sums of what lies between the words and of the words.
    th = F.md5(F.col("text").cast("binary"))
    hits = documents.select(th.alias("th"), F.explode(_terms(F.col("text"))).alias("term")).join(known, "term").select("th").distinct()
    texts = documents.select(th.alias("th"), "text").join(written(hits, "hits"), "th").dropDuplicates(["th"])
    pairs = F.arrays_zip(F.split("text", _WORD, -1).alias("gap"), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("word"))
    each = texts.select("th", F.posexplode(pairs).alias("i", "x")).where("x.word is not null").select("th", "i", F.col("x.word").alias("word"), F.length("x.gap").alias("gap"))
    order = Window.partitionBy("th").orderBy("i")
    ends = each.withColumn("end", F.sum(F.col("gap") + F.length("word")).over(order).cast("int"))
    spans = ends.withColumn("term", F.lower("word")).join(known, "term").select("th", F.struct(F.lit("term").alias("kind"), (F.col("end") - F.length("word")).alias("start"), "end").alias("span"))
    spans = written(spans.groupBy("th").agg(F.array_sort(F.collect_list("span")).alias("terms")), "spans")
    (key,) = unused(documents, "th")
    joined = spanned.withColumn(key, th).join(spans.withColumnRenamed("th", key), key, "left").drop(key)
    free = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.withColumn("terms", free)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(documents: DataFrame) -> DataFrame:
    """``documents`` with every base and term span generalised to its kind in brackets; where spans overlap, the first stays."""
    found = with_spans(documents)
    ordered = F.array_sort(F.concat("base", "terms"), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(y["end"] - x["end"]))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        passed = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), passed.alias("out")))

    clean = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", clean).drop("base", "terms")


def op5(documents: DataFrame) -> DataFrame:
    """The contract's columns, a row per document."""
    found = with_spans(documents.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"))
