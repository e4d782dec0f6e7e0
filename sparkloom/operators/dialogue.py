"""Conversation structure: turns from tool logs, segments, prompt features and comprehension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_up
from ..functions.strings import jaccard, token_set, tokens


def flat_content(content: Column) -> Column:
    """Text of a message whose content is a JSON string or an array of blocks: its text blocks, one a line."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return F.when(content.startswith("["), F.coalesce(joined, F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def linked_turns(entries: DataFrame) -> DataFrame:
    """Turn order of log entries (session, uuid, parent) by their parent pointers: root, depth; cycles and orphans end by themselves.

    Pointer doubling: the hops from an entry to its root take as many rounds as their number has bits, and no path without a
    cycle is longer than there are entries.
    """
    from .graphs import _cut

    known = entries.select("session", F.col("uuid").alias("parent"), F.lit(True).alias("known")).distinct()
    parent = F.when(F.col("known"), F.col("parent"))
    up = entries.select("session", "uuid", "parent").join(known, ["session", "parent"], "left")
    state = _cut(up.select("session", "uuid", parent.alias("up"), F.when(parent.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.coalesce(parent, "uuid").alias("root")))
    for _ in range(max(1, state.count().bit_length())):
        far = state.select("session", F.col("uuid").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        state = _cut(state.join(far, ["session", "up"], "left").select("session", "uuid", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root")))
        if state.where("up is not null").limit(1).count() == 0:
            break
    return state.select("session", "uuid", "root", "depth")


def filled_context(lines: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """Items of a log whose context is on earlier meta lines: each field takes its last value so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})


def segments(turns: DataFrame, conv: str, turn: str, text: str, least_similarity: float = 0.05, marker: str = r"(?i)^(now|next|also|instead|actually|ok so)\b", least_turns: int = 1) -> DataFrame:
    """Segments of a conversation: a new one where a turn shares hardly a word with the one before or opens with a marker."""
    w = Window.partitionBy(conv).orderBy(turn)
    own = turns.select(conv, turn, text, token_set(F.col(text)).alias("__x"))
    before = own.withColumn("__y", F.lag("__x").over(w))
    fresh = F.col("__y").isNull() | (jaccard(F.col("__x"), F.col("__y"), 0.0) < least_similarity) | F.col(text).rlike(marker)
    numbered = before.withColumn("segment", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(conv, "segment").agg(F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count("*").alias("n_turns")).where(F.col("n_turns") >= least_turns)


def prompt_features(turns: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Words, questions, list items, code references, constraints and a specificity from 0 to 1 (an eighth a point, at most 8)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(tokens(t, 1))
    points = (
        F.when(words >= 10, 1).otherwise(0) + F.when(words >= 30, 1).otherwise(0) + F.when(t.contains("?"), 1).otherwise(0) + F.when(t.rlike(r"(?m)^\s*[-*0-9]"), 1).otherwise(0)
        + F.when(t.rlike(r"[A-Za-z_]+\(|`"), 1).otherwise(0) + F.when(t.rlike(r"(?i)\b(must|should|only|never|without)\b"), 1).otherwise(0) + F.when(t.rlike(r"[0-9]"), 1).otherwise(0) + F.when(t.rlike(r"[A-Za-z0-9_]+\.[a-z]{1,4}\b"), 1).otherwise(0)
    )
    kind = F.when(t.rlike(r"(?i)\b(why|how|what|explain)\b"), "question").when(t.rlike(r"(?i)\b(fix|bug|error|fail)"), "debug").when(t.rlike(r"(?i)\b(add|create|write|build|implement)\b"), "create").otherwise("other")
    return turns.select(conv, turn, words.cast("long").alias("words"), F.regexp_count(t, F.lit(r"\?")).cast("long").alias("questions"), half_up(points / 8.0, 4).alias("specificity"), kind.alias("kind"))


def softmax_label(scores: DataFrame, by: list[str], label: str, score: str, temperature: float = 1.5) -> DataFrame:
    """The likeliest label of each key, with its share of the softmax."""
    weight = F.exp(F.col(score) / temperature)
    return scores.groupBy(*by).agg(F.max_by(label, F.struct(score, label)).alias("label"), (F.max(weight) / F.sum(weight)).alias("__c")).select(*by, "label", half_up(F.col("__c"), 4).alias("confidence"))


def comprehension(turns: DataFrame, conv: str, role: str, text: str) -> DataFrame:
    """Five dimensions of how a user steers a conversation (0 to 10) and their weighted whole (0 to 100)."""
    user = F.col(role) == "user"
    n = F.count_if(user)
    share = lambda pattern: F.when(n > 0, F.count_if(user & F.col(text).rlike(pattern)) / n).otherwise(0.0)
    dims = {
        "steering": share(r"(?i)\b(instead|should|change|use|make)\b"), "understanding": share(r"(?i)\b(because|since|why|therefore)\b"), "metacognition": share(r"(?i)\b(i think|not sure|maybe|confus)"),
        "independence": share(r"(?i)\b(i will|my own|already|i did)\b"), "engagement": F.when(n > 0, clamp(F.avg(F.when(user, F.size(tokens(F.col(text), 1)))) / 50)).otherwise(0.0),
    }
    weights = (0.25, 0.25, 0.15, 0.2, 0.15)
    out = turns.groupBy(conv).agg(n.alias("n_user"), *[(10 * v).alias(k) for k, v in dims.items()])
    whole = 10 * sum(F.col(k) * w for k, w in zip(dims, weights))
    return out.select(conv, "n_user", *[half_up(F.col(k), 2).alias(k) for k in dims], half_up(whole, 2).alias("overall"))


def outcome(files: Column, iterations: Column, text: Column) -> Column:
    """How a session ended: files changed mean success, words of giving up abandonment, many rounds without files failure."""
    return F.when(F.coalesce(files, F.lit(0)) > 0, "success").when(F.coalesce(text, F.lit("")).rlike(r"(?i)\b(never ?mind|forget it|give up|abandon)"), "abandoned").when(iterations > 5, "failed").otherwise("partial")


def learned_domain(words: DataFrame, token: str, least: int, most: int) -> DataFrame:
    """name, tokens and seen of the domain that frequent words make; no row for fewer than three such words."""
    frequent = words.groupBy(token).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = frequent.orderBy(F.desc("n"), token).limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), token))).alias("x"))
    names = F.transform("x", lambda x: x[token])
    whole = frequent.agg(F.sum("n").alias("seen"), F.count("*").alias("k"))
    return best.join(F.broadcast(whole)).where("k >= 3").select(F.array_join(F.slice(names, 1, 3), "-").alias("name"), F.array_join(names, ",").alias("tokens"), "seen")


def first_class(rows: DataFrame, key: str, text: str, classes: list[tuple[str, str]], default: str = "general") -> DataFrame:
    """``domain`` of each key: the first class whose pattern any of its texts has."""
    found = rows.groupBy(key).agg(*[F.max(F.col(text).rlike(p)).alias(name) for name, p in classes])
    return found.select(key, F.coalesce(*[F.when(F.col(name), F.lit(name)) for name, _ in classes], F.lit(default)).alias("domain"))


def turn_texts(detail: Column) -> Column:
    """array<string>: a JSON list of texts, else the pieces between bars, else the text."""
    given = F.from_json(detail, "array<string>")
    return F.when(F.trim(detail).startswith("[") & given.isNotNull(), given).otherwise(F.split(detail, r" \| ", -1))


def topic(modules: Column, sentence: Column, most: int = 3) -> Column:
    """Up to ``most`` modules, then how many more; without any, the sentence's first 80 characters."""
    n = F.size(modules)
    first = F.array_join(F.slice(modules, 1, most), ", ")
    return F.when(n == 0, F.substring(sentence, 1, 80)).when(n <= most, first).otherwise(F.concat(first, F.lit(" (+"), (n - most).cast("string"), F.lit(" more)")))


def promoted(counters: DataFrame, n: str, every: int, rest: int) -> DataFrame:
    """promoted, held and cooldown of counters that are promoted and reset at every ``every``-th count and rest for ``rest`` more.

    As the rest is shorter than the way to the next promotion it never delays one.
    """
    left = F.col(n) % every
    return counters.withColumns({"promoted": F.floor(F.col(n) / every).cast("long"), "held": left, "cooldown": F.when(F.col(n) >= every, F.greatest(F.lit(0), rest - left)).otherwise(0)})


def metacognition(turns: DataFrame, key: str, text: str, kinds: dict[str, str], all_kinds: int) -> DataFrame:
    """n_turns, density (signals by turns) and breadth (share of all kinds) per key; a turn counts once for each kind."""
    from ..functions.numeric import half_up

    marked = turns.select(key, *[F.col(text).rlike(p).cast("int").alias(k) for k, p in kinds.items()])
    g = marked.groupBy(key).agg(F.count("*").alias("n_turns"), *[F.sum(k).alias(k) for k in kinds])
    signals, seen = sum(F.col(k) for k in kinds), sum(F.when(F.col(k) > 0, 1).otherwise(0) for k in kinds)
    return g.select(key, "n_turns", half_up(signals / F.col("n_turns"), 3).alias("density"), half_up(seen / float(all_kinds), 3).alias("breadth"))
