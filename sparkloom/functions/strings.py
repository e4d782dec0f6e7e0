"""Column expressions for text: tokens, similarity, relevance and classification."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Suffixes, of which a word of four letters or more drops the longest that fits at its end (fixed value of the similarity measure).
SUFFIXES = ("ing", "tion", "sion", "ment", "ness", "able", "ible", "ful", "less", "ous", "ive", "ize", "ise", "ated", "ting", "ted", "ed", "ly", "er", "es", "s")


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased words of letters, digits, _ and -; null text has none."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s_-]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) >= least)


def token_set(text: Column, least: int = 2) -> Column:
    return F.array_distinct(tokens(text, least))


def stem(word: Column) -> Column:
    return F.when(F.length(word) >= 4, F.regexp_replace(word, f"(?:{'|'.join(SUFFIXES)})$", "")).otherwise(word)


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries as SQL engines take them: only A-Z, a-z, 0-9 and _ are of words, so ``test`` ends before ``ä``."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def stems(text: Column) -> Column:
    """Distinct stems of the words of three letters or more that carry a topic."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " ")
    kept = F.filter(F.split(clean, r"\s+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, stem))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two token sets; what two empty sets give differs between uses and is stated by the caller."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(both / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by the smaller array; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def normal_name(name: Column) -> Column:
    """Trimmed, lower-cased, without a trailing version, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+v?[0-9]+(\.[0-9]+)*$", ""), r"\s+", " "))


def count_of(text: Column, word: Column | str) -> Column:
    """Occurrences of a literal, case-insensitively."""
    if isinstance(word, str):  # one pass over the text, nothing is copied
        return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?iu)" + re.escape(word)))
    w = F.lower(word)
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("int")


def relevance(text: Column, words: list[str], age_days: Column, horizon: float = 30.0) -> Column:
    """Keyword hits by text length (per 100 characters, at most 1) and recency (1 falling to 0.1), at 0.6 and 0.4; 0 without a hit."""
    hits = F.lit(0)
    for w in words:
        hits = hits + count_of(text, w)
    density = F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), F.length(text) / 100.0))
    recent = F.greatest(F.lit(0.1), 1.0 - age_days / horizon)
    return F.when(hits > 0, 0.6 * density + 0.4 * recent).otherwise(0.0)


def classify(text: Column, classes: list[tuple[str, str]], default: str = "general") -> Column:
    """The first class whose pattern is found."""
    out = None
    for name, pattern in classes:
        hit = F.coalesce(text, F.lit("")).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def line_hash(line: Column) -> Column:
    return F.substring(F.sha2(line, 256), 1, 16)


def alias_of(a: Column, b: Column) -> Column:
    """Whether two names mean the same: equal when normalised, one a whole word of the other, or few edits apart."""
    x, y = normal_name(a), normal_name(b)
    edits = F.levenshtein(x, y)
    inside = (F.length(x) >= 3) & F.array_contains(F.split(y, " "), x) | (F.length(y) >= 3) & F.array_contains(F.split(x, " "), y)
    return (x == y) | inside | (edits <= 2) & (edits <= 0.3 * F.greatest(F.length(x), F.length(y)))


def module_of(path: Column, depth: int = 3) -> Column:
    """The leading directories of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(1)))), "/")


#: How a text says that something took the place of another; the first group is the old one (fixed values).
SUPERSEDED = (
    r"switched\s+from\s+(.+?)\s+to\s+", r"replaced\s+(.+?)\s+with\s+", r"migrated\s+from\s+(.+?)\s+to\s+", r"deprecated\s+(.+?)\s+in\s+favor\s+of", r"moved\s+(?:away\s+)?from\s+(.+?)\s+to\s+",
    r"abandoned\s+(.+?)\s+(?:for|in\s+favor\s+of)", r"dropped\s+(.+?)\s+(?:for|in\s+favor\s+of)", r"transitioned\s+from\s+(.+?)\s+to\s+",
)
#: How prompts and chat begin, and how sentences say that something was chosen (shortened lists of common words).
NOISE = r"(?i)^(the (codebase|project|repo|code|system|file|directory|folder)\b|(based on|according to|looking at|after reading|from the|in the|as per)\b|(now|ok|sure|yes|no|alright|so|well|right|let me|i'll|i will|here'?s) |/)"
CHOICE = r"(?i)\b(chose|decided|switched to|switched from|adopted|migrated to|replaced .+ with|introduced|redesigned|consolidated|unified|deprecated|instead of|rather than|in favor of|versus|went with|settled on|picked|opted for|committed to|reverted to|rolled back)\b"


def superseded(text: Column) -> Column:
    """The old name in the first pattern that is found, or null."""
    found = [F.nullif(F.trim(F.regexp_extract(text, "(?i)" + p, 1)), F.lit("")) for p in SUPERSEDED]
    return F.coalesce(*found)


def noisy(text: Column) -> Column:
    return F.trim(text).rlike(NOISE)


def decides(text: Column) -> Column:
    """Whether a sentence of 15 to 300 characters, beginning with a capital, says that something was chosen."""
    return F.length(text).between(15, 300) & F.trim(text).rlike("^[A-Z]") & text.rlike(CHOICE)


def slug(text: Column, n: int = 60) -> Column:
    """The first characters of a text, lower-cased, letters, digits and hyphens only."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.substring(text, 1, n))), "[^a-z0-9 -]", ""), r"\s+", "-")


def week_key(date: Column) -> Column:
    """Year and week counted in sevens from the first of January (not ISO)."""
    return F.concat_ws("-W", F.year(date).cast("string"), F.lpad((F.floor((F.dayofyear(date) - 1) / 7) + 1).cast("string"), 2, "0"))


def iso_week(date: Column) -> Column:
    return F.concat_ws("-W", F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
