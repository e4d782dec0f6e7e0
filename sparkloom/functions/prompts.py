"""What a prompt is about, as column expressions: type scores, structure, decomposition into typed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import ascii_bounds

#: Words by which a prompt's type shows (fixed values).
VERBS = {
    "debugging": r"\b(?:fix|debug|investigate|diagnose|troubleshoot|resolve|track\s+down|figure\s+out\s+why|find\s+the\s+bug|what(?:'?s)?\s+wrong|broken|failing|error|crash|exception|stack\s*trace)\b",
    "building": r"\b(?:add|create|implement|build|make|write|generate|set\s+up|scaffold|new\s+feature|introduce)\b",
    "discovery": r"\b(?:explain|what\s+does|how\s+does|why\s+does|what\s+is|show\s+me|walk\s+me\s+through|describe|understand|where\s+is|find|search|look\s+for)\b",
    "refactoring": r"\b(?:refactor|rename|extract|restructure|reorganize|simplify|clean\s+up|decouple|split|move|consolidate)\b",
    "testing": r"\b(?:test|write\s+tests|add\s+tests|unit\s+test|integration\s+test|coverage|spec|assert|expect|mock|stub|e2e)\b",
    "review": r"\b(?:review|check|audit|evaluate|assess|best\s+practice|code\s+quality|lint|improve|optimize)\b",
    "configuring": r"\b(?:configure|setup|config|deploy|ci/cd|pipeline|docker|environment|env|install|package|dependency|build\s+config)\b",
    "explaining": r"\b(?:document|comment|explain|annotate|readme|description|jsdoc|tsdoc|how\s+to\s+use)\b",
}
HARD = r"(?i)\b(?:must|shall|require|never|always|exactly|only|do\s+not|don'?t)\b"
SOFT = r"(?i)\b(?:should|prefer|ideally|try\s+to|consider|might\s+want|could)\b"
EXAMPLE = r"(?i)\b(?:example|for\s+instance|e\.g\.|such\s+as|like\s+this|expected\s+output|should\s+look\s+like|should\s+return)\b"
FILES = r"(?:^|\s)((?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+\.\w+)"
#: Weights of a verb, of what stands around it, and of a text's structure.
VERB, CONTEXT, STRUCTURE = 0.25, 0.2, 0.15


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_bounds(pattern)))


def sentences(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?\n]"), lambda s: F.trim(s) != ""))


def question_ratio(text: Column) -> Column:
    n = sentences(text)
    return F.when(n > 0, hits(text, r"\?") / n).otherwise(0.0)


def type_scores(text: Column, position: Column | None = None) -> dict[str, Column]:
    """A score for each type; a text without any signal is discovery at 0.05.  ``position``: where in its conversation, 0 to 1."""
    text = F.coalesce(text, F.lit(""))
    score = {k: VERB * hits(text, "(?i)" + p) for k, p in VERBS.items()}
    ratio, files, lines = question_ratio(text), hits(text, FILES), hits(text, r"(?i)\bline\s+\d+\b") > 0
    score["discovery"] = score["discovery"] + F.when(ratio > 0.5, 2 * CONTEXT).when(ratio > 0.25, CONTEXT).otherwise(0.0) + F.when((files == 0) & (ratio > 0.3), STRUCTURE).otherwise(0.0)
    score["debugging"] = score["debugging"] + F.when(lines, 2 * STRUCTURE).otherwise(0.0)
    score["refactoring"] = score["refactoring"] + F.when(lines, STRUCTURE).otherwise(0.0)
    score["building"] = score["building"] + F.when(files > 3, STRUCTURE).otherwise(0.0)
    if position is not None:
        score["discovery"] = score["discovery"] + F.when(position < 0.2, 0.08).otherwise(0.0)
        score["review"] = score["review"] + F.when(position > 0.8, 0.08).otherwise(0.0)
    none = F.greatest(*score.values()) == 0
    return score | {"discovery": F.when(none, 0.05).otherwise(score["discovery"])}


def softmax(scores: dict[str, Column], temperature: float = 1.5) -> dict[str, Column]:
    top = F.greatest(*scores.values())
    exps = {k: F.exp((v - top) / temperature) for k, v in scores.items()}
    whole = sum(exps.values())
    return {k: v / whole for k, v in exps.items()}


def constraint(text: Column) -> Column:
    hard, soft = text.rlike(ascii_bounds(HARD)), text.rlike(ascii_bounds(SOFT))
    return F.when(hard & soft, "mixed").when(hard, "hard").when(soft, "soft").otherwise("none")


def depth(text: Column) -> Column:
    """Numbered steps, or 2 for more than two bullet points, or 1."""
    steps, bullets = hits(text, r"(?m)^\s*\d+[.)]\s"), hits(text, r"(?m)^\s*[-*]\s")
    return F.when(steps > 0, steps).when(bullets > 2, 2).otherwise(1)


def decomposed(text: Column) -> Column:
    """array<struct<kind, line>> of the lines that hold something, each by the first kind that fits."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s) != "")

    def kind(line: Column) -> Column:
        return (
            F.when(line.rlike(r"^\s*```|^\s{4,}\S"), "code").when(line.rlike(r"^\s*\d+[.)]\s"), "step").when(line.rlike(r"^\s*[-*]\s"), "bullet").when(line.contains("?"), "question")
            .when(line.rlike(ascii_bounds(HARD)) | line.rlike(ascii_bounds(SOFT)), "constraint").when(line.rlike(ascii_bounds(EXAMPLE)), "example").otherwise("statement")
        )

    return F.transform(lines, lambda s: F.struct(kind(s).alias("kind"), F.trim(s).alias("line")))
