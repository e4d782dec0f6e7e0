"""Banded rules and prompt scores, by hand."""

from pyspark.sql import functions as F

from sparkloom.functions import prompts as PR
from sparkloom.functions import rules as RU
from sparkloom.functions import strings as S


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lit(*values):
    return [F.lit(v) for v in values]


def test_bands(spark):
    assert one(spark, *[RU.engagement_quality(*lit(*x)) for x in ((8, 6, 1, 0), (8, 6, 0, 0), (3, 3, 0, 3), (3, 3, 1, 3), (5, 4, 0, 0))]) == (5, 4, 1, 2, 3)
    assert one(spark, *[RU.complexity(*lit(*x)) for x in ((1, 0, 0, 3.0), (2, 5, 0, 3.0), (5, 10, 2, 3.0), (10, 20, 6, 1.0))]) == (1.5, 1.0, 0.7, 0.5)
    assert [round(x, 6) for x in one(spark, *[RU.feedback_threshold(F.lit(x)) for x in (0.0, 0.3, 1.0)])] == [0.3, 0.3, 0.6]
    assert round(one(spark, RU.loop_risk(*lit(25, True, 0.1, 4))), 6) == 1.0 and one(spark, RU.loop_risk(*lit(3, False, 0.9, 0))) == 0.0
    assert one(spark, *[RU.depth_level(*lit(*x)) for x in ((5, 1.5), (6, 1.0), (2, 3.5))]) == (0, 1, 2)
    assert round(one(spark, RU.relevance(F.lit(0.5), *lit(True, True, "debugging", "pattern", True))), 6) == 0.8


def test_token_bag(spark):
    words = F.array(*lit("go", "with", "react"))
    assert round(one(spark, RU.token_bag(words, ["go with", "chose"], ["react"])), 6) == 0.65
    assert one(spark, RU.token_bag(words, ["chose"], ["react"])) == 0.0


def test_prompts(spark):
    scores = PR.type_scores(F.lit("Fix the crash on line 12 of src/app/main.py"))
    top = one(spark, *scores.values())
    assert max(zip(top, scores))[1] == "debugging" and round(dict(zip(scores, top))["debugging"], 6) == 0.8
    empty = one(spark, *PR.type_scores(F.lit("")).values())
    assert dict(zip(scores, empty))["discovery"] == 0.05 and sum(empty) == 0.05
    assert round(sum(one(spark, *PR.softmax(scores).values())), 6) == 1.0
    assert one(spark, *[PR.constraint(F.lit(x)) for x in ("You must", "You should", "must, ideally", "x")]) == ("hard", "soft", "mixed", "none")
    kinds = [x["kind"] for x in one(spark, PR.decomposed(F.lit("Do this\n1. first\n- a\n\nwhy?\nnever that\n    code()")))]
    assert kinds == ["statement", "step", "bullet", "question", "constraint", "code"]


def test_sentences(spark):
    assert one(spark, S.superseded(F.lit("They moved away from Redis to DuckDB"))) == "Redis" and one(spark, S.superseded(F.lit("plain"))) is None
    assert one(spark, S.decides(F.lit("Chose DuckDB rather than Redis")), S.decides(F.lit("chose DuckDB rather than Redis")), S.noisy(F.lit("Let me look"))) == (True, False, True)
    assert one(spark, S.slug(F.lit("  Stuck on X: #3 "))) == "stuck-on-x-3"
    assert one(spark, *[S.stem(F.lit(x)) for x in ("testing", "tested", "the", "nation")]) == ("tes", "tes", "the", "na")
