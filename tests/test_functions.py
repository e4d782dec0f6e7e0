"""Functions against values worked out by hand or by a plain second implementation."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import numeric as N
from sparkloom.functions import prompts as P
from sparkloom.functions import strings as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x,want", [(-2.5, -2.0), (2.5, 3.0), (-0.4, 0.0), (1.4999, 1.0)])
def test_half_up(spark, x, want):
    assert one(spark, N.half_up(F.lit(x))) == want


@pytest.mark.parametrize("z", [-3.0, -1.0, 0.0, 0.5, 2.3])
def test_normal_cdf(spark, z):
    assert one(spark, N.normal_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)


def test_decay(spark):
    assert one(spark, N.retrievability(F.lit(9.0), F.lit(1.0))) == pytest.approx(0.5)
    assert one(spark, N.retrievability(F.lit(0.0), F.lit(1.0))) == 1.0
    assert one(spark, N.retrievability(F.lit(5.0), F.lit(0.0))) == 1.0
    assert one(spark, N.stability_growth(F.lit(300.0), F.lit(5.0))) == 365.0
    assert one(spark, N.half_life(F.lit(14.0))) == pytest.approx(0.5)
    assert one(spark, N.weekly_confidence(F.lit(0.9), F.lit(21.0))) == pytest.approx(0.63)
    assert one(spark, N.weekly_confidence(F.lit(0.4), F.lit(28.0))) is None


def test_folds(spark):
    values = F.array(*[F.lit(float(v)) for v in (10, 20, 20)])
    assert one(spark, N.exponential_smoothing(values)) == pytest.approx([10.0, 13.0, 15.1])
    assert one(spark, N.exponential_smoothing(F.expr("cast(array() as array<double>)"))) == []
    assert one(spark, N.odds_update(0.5, F.array(F.lit(3.0)))) == pytest.approx(0.75)
    assert one(spark, N.odds_update(0.5, F.array(F.lit(1e9)))) == 0.99
    assert one(spark, N.chunk_means(F.array(*[F.lit(float(i)) for i in range(5)]), 2)) == [0.5, 2.5, 4.0]


def test_cosine_and_correlation_of_degenerate_input(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, N.cosine(zero, F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert rows.agg(N.pearson("x", "y").alias("r")).first()["r"] == 0.0
    assert rows.limit(0).agg(N.pearson("x", "y").alias("r"), N.variance("x").alias("v")).first() == (0.0, 0.0)


def test_text(spark):
    assert one(spark, S.tokens(F.lit("Ab c, d-e F_g!"))) == ["ab", "d-e", "f_g"]
    assert one(spark, S.tokens(F.lit(None).cast("string"))) == []
    none = F.expr("cast(array() as array<string>)")
    assert one(spark, S.jaccard(none, none, 1.0)) == 1.0
    assert one(spark, S.jaccard(none, F.array(F.lit("a")), 1.0)) == 0.0
    assert one(spark, S.normal_name(F.lit("  React   Native v1.2 "))) == "react native"
    assert one(spark, S.stem(F.lit("testing"))) == "tes"  # the suffix that begins first goes: ting
    assert one(spark, S.stem(F.lit("the"))) == "the"
    assert one(spark, S.alias_of(F.lit("Postgres"), F.lit("postgress"))) is True
    assert one(spark, S.alias_of(F.lit("cat"), F.lit("dog"))) is False
    assert one(spark, S.module_of(F.lit("src/a/b/c/d.py"))) == "src/a/b"
    assert one(spark, S.week_key(F.to_date(F.lit("2024-01-08")))) == "2024-W02"
    assert one(spark, S.count_of(F.lit("aXaxa"), "xa")) == 2


def test_words_end_before_letters_that_are_not_ascii(spark):
    """As in SQL: a word of A-Z ends before ä."""
    assert one(spark, P.type_scores(F.lit("der testä und äfix"))["testing"]) == 0.25
    assert one(spark, P.type_scores(F.lit("der testä und äfix"))["debugging"]) == 0.25
    assert one(spark, P.type_scores(F.lit("testa _fix"))["testing"]) == 0.0
    assert one(spark, P.constraint(F.lit("mustö"))) == "hard"
