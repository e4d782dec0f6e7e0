"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Stages take and return the columns of ``documents`` (doc_id, text, lang, source, n_chars); the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, langid, linededup, minhash, packing
from sparkloom.llm._shared import drop, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Share of a text's n-grams that its language must explain: at most this, and at most half of what it explains of all but one
#: in a hundred of all labelled texts of that language; n-grams from which a text is judged.
LANGUAGE_SCORE = 0.3
JUDGED_NGRAMS = 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of those learned from the labelled rows; lang becomes the predicted one where
    there was none.  Texts without letters go, and those long enough to be judged that no learned language explains."""
    training = docs.where(~langid.held_out()).select("doc_id", "lang", "text")
    model = langid.learn(training.select("lang", "text"))
    labelled = training.where("lang is not null")
    right = langid.identify(labelled.select("lang", "text"), model).where("lang = lang_pred")
    low = F.percentile(F.round("score", 4), 0.01)  # of ten-thousandths, so that a language has a bounded number of values
    least = {r.lang: min(LANGUAGE_SCORE, 0.5 * r.low) for r in right.groupBy("lang").agg(low.alias("low")).collect()}
    found = langid.identify(docs.select(*COLUMNS), model)
    enough = F.lit(False)
    for lang, score in least.items():
        enough = enough | (F.col("lang_pred") == lang) & (F.col("score") >= score)
    enough = enough | ~F.col("lang_pred").isin(*least) & (F.col("score") >= LANGUAGE_SCORE) if least else F.col("score") >= LANGUAGE_SCORE
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & ((F.col("n_grams") < JUDGED_NGRAMS) | enough))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the later copies of repeated line runs; documents of which no word is left go."""
    found = linededup.dedup_lines(docs.select(*COLUMNS))
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the least doc_id; words in fives, similarity 0.8."""
    found = written(minhash.near_duplicates(docs, k=5, percent=80).where("kept").select("doc_id").distinct(), "kept")
    same = docs.select(*COLUMNS).withColumnRenamed("doc_id", "__id").join(found, F.col("__id").eqNullSafe(F.col("doc_id")), "left_semi")
    return same.withColumnRenamed("__id", "doc_id").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more; the others stay as they are."""
    found = decontam.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontam.n_hit())
    return found.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 1024, with every source in proportion in every window."""
    return packing.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]
#: The stages are not SQL (n-gram filters, MinHash, an automaton, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a data directory."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
