"""Queries of the text operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labels, language, lexical, ogg, pieces, quality, repeats, secret_scan, set_join, target_rates, templates, token_files, toxic_spans, window_repeats
from .common import fold, table

#: Most labelled texts of each label (and of each language) that a classifier is fitted on.
LABELLED = 1500
PER_LANGUAGE = 600
#: n-grams in a language's or document's profile.
PROFILE = 400
#: Score from which a document counts as label 1.
CUT = 0.3

#: Words of the shortest passage that is told of.
PASSAGE = 51


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _folded(scores: DataFrame, modulus: int, held: int) -> DataFrame:
    return scores.withColumn("held_out", fold("doc_id", modulus) == held)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"), 400, PASSAGE)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit(docs, fold("doc_id", 4) != 2, PER_LANGUAGE, PROFILE)
    return _folded(language.identify(docs, profiles), 4, 2).select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, share = labels.sample(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2, LABELLED)
    found = toxic_spans.tag(docs, toxic_spans.fit(rows, share))
    told = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))
    return _folded(found, 4, 2).select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.array_join(told, ",").alias("spans"))


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.described(table(spark, sf_dir, "documents"))
    found = quality.scored(rows, quality.fit_all(labels.taught(rows, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)))
    return _folded(found, 5, 0).select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(table(spark, sf_dir, "documents"))


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), repeats=None, shortest=1)


def op11_window_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_repeats.digests(table(spark, sf_dir, "documents"), 20)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_target_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_rates.encode(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_repeats, op3_pieces, op4_token_files, op5_language, op6_toxicity, op7_set_join, op8_quality, op9_ogg, op10_templates, op11_window_repeats, op12_lexical, op13_target_rates)}

ORACLE_SQL: dict[str, str] = {"op10_templates": templates.sql(), "op12_lexical": lexical.sql(), "op13_target_rates": target_rates.sql()}
