"""Queries of the ten operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import SQL as CHAT_SQL
from .shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_value, toxic, n_words, segments) of every document."""
    from .toxicity import fit, passages

    docs = table(spark, sf_dir, "documents")
    return passages(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: its group of near copies, and the number of its near copies."""
    from .spotsigs import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op3_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, n_texts, n_template, content) of every page."""
    from .wrapper import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, first, past, edits) of every leak of a benchmark item."""
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, license, first, past, coverage) of every licence notice."""
    from .license import notices

    return notices(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: its group of near copies, and the number of its near copies."""
    from .simhash import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of every conversation with a reply."""
    from .chat import contrast, format_pairs

    return format_pairs(contrast(table(spark, sf_dir, "conversations")))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first, past): runs of at least 50 words that also stand in another document."""
    from .substrings import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every document."""
    from .bpe import encode_and_check

    return encode_and_check(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_values): every document with pseudonyms."""
    from .pii import pseudonyms

    return pseudonyms(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_spotsigs, op3_wrapper, op4_decontamination, op5_licenses, op6_simhash, op7_preferences, op8_substrings, op9_bpe, op10_pii)}
ORACLE_SQL: dict[str, str] = {"op7_preferences": CHAT_SQL}
