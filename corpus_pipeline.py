"""A corpus pipeline: toxicity, near-duplicates, decontamination, pseudonyms, tokens.  Each stage is written as Parquet and read again.

Cases, of all stages: a null or empty text is clean, has no copies, and is kept, with null ids or none at the end; a row with a null
doc_id is judged by its text alone, and is nobody's copy; of rows that repeat a doc_id one stays (of those that are clean, that with the least
text); of documents that tie as copies the least doc_id stays; very long texts are read whole; columns beside doc_id and text are kept, whatever
their names, up to the last stage, and n_chars, if there, follows the text; an empty table gives no rows; without a toxic and a clean label nothing
is rejected as toxic, and without benchmark items nothing as a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontam, pii, shared, simhash, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose text has a significant toxic passage; the model is fitted on the labelled rows of docs."""
    return toxicity.reject(docs, toxicity.fit(docs, shared.table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near copies: the one with the least doc_id."""
    return simhash.dedup(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a passage of a benchmark item."""
    return decontam.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with pseudonyms for personal numbers, dates and addresses; n_chars follows the text."""
    out = pii.rewrite(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): byte-level BPE ids of every document, decoded again and compared."""
    return bpe.encode_and_check(docs)


STAGES = [("toxicity", toxic_out), ("near-duplicates", near_copies_out), ("decontamination", leaks_out), ("pii", pseudonymous), ("bpe", tokens)]

#: Trained scores, fingerprints and keyed permutations are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
