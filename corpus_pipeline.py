"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Language identification drops documents that resemble no learned language; shingle similarity keeps one document of each group of
near-duplicates; personal data are replaced by their kinds; sources are mixed to target weights; texts are encoded.
Every stage but the last returns the columns of ``documents``.

Defined results: a null or empty text, or one without letters, is rejected by the first stage; where no document names a language, all
others stay. Of rows with one doc_id near-duplicates keep the least; rows without a doc_id stay. A null text has no personal data. A
null source is a source of its own in the mix; repeated doc_ids draw the same number of copies; with no documents left every
stage returns none. A null text encodes to no ids, 0 tokens and the digest of the empty string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm import bpe, copies, langid, mixing, pii
from slotloom.llm.common import documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has letters and comes near enough to a profile. Languages, and what is near enough, are learned from all of ``docs`` that name one."""
    profiles = langid.learn(docs)
    least = langid.least_score(docs, profiles)
    found = langid.identify(docs, profiles)
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != "und") & (F.col(score) >= least)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group; 5-word shingles of a Jaccard index of 0.8 or more link."""
    return copies.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by their kinds in brackets; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.lit(0).cast("bigint"))) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by the repetition rates of their sources, in a global order."""
    return mixing.poisson_mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit integers), their number, and the digest of what they decode to."""
    tokenizer = bpe.default_tokenizer()
    out = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), tokenizer).drop("text")
    out = bpe.bpe_decode(out, tokenizer).withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")
    return out.withColumn("n_tokens", F.expr("coalesce(cast(octet_length(ids) div 4 as bigint), 0)"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("encode", encode)]

#: SQL cannot express learned profiles, components or merges; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
