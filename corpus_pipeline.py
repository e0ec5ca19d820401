"""A corpus pipeline of five operators: quality rules, line dedup, near-duplicate removal, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared
folder and reads them again for the next, and removes what is no longer read. All stages but the last return the columns of documents,
clashing names of the caller's included. A table without rows stays without rows; what becomes of nulls and repeated ids is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, jaccard, linededup, mixing, quality
from termweave.llm.common import discard, settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or come from a host whose shrunk failure rate is too high, go. A null or empty text has too few words and goes; each of the rows of one id is judged by its own text."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document that loses all its lines goes, as what it said stands elsewhere. Equal rows lose the same lines; a null text has none to lose and stays null."""
    out = linededup.dedup(docs).filter((F.col("__n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = F.when(F.col("__n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles at 0.8 hold together, the one of least id stays. Rows of one id are one document and stay together; rows without an id stay."""
    return jaccard.keep_one(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by their rates, at most once each: clean text stays, low and toxic text falls to its share. Rows of one id share a rate; rows without an id stay."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), max_rate=1.0)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of the bytes they decode to, and ids (packed), for each row; a null text is empty."""
    import public_tokenizers as P

    encoded = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing_weights), ("bpe", byte_bpe)]

#: No SQL expresses these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
