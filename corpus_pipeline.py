"""From raw documents to token ids: five stages, each one operator over all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudspark.llm import byte_bpe, decontaminate, factorisation_machine, line_dedup, order_minhash
from shroudspark.llm._common import drop_table, read, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Lines in more documents than this stay only in the first of them.
MAX_LINE_DOCS = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that aren't toxic.

    Null and empty texts are scored by their metadata; without labels all are kept;
    repeated rows are treated alike; columns other than those of documents aren't kept.
    """
    return factorisation_machine.keep_good(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Widely shared lines stay in the document of lowest id; documents left without text go.

    Null texts stay, and so do texts that were blank before; rows with a null id count as
    one document, which is the lowest; repeated rows are cleaned alike.
    """
    cleaned = line_dedup.dedup_lines(docs, max_docs=MAX_LINE_DOCS, keep_first=True)
    return cleaned.filter(~((F.col("n_dropped") > 0) & (F.trim("text") == ""))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of lowest id.

    Rows with a null id, a null text or no word are no duplicates; of rows that repeat an
    id and a text one stays.
    """
    return order_minhash.drop_duplicates(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly made of them.

    Null and empty texts and items match nothing, nor does an empty benchmark.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text; null for a null text, no ids for an empty one."""
    return byte_bpe.encode(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: A trained classifier, alignment and merges are outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; of the tables between them one is kept at a time."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
