"""From raw documents to packed training sequences; each stage's result is written as Parquet and read by the next.

Toxicity, SimHash near-dedup, secret redaction, mixing sources to target weights, best-fit packing.  A stage sees all that
its predecessor kept.  Classifying and packing go beyond SQL, so there is no ORACLE_SQL; tests hold the stages against
brute-force versions.

Defined results: a null text counts as empty in every stage and stays null until the mix, which takes no words of it, so
it is in no sequence; a row without doc_id is judged by its text; of equal rows and of rows in one near-duplicate class one
stays, that of the smallest doc_id; an empty table gives no rows.  Columns beside doc_id, text, source and n_chars pass
through the first four stages whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import mixing, packing, secrets, simhash, toxicity
from siltstone.llm.common import saved, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, and one cut document a source, to each source's target."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("simhash near-dedup", one_of_each), ("secret scans", without_secrets), ("source mixing", mixed), ("best-fit packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
