"""Documents made ready for training, stage after stage.

Every stage reads what the one before it wrote. All but the last return documents with the
columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywire.llm.exact_dedup import without_copies
from tallywire.llm.mixing import in_mixed_order
from tallywire.llm.packing import pack
from tallywire.llm.queries import packed_digest, table, tokenizer_path
from tallywire.llm.signature_join import one_of_each
from tallywire.llm.toxicity import toxicity_model, without_toxic
from tallywire.plans.sizes import settled


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject; it learns from the labels of this folder."""
    return without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return without_copies(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, by shingles of five words and 80 percent, the smallest doc_id."""
    return one_of_each(docs, width=5, share=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix, so that they are packed in it."""
    return in_mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packed_digest(pack(docs, tokenizer_path()))


STAGES = [
    ("toxicity", clean),
    ("exact dedup", unique),
    ("n-gram Jaccard join", distinct),
    ("mixing sources", mixed),
    ("packing", packed),
]

# Networks, tokenizers and the order of online packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
