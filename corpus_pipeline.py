"""A corpus pipeline of five stages over ``documents``: toxic texts go, one of each group of near-duplicates stays, repeated
passages are cut from all but the first text, personal data is masked, and what is left is packed into token windows.

Every stage works on all rows that the one before kept, and all but the last return the columns of ``documents``. Stages
take (spark, docs, sf_dir); ``run`` writes each stage's result as Parquet in the cluster's shared folder and reads it again;
these tables go when the application ends.
Nulls, empty and very long texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumiset.llm import chained_substrings, cnn_toxicity, packing, tensored_minhash, weak_pii
from lumiset.llm.common import cut_lineage, table
from lumiset.storage import forget_unused, new_folder

#: No SQL expresses the classifier and the alignments; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    forget_unused(spark)
    labels = table(spark, sf_dir, "labels")
    model = cnn_toxicity.fit(docs, labels)
    return cnn_toxicity.drop_toxic(docs, labels, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that is alike to 0.8 or more in five-word shingles."""
    forget_unused(spark)
    return tensored_minhash.drop_near_duplicates(docs, width=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that an earlier one has."""
    forget_unused(spark)
    return chained_substrings.without_passages(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    forget_unused(spark)
    return weak_pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in token windows."""
    forget_unused(spark)
    import public_tokenizers

    return packing.pack(cut_lineage(packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
