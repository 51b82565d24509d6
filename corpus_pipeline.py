"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, packing.

Each stage works on all rows that its predecessor kept and returns the columns of documents,
all but the last, which returns the packed pieces. A stage's result is written as Parquet and
read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftspan.llm import decontam, exact_dedup, near_dedup, packing, toxicity
from driftspan.llm.common import Scratch, read_table, settle


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels of this corpus, scores 0.5 or more go.

    Null and empty texts have no window, score 0 and stay; repeated rows are scored alike; without
    toxic labels nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_contract(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case the document with the largest id stays.

    Null texts are empty, so one null or empty text stays; a null id is the smallest; of rows that
    repeat an id and a text one stays, of rows that repeat an id with different texts each is judged
    by its own text.
    """
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8) the one with the smallest id stays.

    Texts without words are linked with nothing and stay; a null id stays only where no row with
    an id has an equal set; of repeated rows one stays.
    """
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go: with hit words that make a twentieth of all or more.

    Texts without words stay; repeated rows are judged alike; an empty benchmark drops nothing.
    """
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences; null and empty texts are the end id alone, repeated rows are packed each for itself."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the network nor the tokeniser; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of documents; an empty table gives an empty result."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
            settle(spark)
    return docs
