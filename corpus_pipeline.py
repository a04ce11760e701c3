"""The corpus pipeline: quality rules, toxicity, SimHash near-dedup, mixing sources to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as a Parquet table in the shared folder and
reads again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storepulse.llm import mixing, packing, quality, simhash, toxicity
from storepulse.llm.queries import tokenizer_path
from storepulse.plans.lineage import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; n_chars is counted anew.

    Boilerplate is learnt from all docs. Null, empty and very short texts go; repeated rows are judged each; an empty table gives none."""
    return quality.clean_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model of the labelled documents among docs.

    Rows without label or id are judged too. Without labels of both classes nothing is predicted toxic. Null and empty texts and
    repeated rows stay; an empty table gives none."""
    return toxicity.clean_documents(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id: five-word shingles, similarity 0.8 or more.

    Of rows with equal ids one stays, by the rule of simhash.one_of_each; rows without id and texts without words stay; an empty table gives none."""
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as that many rows.

    Null is a source, the last one. Documents without words have size 0 and are taken by the rate of their source; an empty table gives none."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences of 4096 tokens, one row a piece. Every copy of a document is packed; an empty table gives none."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: Tokenizers and similarity of texts are beyond SQL; tests/llm compares run() with plain versions of the stages.
ORACLE_SQL = None
