"""The corpus pipeline: STAGES, each over all that its predecessor kept, and run()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsluice.llm import mixing, overlap, quality, simhash, tokens, winnowing
from docsluice.llm.base import read, save


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels of these documents; what goes is
    below the quantile that cuts off the share that the scores expect to be bad."""
    return quality.keep_by_quantile(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a Jaccard similarity of 0.8 or more, exactly: BK-trees propose, prefix filtering completes. Rows count
    for themselves: of equal ids with different texts one may go; rows without an id come last; texts without words are alike."""
    return simhash.keep_one(docs, find=overlap.groups)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item; null and empty texts stay, an empty benchmark removes nothing."""
    return winnowing.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probability of their cell; repeated rows are drawn together, rows without an id by their text."""
    return mixing.sample(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of ids, read back; null and empty texts have the end id only, rows without an id come first."""
    return tokens.write_and_read(docs, remember=False)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing to target weights", sample_to_targets),
    ("token binary output", write_token_files),
]

#: The tokenizer, the fingerprints' hash and the trained classifier have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{k}")
    return docs
