"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination,
SentencePiece encoding. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it
works on all its predecessor kept. All stages but the last return the columns of documents.

SQL cannot express the Viterbi segmentation or the nearest examples, so ORACLE_SQL is None;
tests hold every stage, and the whole, against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelfx.llm import common, decontaminate, linechunks, pieces, simhash, toxicity
from panelfx.llm.queries import vocabulary

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.reject(docs, common.read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line chunks found before go from the texts; documents with no word left go."""
    return linechunks.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.remove(docs, common.read(spark, sf_dir, "benchmark"), "documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the text, their number, score, and round trip."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
