"""The registered queries of the text operators: each applies its operator, with production
parameters, to its whole table and returns the full result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (brown, chat, decontaminate, hosts, kmtree, linechunks, negatives, pieces, repair, simhash, tokens, toxicity,
               warc)
from .common import read, shared_path


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file: in the folder PANELFX_TOKENIZERS names, or
    where the installed package of them keeps it."""
    folder = os.environ.get("PANELFX_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


# What the conversations' own turns are checked against: a question of at most 400 characters.
ASK = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {
    "prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0, "maximum": 6},
    "n_chars": {"type": "integer", "minimum": 1}}}


def op1_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn is a call of the tool `ask`; every assistant turn is the result of the
    turn before it. The number of a prompt's characters says what its call needs: a multiple
    of four the call two turns later, one over nothing, two over the call two turns earlier,
    three over the calls four and two turns earlier. So some needs point forward, and some
    close a cycle."""
    t = read(spark, sf, "conversations")
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    rest = F.length("text") % 4
    needs = F.when(rest == 0, F.array(F.col("turn") + 2)).when(rest == 2, F.array(F.col("turn") - 2)) \
        .when(rest == 3, F.array(F.col("turn") - 4, F.col("turn") - 2)).otherwise(F.array().cast("array<bigint>"))
    calls = t.filter("role = 'user'").select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), ident(F.col("turn")).alias("call_id"), F.lit("ask").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"), F.length("text").cast("long").alias("n_chars")))
        .alias("arguments"),
        F.transform(F.filter(needs, lambda turn: turn >= 0), ident).alias("needs"))
    results = t.filter("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    out = chat.tool_calls(calls, results, {"ask": ASK})
    return out.select(F.col("conv").alias("conv_id"), "call_id", F.col("pos").alias("turn"), "result_pos", "n_calls", "n_results", "status", "layer", "cyclic",
                      "valid", "errors", "json")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.report(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode(read(spark, sf, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(read(spark, sf, "pages"), shared_path(spark, "warc"))


def op8_brown(spark: SparkSession, sf: str) -> DataFrame:
    return brown.report(read(spark, sf, "documents"))


def op9_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The grown rule, as the pipeline's stage applies it."""
    return linechunks.report(read(spark, sf, "documents"), grow=True)


def op10_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return hosts.host_rules(read(spark, sf, "documents")).select("doc_id", *hosts.SIGNALS, "base_failed", "kept")


def op11_kmeans_tree(spark: SparkSession, sf: str) -> DataFrame:
    return kmtree.search(read(spark, sf, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """The label of every seventh row is moved on by one first."""
    rows = read(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.hard_negatives(rows.withColumn("label", moved))


def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations damaged by a rule of their ids and turns, then repaired."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.segments(repair.damage(turns))).drop("path")


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_toxicity, op3_token_counts, op4_pieces, op5_simhash, op6_decontaminate,
                                   op7_warc, op8_brown, op9_line_chunks, op10_host_rules, op11_kmeans_tree,
                                   op12_hard_negatives, op13_repair)}
