"""The corpus pipeline: STAGES in order, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, decontaminate, near_dedup, repeats, toxicity
from logloom.tables import drop_materialized, free, materialize, scratch, table

#: Bytes of a repeated passage at least; a passage of over 50 words is longer unless most of them have under three letters.
PASSAGE_BYTES = 200
VOCABULARY = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; all, if no document is labelled. Null texts count as empty, repeated rows are judged alike."""
    (score,) = free(docs.columns, "score")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, net, score=score).where(F.col(score) < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id; rows without an id and texts without words stay.

    Rows that share an id are compared like any others: one of those with equal
    texts stays, and others go only if they are near-duplicates. For that, all but
    the least of the texts of an id get numbers above all ids.
    """
    node, body, other, least = free(docs.columns, "_node", "_body", "_other", "_least")
    shared = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if shared.isEmpty():
        rows, groups = docs.withColumn(node, F.col("doc_id").cast("long")), _groups(docs.select("doc_id", "text"))
        return rows.join(groups.where("node <> least").select(F.col("node").alias(node)).distinct(), node, "left_anti").select(docs.columns)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias(body)).join(shared, "doc_id", "left_semi").distinct()
    first = texts.groupBy("doc_id").agg(F.min(body).alias(least))
    top = docs.agg(F.max("doc_id")).first()[0]
    others = materialize(texts.join(first, "doc_id").where(F.col(body) != F.col(least)).select("doc_id", body, (F.lit(top) + 1 + F.monotonically_increasing_id()).alias(other)))
    rows = docs.withColumn(body, F.coalesce("text", F.lit(""))).join(others, ["doc_id", body], "left").withColumn(node, F.coalesce(other, "doc_id"))
    rows = materialize(rows.select(*docs.columns, node))
    groups = _groups(rows.select(F.col(node).alias("doc_id"), "text"))
    ids = others.select(F.col(other).alias("node"), F.col("doc_id").alias("id"))
    by_id = F.min(F.struct(F.coalesce("id", "node").alias("id"), "node"))
    kept = groups.where("node IS NOT NULL").join(ids, "node", "left").groupBy("least").agg(by_id["node"].alias("kept"))
    dropped = groups.join(kept, "least").where("node <> kept").select(F.col("node").alias(node)).distinct()
    rows = rows.join(dropped, node, "left_anti")
    again = rows.join(shared, "doc_id", "left_semi").dropDuplicates([node])
    return rows.join(shared, "doc_id", "left_anti").unionByName(again).select(docs.columns)


def _groups(texts: DataFrame) -> DataFrame:
    """(node, least): each document with the least of its group."""
    found = near_dedup.near_duplicates(texts, threshold=0.8, k=5)
    return found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("least"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages; the first copy stays, and so does every row. Null texts become empty."""
    kept, *more = free(docs.columns, "kept", "n_removed", "n_spans")
    out = repeats.remove_repeats(docs, length=PASSAGE_BYTES, keep_first=True, aligned=True, names=(kept, *more))
    out = out.withColumn("text", F.col(kept).cast("string"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and a digest of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages learn a model, compare signatures and tokenize; SQL can't express that, so a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written before the next one reads them, and what it wrote besides is deleted."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            after = keep(stage(spark, docs, sf_dir))
        if i:
            drop_materialized(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
