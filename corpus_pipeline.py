"""A corpus from raw documents to tokens, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.llm import bpe, decontaminate, lines, nearcopies, queries, toxicity
from seamline.shared import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits in which fingerprints that the BK-trees name as candidates may differ; MinHash bands name the candidates beyond, and shingle sets decide.
RADIUS = 7
#: Ids to drop up to this many are sent to every task, and the texts stay where they are; beyond it they are joined.
BROADCAST_IDS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the network does not reject; it learns from the labelled documents of its input outside the held-out third."""
    net = toxicity.fit(docs, queries.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.with_score(docs.select(COLUMNS), net, predicted="rejected").where("rejected = 0").select(COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its source's boilerplate lines taken out of the text; n_chars follows the text."""
    done = lines.drop_boilerplate(docs.select(COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word Jaccard of 0.8 or more, verified) the document with the least id; of repeated rows of an id and text, one.

    A document without an id stays unless all documents without one have copies with an id.
    """
    found = stage(nearcopies.near_copies(docs, radius=RADIUS), "near-copies")
    ids = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = stage(ids.where(~F.col("stays")).select("doc_id"), "copies-to-drop")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.select(COLUMNS).alias("d").join((F.broadcast(gone) if few else gone).alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")
    return kept if ids.where("n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item's window."""
    found = decontaminate.contamination(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("items") == 0).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's tokens and of their decoded text."""
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("BPE encoding and decoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs


#: The network's decisions are no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
