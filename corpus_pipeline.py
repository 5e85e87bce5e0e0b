"""From raw documents to packed training sequences, in five stages. Each stage's result
is written and read again before the next one works on all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiweave.llm.common import discard_since, let_go, mark, table
from chiweave.llm.mixing import mix
from chiweave.llm.near_duplicates import one_of_each
from chiweave.llm.packing import pack
from chiweave.llm.quality import keep_good
from chiweave.llm.queries import BPE
from chiweave.llm.toxicity import toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return keep_good(docs, _labels(spark, sf_dir))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]  # each text travels once
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest or ["doc_id"])).alias("row"))
    kept = toxicity(rows, _labels(spark, sf_dir)).filter("predicted = 0")
    return kept.select(*(F.col("row")[c].alias(c) if c in rest else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, or not at all."""
    rows = mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row")))
    return rows.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in sequences of at most 2048 tokens."""
    return pack(docs, BPE)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixing), ("best-fit packing", packing)]

#: No SQL can express the learned and iterative stages; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Nulls, empty and very long texts, repeated rows and
    further columns are handled as each stage's operator says; stages before the last carry
    every column along; an empty table gives no row. What a stage wrote on its way is
    deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = table(docs, "stage-" + name.replace(" ", "-"))
            discard_since(spark, before, path)
            let_go(spark)
    return docs
