"""A corpus pipeline over documents: quality, toxicity, near-duplicates, benchmark decontamination, packing.

Each stage judges all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.decontamination import contamination
from verdancy.llm.minhash import near_duplicates
from verdancy.llm.packing import pack_documents
from verdancy.llm.quality import quality
from verdancy.llm.storage import stored
from verdancy.llm.toxicity import toxicity

BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs whose doc_id isn't rejected; the ids are broadcast only up to a checked number."""
    rejected = stored(rejected.select(F.col("doc_id").alias("rejected_id")).where("rejected_id is not null").distinct())
    small = rejected.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rejected) if small else rejected, docs["doc_id"] == rejected["rejected_id"], "left_anti")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's quantiles. A null or empty text can't be judged and stays; a doc_id goes with all its rows if one of them is rejected; rows without a doc_id stay."""
    return _without(docs, quality(docs, _labels(spark, sf_dir)).where("not kept"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Null and empty texts stay; a doc_id goes with all its rows if one of them is toxic; rows without a doc_id stay."""
    return _without(docs, toxicity(docs, _labels(spark, sf_dir)).where("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles, that of the smallest doc_id.

    Repeated rows of a doc_id become one before they are judged, that of the longest text (at a tie the last in order).
    Null and empty texts have no duplicates; rows without a doc_id stay. An empty table gives an empty result.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        longest = F.max_by(F.struct(*docs.columns), F.struct(F.length("text"), "text"))
        docs = stored(named.groupBy("doc_id").agg(longest.alias("row")).select("row.*").unionByName(docs.where("doc_id is null")))
    return _without(docs, near_duplicates(docs).where("not kept and doc_id is not null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs. Null and empty texts have none and stay; a doc_id goes with all its rows if one of them is hit; rows without a doc_id stay; without items nothing goes."""
    return _without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences of 4096 tokens: every row, also those that repeat or have no doc_id; a null or empty text is its end id alone. An empty table gives an empty result."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Perplexity, toxicity, hashing and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
