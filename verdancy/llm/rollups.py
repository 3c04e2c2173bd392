"""Token counts as delta-maintained rollups.

Each change to a document is a signed row: an insert counts +1 document and its tokens, a delete counts both back, a
revised count is a delete of the old and an insert of the new. A batch's rows are summed by source, language and
tokenizer version, written aside and committed under the batch's name; totals are the sums over committed batches.
Committing a batch again replaces it by itself, so a commit can be repeated after any failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.packing import _WordIds
from verdancy.llm.salted import with_smallest
from verdancy.llm.storage import frugal, parts, shared_dir, small_batches, stored
from verdancy.sources.commits import Batches

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, tokens of whole texts, and a hash of the text.

    Null and empty texts have no tokens, very long ones are counted whole, repeated rows are counted each; an empty
    table gives an empty result, and extra columns are ignored.
    """

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _WordIds(tokenizer_path)
        for batch in parts(batches):
            tokens = [len(ids) // 4 for ids in encode([x or "" for x in batch.column(4).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(tokens, pa.int64())], ["doc_id", "source", "lang", "text_hash", "tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, lang string, text_hash string, tokens long")


def signed(rows: DataFrame, sign: int, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Rows of documents as changes: docs is the sign, tokens carry it."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.expr(tokens) * sign).cast("long").alias("tokens"))


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version, under a folder.

    Null sources and languages are groups of their own. A batch without rows commits nothing but its name; the totals
    of a rollup without batches are empty. Groups whose documents and tokens are both zero have no row. A commit that
    breaks off at any point leaves the totals as they were.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.batches = Batches(spark, folder, SCHEMA)
        self.spark = spark

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Makes the batch's sums those of its name, in place of any that it has: they are written aside and committed in one step. Any text is a name."""
        if not batch:
            raise ValueError("a batch needs a name")
        self.batches.put(batch, changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))

    def totals(self) -> DataFrame:
        sums = self.batches.read().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def compact(self, into: str) -> None:
        """One batch in a new folder in place of all; the old folder stays until its owner deletes it."""
        Rollup(self.spark, into).commit("compacted", self.totals())


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after three batches: all are inserted; exact copies, all but the smallest doc_id, are deleted; those left are revised to a tokenizer version that counts the end id. The last batch is committed twice."""
    import public_tokenizers

    counted = stored(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
    marked = stored(with_smallest(counted, "text_hash", "doc_id", "first", counted.count()))
    copies, left = marked.where("doc_id <> first"), marked.where("doc_id = first or doc_id is null")
    rollup = Rollup(spark, f"{shared_dir(spark)}/verdancy/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", signed(counted, 1, "word_bpe_49k"))
    rollup.commit("copies", signed(copies, -1, "word_bpe_49k"))
    for _ in range(2):
        rollup.commit("revise", signed(left, -1, "word_bpe_49k").union(signed(left, 1, "word_bpe_49k+end", "tokens + 1")))
    return rollup.totals()
