"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of ten consecutive words. A window's shingles (word pairs) are ordered by how rare they
are in the documents. A document that holds the window holds all its shingles, so the prefix of one, the rarest, is
all that must be joined; the shingle's place in the window fixes where the window would begin (positional bound), the
document's end bounds it (length bound), and the words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdancy.llm.storage import stored

WINDOW = 10
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, parted at all other ASCII than letters and digits. Null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def shingles(ws: Column) -> Column:
    """Hashes of the word pairs that begin at each word but the last; a lone word is hashed by itself."""
    pairs = F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(ws) > 1, F.slice(pairs, 1, F.size(ws) - 1)).otherwise(F.transform(ws, lambda a: F.xxhash64(a)))


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: item_id, window (its words). Items without words have none; shorter ones are one window."""
    ws = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1)))
    return ws.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, width))).alias("window")).distinct()


def _tokens(docs: DataFrame, kind: str) -> DataFrame:
    """doc columns and (at, token) for every place: word pairs, or single words for items of one word."""
    array = shingles(F.col("ws")) if kind == "pair" else F.transform("ws", lambda a: F.xxhash64(a))
    return docs.select("*", F.posexplode(array).alias("at", "token"))


def _hits(docs: DataFrame, prefixes: DataFrame, kind: str, small: bool) -> DataFrame:
    begin = F.col("at") - F.col("place")
    inside = (begin >= 0) & (begin + F.size("window") <= F.size("ws"))
    same = F.slice("ws", begin + 1, F.size("window")) == F.col("window")
    if small:
        found = _tokens(docs, kind).join(F.broadcast(prefixes), "token").where(inside & same)
    else:  # neither side fits into memory: places are joined by token, then verified against their document
        places = _tokens(docs, kind).select("row", "at", "token").join(prefixes, "token")
        found = places.join(docs, "row").where(inside & same)
    return found.select("row", begin.alias("begin"), (begin + F.size("window")).alias("end"), "item_ids")


def _prefixes(docs: DataFrame, windows: DataFrame, kind: str, small: bool) -> DataFrame:
    array = shingles(F.col("window")) if kind == "pair" else F.transform("window", lambda a: F.xxhash64(a))
    placed = windows.select("window", "item_ids", F.posexplode(array).alias("place", "token"))
    asked = placed.select("token").distinct()
    counts = _tokens(docs, kind).select("token").join(F.broadcast(asked) if small else asked, "token").groupBy("token").count()
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "token", "place"))
    return placed.join(counts, "token", "left").withColumn("rank", rank).where("rank = 1 and count > 0").select("window", "item_ids", "place", "token")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of an item's window. Null or empty texts have no words and no hits; items
    without words match nothing; repeated items count once by item_id, items without an id are held against the
    documents and count as the empty id. Repeated rows of a document are judged each. Extra columns are ignored.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = stored(item_windows(items, width).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    # rows are told apart by id and text, so that a lost executor's rows are numbered the same when computed again
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.length("text").alias("l"))
    base = docs.select(row.alias("row"), words(F.col("text")).alias("ws"))
    hits = None
    for kind, of in (("pair", windows.where(F.size("window") > 1)), ("word", windows.where(F.size("window") == 1))):
        if n := of.count():
            small = n * width <= BROADCAST_ROWS
            own = stored(_prefixes(base, of, kind, small))
            found = _hits(base, own, kind, small)
            hits = found if hits is None else hits.union(found)
    counted = base.select("row", F.size("ws").cast("long").alias("n_words"))
    if hits is None:
        found = counted.select("row", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("ids")).limit(0)
    else:
        hits = stored(hits.distinct())
        reached = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.greatest(F.col("end") - F.greatest("begin", F.coalesce("reached", F.lit(0))), F.lit(0))
        spans = hits.select("row", "begin", "end").distinct().withColumn("reached", reached)
        covered = spans.groupBy("row").agg(F.sum(fresh).cast("long").alias("n_hit"))
        ids = hits.select("row", F.explode("item_ids").alias("id")).distinct().groupBy("row").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        found = covered.join(ids, "row")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(found, "row", "left").select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items on windows of ten words."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id::BIGINT AS doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda s: array_to_string(ws[s:s + 9], ' '))) AS words
  FROM items WHERE len(ws) > 0
), places AS (
  SELECT rid, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda s: {'pos': s, 'words': array_to_string(ws[s:s + n - 1], ' ')})) AS place
  FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(ws) >= n
), hits AS (
  SELECT DISTINCT rid, place.pos AS pos, p.n AS n, item_id FROM places p JOIN windows w ON p.n = w.n AND place.words = w.words
), covered AS (
  SELECT rid, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS pos FROM hits) GROUP BY rid
), ids AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN ids USING (rid)
"""
