"""Near-duplicate documents by min-max hashing.

Each hash function gives two signature values, the smallest and the largest hash of a document's shingle set, so
half as many hash evaluations yield the same number of values. Bands of values propose pairs; every link is confirmed
on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.components import components
from verdancy.llm.salted import with_smallest
from verdancy.llm.storage import dropped, frugal, parts, small_batches, stored

BANDS = 48
PERMUTATIONS_PER_BAND = 3
BLOCK = 256
BROADCAST_IDS = 1_000_000
_CACHE_WORDS = 200_000
_CHUNK = 1 << 15
_COLUMNS = 8192


def _hash_functions(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, (n, 2), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Shingles:
    """Sorted distinct 64-bit shingle hashes of texts: words by ASCII white space, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        new = {w: xxhash.xxh3_64_intdigest(w) for w in set(words).difference(known)}
        if len(known) < _CACHE_WORDS:
            known.update(new)
            new = {}
        ids = (new[w] if w in new else known[w] for w in words) if new else map(known.__getitem__, words)
        h = np.fromiter(ids, np.uint64, len(words))
        k = min(self.width, len(h))
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(total)


def signatures(docs: DataFrame, width: int, text: str = "text", bands: int = BANDS) -> DataFrame:
    """Per document: n_shingles, a 128-bit fingerprint of its set, and its band keys."""
    per, functions = PERMUTATIONS_PER_BAND, _hash_functions(bands * PERMUTATIONS_PER_BAND)

    @frugal
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(width)
        for batch in parts(batches):
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            prints = [_print(s) for s in sets]
            full = np.flatnonzero(sizes)
            low = np.zeros((len(sets), len(functions)), np.uint64)
            high = low.copy()
            at = 0
            while at < len(full):
                upto, n = at, 0
                while upto < len(full) and (n == 0 or n + sizes[full[upto]] <= _CHUNK):
                    n += sizes[full[upto]]
                    upto += 1
                own = full[at:upto]
                flat, starts = np.concatenate([sets[i] for i in own]), np.r_[0, np.cumsum(sizes[own])[:-1]]
                for j, (a, b) in enumerate(functions):
                    h = flat * a + b
                    low[own, j] = np.minimum.reduceat(h, starts)
                    high[own, j] = np.maximum.reduceat(h, starts)
                at = upto
            values = np.concatenate([low.reshape(-1, bands, per), high.reshape(-1, bands, per)], 2)
            keys = np.repeat(np.arange(bands, dtype=np.uint64)[None], len(sets), 0)
            for j in range(values.shape[2]):
                keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, j])
            keys = keys.view(np.int64)
            keys_list = pa.ListArray.from_arrays(np.arange(0, (len(full) + 1) * bands, bands, dtype=np.int32), pa.array(keys[full].ravel()))
            place = np.full(len(sets), -1)
            place[full] = np.arange(len(full))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(prints, pa.binary()), keys_list.take(pa.array(place, mask=place < 0))],
                ["doc_id", "n_shingles", "print", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(sign, "doc_id long, n_shingles long, print binary, keys array<long>")


def _print(shingles: np.ndarray) -> bytes | None:
    """Fingerprint of a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _sets_of(wanted: DataFrame, docs: DataFrame, width: int, text: str) -> DataFrame:
    """doc_id and shingle set of the documents named in wanted (doc_id, print), which is broadcast only up to BROADCAST_IDS rows. Of a repeated doc_id's texts, that with the wanted print counts."""

    @frugal
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(width)
        for batch in parts(batches):
            ids, sets = [], []
            for doc, x, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(x)
                if _print(own) == asked:
                    ids.append(doc)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "set"])

    wanted = stored(wanted.distinct())
    small = wanted.count() <= BROADCAST_IDS
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).where("doc_id is not null")
    picked = picked.join(F.broadcast(wanted) if small else wanted, "doc_id").select("doc_id", text, "print")
    sets = picked.mapInArrow(make, "doc_id long, set array<long>")
    return sets.groupBy("doc_id").agg(F.first("set").alias("set"))  # rows of one doc_id and print have one set


def _confirmed(pairs: DataFrame, prints: DataFrame, docs: DataFrame, width: int, text: str, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough; only documents of some pair have their sets built again. prints: class and print."""
    pairs = stored(pairs.distinct())
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    sets = stored(_sets_of(prints.join(ends, "class", "left_semi").select(F.col("class").alias("doc_id"), "print"), docs, width, text))
    of = lambda k: sets.select(F.col("doc_id").alias(k), F.col("set").alias(f"set_{k}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    kept = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both))
    links = stored(kept.select("a", "b"))
    dropped(pairs, sets)
    return links


def _linked_in_block(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between members of different components in one pair of blocks (or in one block, where all are on side 0): each node with the smallest id it reaches here."""
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1) if sides.any() else left
    sizes = np.array([len(x) for x in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = df[token] > 1
    names, token = np.unique(token[often], return_inverse=True)
    row, both = row[often], np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    for at in range(0, len(names), _COLUMNS):
        lo, hi = np.searchsorted(token, (at, at + _COLUMNS))
        has = np.zeros((len(sets), min(_COLUMNS, len(names) - at)), np.float32)
        has[row[lo:hi], token[lo:hi] - at] = 1
        both += has[left] @ has[right].T
    linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None] - both)
    i, j = np.nonzero(linked & (comps[left][:, None] != comps[right][None]))
    a, b, root = left[i], right[j], np.argsort(np.argsort(ids))
    first = root.copy()
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        if (low == root).all():
            break
        root = low
    moved = root != first
    return ids[moved], np.sort(ids)[root[moved]]


def _block_edges(percent: int):
    @frugal
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush() -> pa.RecordBatch:
            ids, comps, sides = (np.array(x) for x in zip(*(h[:3] for h in held), strict=True))
            a, b = _linked_in_block(ids, comps, sides, [h[3] for h in held], percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            names, ids, comps, sides = (batch.column(i).to_pylist() for i in range(4))
            column = batch.column(4)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for i, name in enumerate(names):
                if name != key:
                    if held:
                        yield flush()
                    held, key = [], name
                held.append((ids[i], comps[i], sides[i], flat[offsets[i] : offsets[i + 1]].copy()))
        if held:
            yield flush()

    return edges


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of percent/100 or more are linked; component_id is the
    smallest doc_id reachable over links, kept marks its bearer. Equal sets are one class from the start, so copies are
    never expanded into pairs. Each class is first held against its home, the most central class it shares a bucket
    with. In buckets that still hold several components, classes are put into blocks by home and component, and pairs
    of blocks that meet in such a bucket are compared on full sets, so that pairs of documents are never rows. A link
    whose documents share a bucket is therefore never lost; a pair at the threshold misses all 48 buckets with
    probability (1 - 0.8 ** 6) ** 48 < 1e-6.

    A null or empty text has no shingles and is linked with nothing. A repeated doc_id counts as one document with that
    of its texts which has most distinct shingles (of several, the one whose set has the largest fingerprint). A null doc_id gives a row with null component_id that isn't kept. Very long texts are
    read whole. An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(named, width, bands=bands))
    # a repeated doc_id is its text with most shingles; its print is the choice that every later step follows
    one = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.max_by("keys", F.struct("n_shingles", "print")).alias("keys"), F.max(F.struct("n_shingles", "print")).alias("s"))
    classes = stored(one.groupBy("s.print").agg(F.min("doc_id").alias("class"), F.first("keys").alias("keys")).select("class", "print", "keys"))
    prints = classes.select("class", "print")
    slim = classes.select("class", F.explode("keys").alias("key"))
    counts = slim.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(slim.join(counts, "key"))
    central = shared.groupBy("class").agg(F.sum("members").alias("weight"))
    weighed = shared.select("key", "class").join(central, "class")
    best = F.struct(F.col("weight"), (-F.col("class")).alias("turned"))
    centre = weighed.groupBy("key").agg(F.max(best).alias("centre"))
    homes = stored(shared.select("key", "class").join(centre, "key").groupBy("class").agg((-F.max("centre")["turned"]).alias("home")))
    first = homes.where("class <> home").select(F.least("class", "home").alias("a"), F.greatest("class", "home").alias("b"))
    links = _confirmed(first, prints, named, width, "text", percent)
    labels = components(links)

    # buckets that still hold several components
    placed = homes.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").select("class", "home", F.coalesce("component", "class").alias("comp"))
    big = placed.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK)
    pure = placed.join(big.select("comp"), "comp", "left_semi").withColumn("pure", F.col("comp"))
    rest = placed.join(big.select("comp"), "comp", "left_anti").withColumn("pure", F.lit(None).cast("long"))
    pool = pure.unionByName(rest)
    amounts = pool.groupBy("home", "pure").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    same = (F.col("p.home") == F.col("q.home")) & F.col("p.pure").eqNullSafe(F.col("q.pure"))
    pool = pool.alias("p").join(amounts.alias("q"), same).select("p.class", "p.comp", "p.home", "p.pure", F.struct("p.home", "p.pure", F.pmod(F.xxhash64("p.class"), F.col("q.blocks")).alias("nth")).alias("block"))
    pool = stored(pool.select("class", "comp", "pure", "block"))
    info = shared.select("key", "class").join(pool, "class")
    several = info.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = info.join(several, "key")
    met = stored(mixed.select("key", "block", "pure").distinct())
    x, y = met.alias("x"), met.alias("y")
    apart = F.col("x.pure").isNull() | F.col("y.pure").isNull() | (F.col("x.pure") != F.col("y.pure"))
    pairs = stored(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & apart).select(F.col("x.block").alias("lo"), F.col("y.block").alias("hi")).distinct())
    ends = pairs.select("lo", "hi", F.col("lo").alias("block"), F.lit(0).alias("side")).union(pairs.where("lo <> hi").select("lo", "hi", F.col("hi"), F.lit(1)))
    taking = pool.join(ends.select("block").distinct(), "block", "left_semi").select("class", "comp", "block")
    sets = stored(_sets_of(taking.join(prints, "class").select(F.col("class").alias("doc_id"), "print"), named, width, "text"))
    members = ends.join(taking, "block").join(sets.withColumnRenamed("doc_id", "class"), "class")
    tasks = members.select(F.to_json(F.struct("lo", "hi")).alias("task"), "class", "comp", "side", "set").repartition("task").sortWithinPartitions("task")
    links2 = stored(tasks.mapInArrow(_block_edges(percent), "a long, b long"))
    merged = components(links.union(links2))
    dropped(shared, homes, pool, met, pairs, sets)

    sized = stored(signed.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "print")).alias("s")).select("doc_id", "s.*"))
    roots = with_smallest(sized, "print", "doc_id", "class", sized.count(), merged.withColumnRenamed("node", "class"))
    named_rows = roots.select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))
    rows = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return named_rows.unionByName(rows).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents on 2-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id::BIGINT AS doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS shingles FROM words
), parts AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common, any_value(x.n + y.n) AS total
  FROM parts x JOIN parts y ON x.shingle = y.shingle AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 80 * (total - common)
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT l.b, r.root FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.doc_id
), smallest AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN smallest USING (doc_id)
"""
