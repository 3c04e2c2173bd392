"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated by random orthogonal matrices and kept as sign bits, with the factor that makes the inner
product with its bits an unbiased estimate of the cosine. Bands of bits propose blocks of vectors. In a first pass
only short codes meet in the blocks: the estimate and its confidence bound decide which vectors may have a partner
there. Their full vectors alone are joined, and pairs that the bound leaves are computed again in double precision;
only those can link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.components import components
from verdancy.llm.salted import with_smallest
from verdancy.llm.storage import dropped, frugal, stored

MISS = 1e-4
BOUND = 5.0
BLOCK = 1024
CHUNK = 100_000
BROADCAST_KEYS = 500_000
SEED = 7
LEVELS = 8  # of a rotated component on either side of zero, in the short code


def _rotations(dim: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def band_plan(rows: int, dim: int, cosine: float) -> tuple[int, int]:
    """Bits in a band and number of bands: bands as selective as the table is long, so many that a pair at the threshold is missed with probability MISS at most."""
    bits = max(8, min(30, math.ceil(math.log2(max(rows, 2))) - 2))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def _short(rotated: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The first rotation as four bits a component, whose highest is its sign, behind the correction factor and the largest component."""
    top = np.abs(rotated).max(1) * (LEVELS / (LEVELS - 0.5))  # the largest component is the middle of its level
    level = np.clip(np.floor(rotated / top[:, None] * LEVELS), -LEVELS, LEVELS - 1).astype(np.int8) + LEVELS
    level = np.concatenate([level, np.zeros((len(level), level.shape[1] % 2), np.int8)], 1).astype(np.uint8)
    head = np.stack([factor, top], 1).astype("<f4").view(np.uint8)
    return np.concatenate([head, level[:, ::2] << 4 | level[:, 1::2]], 1)


def _read_short(rows: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs (scaled to a unit vector), components, correction factors, and standard deviations of the components' rounding."""
    factor, top = np.ascontiguousarray(rows[:, :8]).view("<f4").astype(float).T
    level = np.stack([rows[:, 8:] >> 4, rows[:, 8:] & 15], 2).reshape(len(rows), -1)[:, :dim].astype(float)
    return np.where(level >= LEVELS, 1.0, -1.0) / math.sqrt(dim), (level - LEVELS + 0.5) * (top[:, None] / LEVELS), factor, top / LEVELS / math.sqrt(12)


def _coded(vectors: DataFrame, dim: int, bits: int, bands: int) -> DataFrame:
    """class, vector, sign bits of the rotated vector, the correction factor of the first rotation's code, and the short code."""
    turns = _rotations(dim, -(-bits * bands // dim))

    @frugal
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            unit = x / np.linalg.norm(x, axis=1)[:, None]
            rotated = np.concatenate([unit @ t for t in turns], 1)
            factor = np.abs(rotated[:, :dim]).sum(1) / math.sqrt(dim)
            packed = [row.tobytes() for row in np.packbits(rotated >= 0, axis=1)]
            short = [row.tobytes() for row in _short(rotated[:, :dim], factor)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(factor), pa.array(short, pa.binary())], ["class", "vector", "copies", "code", "factor", "short"])

    return vectors.mapInArrow(code, "class long, vector array<double>, copies long, code binary, factor double, short binary")


def _keys(codes: np.ndarray, bits: int, bands: int) -> np.ndarray:
    signs = np.unpackbits(codes, axis=1)[:, : bits * bands].reshape(len(codes), bands, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64)) * bands + np.arange(bands)


def _placed(bits: int, bands: int, short: bool):
    """A vector's key in each band, with its id and short code if asked for. The band is the key's remainder by `bands`."""

    @frugal
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_bytes(batch.column("code")), bits, bands)
                if not short:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel())], ["key"])
                    continue
                again = pa.array(np.repeat(np.arange(len(keys)), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("class").take(again), batch.column("short").take(again)], ["key", "class", "short"])

    return place


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _whole_groups(batches: Iterator[pa.RecordBatch], read) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups from batches sorted by (key, lo, hi); the last group of a batch, two blocks at most, waits for the next one."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {k: batch.column(k).to_numpy() for k in ("key", "lo", "hi", "side", "class")} | read(batch)
        if held:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        fresh = np.r_[True, (now["key"][1:] != now["key"][:-1]) | (now["lo"][1:] != now["lo"][:-1]) | (now["hi"][1:] != now["hi"][:-1])]
        cut, group = int(np.flatnonzero(fresh)[-1]), np.cumsum(fresh)
        if cut:
            yield {k: v[:cut] for k, v in now.items()} | {"group": group[:cut]}
        held = {k: v[cut:] for k, v in now.items()}
    if held:
        yield held | {"group": np.zeros(len(held["key"]), np.int64)}


def _asked(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group, or of its two sides where it has two, a bounded number at a time."""
    two = np.zeros(len(rows["group"]), bool)
    two[np.isin(rows["group"], rows["group"][rows["side"] == 1])] = True
    for i, j in _pairs(rows["group"]):
        keep = ~two[i] | (rows["side"][i] != rows["side"][j])
        i, j = i[keep], j[keep]
        for at in range(0, len(i), CHUNK):
            yield i[at : at + CHUNK], j[at : at + CHUNK]


def _slack(factor: np.ndarray, rounding: np.ndarray | float, dim: int, cosine: float) -> np.ndarray:
    """Width of the confidence bound of the estimate at the threshold: BOUND standard deviations of code and rounding."""
    code = (1 - np.minimum(factor, 1) ** 2) / factor**2 / max(dim - 1, 1) * (1 - cosine**2)
    return BOUND * np.sqrt(code + (rounding / factor) ** 2)


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are in one group; rows are sorted by group."""
    at = np.arange(len(group) - 1)
    for step in range(1, len(group)):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        yield at, at + step


def _likely(dim: int, cosine: float):
    """First pass: the members of each block that may have a partner there by the estimates from short codes."""

    @frugal
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, lambda batch: {"short": _bytes(batch.column("short"))}):
            signs, parts, factor, rounding = _read_short(rows["short"], dim)
            partner = np.zeros(len(factor), bool)
            for a, b in _asked(rows):
                near = np.einsum("ij,ij->i", signs[a], parts[b]) / factor[a] >= cosine - _slack(factor[a], rounding[b], dim, cosine)
                partner[a[near]] = partner[b[near]] = True
            names = ("key", "lo", "hi", "side", "class")
            yield pa.RecordBatch.from_arrays([pa.array(rows[k][partner]) for k in names], list(names))

    return likely


def _block_links(dim: int, bits: int, bands: int, cosine: float):
    """Second pass: links in whole groups, each seen only in the first band that both vectors share: partial link counts, and edges that span what is linked here."""
    turn = _rotations(dim, 1)[0]

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = batch.column("vector").flatten().to_numpy().reshape(-1, dim)
        return {"vector": x, "code": _bytes(batch.column("code")), "copies": batch.column("copies").to_numpy(), "factor": batch.column("factor").to_numpy()}

    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        x, code, factor, ids, copies = rows["vector"], rows["code"], rows["factor"], rows["class"], rows["copies"]
        norm = np.linalg.norm(x, axis=1)
        rotated = (x / norm[:, None]) @ turn
        signs = np.where(np.unpackbits(code[:, : -(-dim // 8)], axis=1)[:, :dim], 1.0, -1.0) / math.sqrt(dim)
        slack, keys, found = _slack(factor, 0.0, dim, cosine), _keys(code, bits, bands), []
        for a, b in _asked(rows):
            likely = np.einsum("ij,ij->i", signs[a], rotated[b]) / factor[a] >= cosine - slack[a]
            a, b = a[likely], b[likely]
            near = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
            a, b = a[near], b[near]
            first = (keys[a] == keys[b]).argmax(1) == rows["key"][a] % bands
            found.append((a[first], b[first]))
        a, b = (np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else ((), ())))
        names, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([copies[b], copies[a]]), len(names)).astype(np.int64)
        u, v, root = at[: len(a)], at[len(a) :], np.arange(len(names))
        while len(u):  # smallest label over the links seen here
            low = root.copy()
            np.minimum.at(low, u, root[v])
            np.minimum.at(low, v, root[u])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts), pa.array(names[root], pa.int64())], ["class", "links", "root"])

    @frugal
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(solve, _whole_groups(batches, read))

    return link


def _links_of(vectors: DataFrame, rows: int, dim: int, cosine: float) -> DataFrame:
    """Links among distinct vectors (class, vector, copies) of one length: class, links and root, in parts to be summed and joined."""
    bits, bands = band_plan(rows, dim, cosine)
    coded = stored(_coded(vectors.select("class", "vector", "copies"), dim, bits, bands))
    counts = coded.mapInArrow(_placed(bits, bands, False), "key long").groupBy("key").agg(F.count("*").alias("members"))
    large = stored(counts.where(F.col("members") > BLOCK).select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    slim = coded.select("class", "code", "short").mapInArrow(_placed(bits, bands, True), "key long, class long, short binary")
    placed = slim.join(F.broadcast(large) if large.count() <= BROADCAST_KEYS else large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # a block meets itself and every other block of its bucket: the smaller number is side 0
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "class", "short")
    met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    likely = stored(met.mapInArrow(_likely(dim, cosine), "key long, lo int, hi int, side int, class long"))
    full = likely.join(coded.select("class", "vector", "copies", "code", "factor"), "class")
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = stored(full.mapInArrow(_block_links(dim, bits, bands, cosine), "class long, links long, root long"))
    dropped(coded, large, likely)
    return found


def vector_links(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked where their cosine, in double precision, is `cosine` or more. Equal vectors are one class from
    the start and count for each other. A bucket larger than a block is cut into blocks, and every pair of its blocks
    is one task group, so no group grows with the data. Vectors of each length are compared among themselves, one
    length after another. Vectors that are null, zero, or hold null or non-finite components link with nothing; a
    repeated vec_id counts once with the largest vector; null ids give rows without component. An empty table gives an
    empty result; extra columns are ignored, whatever their names.
    """
    x = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("vector"))
    named = rows.where("vec_id is not null")
    if named.groupBy("vec_id").count().where("count > 1").limit(1).count():
        named = named.groupBy("vec_id").agg(F.max("vector").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = named.where(finite & F.exists("vector", lambda v: v != 0)).select("vec_id", F.transform("vector", lambda v: v + F.lit(0.0)).alias("vector"))
    print_ = F.concat_ws("-", F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), "vector")), F.size("vector"))
    good = stored(good.withColumn("print", print_))
    classes = stored(good.groupBy("print").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies")).select("class", "copies"))
    distinct = stored(good.join(classes, F.col("vec_id") == F.col("class")).select("class", "vector", "copies"))
    ids = rows.select("vec_id").where("vec_id is null").union(named.select("vec_id"))
    found = None
    for dim, n in distinct.groupBy(F.size("vector")).count().where("count > 1").orderBy("size(vector)").collect():
        own = _links_of(distinct.where(F.size("vector") == dim), n, dim, cosine)
        found = own if found is None else found.unionByName(own)
    each = classes
    if found is None:
        each = each.select("class", "copies", F.lit(0).cast("long").alias("links"), F.col("class").alias("component"))
    else:
        joined = components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
        links = found.groupBy("class").agg(F.sum("links").alias("links"))
        each = each.join(links, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    member = with_smallest(good.select("vec_id", "print"), "print", "vec_id", "class", good.count(), each)
    out = member.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    dropped(distinct)
    all_rows = ids.join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return all_rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of embeddings against each other at a cosine of 0.9."""
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS v FROM embeddings
), good AS MATERIALIZED (
  SELECT vec_id, v, len(v) AS n, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.n = y.n AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9
), reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM vectors
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
), smallest AS (
  SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM smallest LEFT JOIN counted USING (vec_id)
"""
