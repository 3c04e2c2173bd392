"""Quality classifier: an interpolated modified Kneser-Ney word model of trusted text, and language-specific quantiles.

The model learns from all trusted documents but those that set the quantiles. Counts, continuation counts, context
totals and lower-order probabilities of a small one are tables joined by n-gram and by context; it is broadcast, and each
document is scored where it is read. Else trigrams are dealt to shards by their middle word, which all orders of a
trigram's counts have in common: trusted and judged ones meet there after one shuffle, and of the model only the
commonest words travel. The shards are worked off in rounds, so that few of the trigrams are on disk at a time.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdancy.llm.storage import dropped, frugal, parts, small_batches, stored, tidily_stored

TRUSTED_PER_LANGUAGE = 300  # bound of a trusted sample: documents of each language
SAMPLED_TENTHS = 6  # the model learns from these trusted documents, the others set the quantiles
TRUSTED_CHARS = 30_000  # longer trusted documents are not in the sample
LANGUAGES = 100  # languages with a share of their own in the sample; the others share one
MODEL_CHARS = 30_000_000  # of the sample's texts over all languages together, an equal share for each
BROADCAST_TRIGRAMS = 500_000  # a model of texts with more is met in shards instead of broadcast, with the same results
BROADCAST_WORDS = 1_000_000  # words of it that travel; others are met in shards and joined
SHARD_WORDS = 2_000_000  # of the texts it learns from, on average
SHARDS = 12  # in a round, at least
ROUNDS = 3
FILTER_BITS = 1 << 28  # of the filter of rarer words, at most
MOST_TRIGRAMS = MODEL_CHARS // 2  # a word takes two characters at least; the driver gathers no more
WORD_TYPES = 1e6  # the uniform distribution below the unigrams
MEMORISED = 0.15  # above this share of known trigrams, and three times the usual share, a document copies trusted text in part
LOW, HIGH = 0.003, 0.995  # quantiles of trusted documents between which a document is kept
BROADCAST_LANGUAGES = 50_000
LEAST_TRUSTED = 50  # a language with fewer judged trusted documents takes the quantiles of all
START, UNKNOWN = -1, -2
_SPACE = r"[\x20\x09-\x0D]+"  # words are parted here, in training and in scoring
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LANES = 64  # bytes of a word that is hashed along with others
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of a lane
_CACHE_WORDS = 100_000
_GRAMS = 500_000  # trigrams that a worker holds before they leave it
_MIX = 0x1E3779B97F4A7C15
_RARE, _RARE_BITS = 1 << 62, (1 << 62) - 1
_SUMS = ["n", "times", "lp", "p", "pp", "seen"]
_PACKED = ["place", "shard", "kind", "of", "n", "times", "u", "v", "w"]


def _steps(found: dict[int, int]) -> list[float]:
    """The modified discounts D1, D2, D3+ from the numbers of n-grams that occur 1, 2, 3 and 4 times, kept rising and within what a count can give."""
    n = [max(1, found.get(k, 0)) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0]]
    d.append(min(max(d[0], 2 - 3 * y * n[2] / n[1]), 1.9))
    d.append(min(max(d[1], 3 - 4 * y * n[3] / n[2]), 2.9))
    return d


def _discount(counts: DataFrame, name: str) -> tuple[Column, list[float]]:
    """The modified discounts of a count column."""
    d = _steps({r["c"]: r["n"] for r in counts.groupBy(F.least(F.col(name), F.lit(5)).alias("c")).agg(F.count("*").alias("n")).collect()})
    c = F.col(name)
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]), d


def tables(texts: DataFrame) -> dict:
    """The model of a table of any number of texts (column text), as stored tables of hashed words: triples (u, v, w, p3), pairs (v, w, p2, g3) and words (w, p1, g2) with log-probabilities and back-off weights, the log of the floor below them, and n, the number of triples."""
    ws = F.filter(F.split("text", _SPACE), lambda w: w != "")
    hashed = F.concat(F.array(F.lit(START).cast("long"), F.lit(START).cast("long")), F.transform(ws, lambda w: F.xxhash64(w)))
    rows = texts.select(hashed.alias("h")).where(F.size("h") > 2)
    three = F.transform(F.sequence(F.lit(1), F.size("h") - 2), lambda i: F.struct(F.element_at("h", i).alias("u"), F.element_at("h", i + 1).alias("v"), F.element_at("h", i + 2).alias("w")))
    c3 = stored(rows.select(F.explode(three).alias("g")).groupBy("g.u", "g.v", "g.w").agg(F.count("*").alias("c")))
    c2 = stored(c3.groupBy("v", "w").agg(F.count("*").alias("c")))
    c1 = stored(c2.groupBy("w").agg(F.count("*").alias("c")))
    (d3, _), (d2, _), (d1, _) = (_discount(c, "c") for c in (c3, c2, c1))
    total = c1.agg(F.sum("c").alias("t"), F.sum(d1).alias("g")).first()
    if not total["t"]:
        return {"floor": -math.log(WORD_TYPES), "n": 0}
    floor = total["g"] / total["t"] / WORD_TYPES
    p1 = c1.select("w", ((F.col("c") - d1) / F.lit(total["t"]) + F.lit(floor)).alias("p1"))
    at2 = c2.groupBy("v").agg(F.sum("c").alias("t"), (F.sum(d2) / F.sum("c")).alias("g2"))
    p2 = c2.join(at2, "v").join(p1, "w").select("v", "w", ((F.col("c") - d2) / F.col("t") + F.col("g2") * F.col("p1")).alias("p2"))
    at3 = c3.groupBy("u", "v").agg(F.sum("c").alias("t"), (F.sum(d3) / F.sum("c")).alias("g3"))
    p3 = c3.join(at3, ["u", "v"]).join(p2, ["v", "w"]).select("u", "v", "w", F.log((F.col("c") - d3) / F.col("t") + F.col("g3") * F.col("p2")).cast("float").alias("p3"))
    words = p1.join(at2.select(F.col("v").alias("w"), "g2"), "w", "full").select("w", F.log(F.coalesce("p1", F.lit(floor))).cast("float").alias("p1"), F.log(F.coalesce("g2", F.lit(1.0))).cast("float").alias("g2"))
    pairs = p2.join(at3.select(F.col("u").alias("v"), F.col("v").alias("w"), "g3"), ["v", "w"], "full")
    pairs = pairs.select("v", "w", F.log("p2").cast("float").alias("p2"), F.log(F.coalesce("g3", F.lit(1.0))).cast("float").alias("g3"))
    found = {"triples": stored(p3), "pairs": stored(pairs), "words": stored(words), "floor": math.log(floor), "n": c3.count()}
    dropped(c3, c2, c1)
    return found


def train(texts: DataFrame) -> dict[str, np.ndarray]:
    """The model of a bounded table of texts (column text) of MOST_TRIGRAMS different trigrams at most, gathered: sorted keys of uni-, bi- and trigrams with log-probabilities and back-off weights."""
    return gathered(tables(texts))


def gathered(model: dict) -> dict[str, np.ndarray]:
    """The tables of a model of MOST_TRIGRAMS different trigrams at most as sorted arrays."""
    if model["n"] > MOST_TRIGRAMS:
        raise ValueError(f"{model['n']} trigrams are more than a model may have: {MOST_TRIGRAMS}")
    floor = np.array([model["floor"]])
    if not model["n"]:
        return {"floor": floor}
    vocabulary, w1, w2 = _columns(model["words"].sort("w"))
    n = len(vocabulary) + 1
    v, w, p, g = _columns(model["pairs"].withColumn("p2", F.coalesce("p2", F.lit(float("nan")).cast("float"))))
    pair_key = np.searchsorted(vocabulary, v) * n + np.searchsorted(vocabulary, w)
    order = np.argsort(pair_key)
    found = {"vocabulary": vocabulary, "p1": w1, "g2": w2, "pairs": pair_key[order], "p2": p[order], "g3": g[order], "floor": floor}
    u, v, w, p = _columns(model["triples"])
    first = np.searchsorted(vocabulary, u) * n + np.searchsorted(vocabulary, v)
    triple_key = np.searchsorted(found["pairs"], first) * n + np.searchsorted(vocabulary, w)
    order = np.argsort(triple_key)
    return found | {"triples": triple_key[order], "p3": p[order]}


def _columns(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


class _Scorer:
    def __init__(self, model: dict[str, np.ndarray]):
        self.m = model
        self.ids: dict[str, int] = {}
        if "vocabulary" in model:
            self.n = len(model["vocabulary"]) + 1
            self.start = int(np.searchsorted(model["vocabulary"], START))

    def _find(self, words: set[str]) -> dict[str, int]:
        new = list(words.difference(self.ids))
        vocabulary = self.m["vocabulary"]
        h = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in new], np.uint64).view(np.int64)
        at = np.searchsorted(vocabulary, h)
        hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h
        return dict(zip(new, np.where(hit, at, len(vocabulary)).tolist(), strict=True))

    def __call__(self, text: str) -> tuple[int, float, float, float, float]:
        """Words, mean negative log-probability of a word, its mean and variance over the document's distinct trigrams, and the share of these that the model has seen."""
        words = _WORD.findall(text)
        if not words:
            return 0, 0.0, 0.0, 0.0, 0.0
        m = self.m
        if "vocabulary" not in m:
            return len(words), -float(m["floor"][0]), -float(m["floor"][0]), 0.0, 0.0
        new = self._find(set(words))
        if len(self.ids) < _CACHE_WORDS:
            self.ids.update(new)
            ids = self.ids
        else:
            ids = {w: new[w] if w in new else self.ids[w] for w in set(words)}
        x = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        raw = np.fromiter(map(hash, words), np.int64, len(words))
        x, raw = np.r_[self.start, self.start, x], np.r_[1, 2, raw]
        types = (raw[:-2] * 31 + raw[1:-1]) * 1000003 + raw[2:]
        _, at, times = np.unique(types, return_index=True, return_counts=True)
        u, v, w = x[:-2][at], x[1:-1][at], x[2:][at]
        out = self.n - 1
        p = np.where(w < out, m["p1"][np.minimum(w, out - 1)], m["floor"][0]) + np.where(v < out, m["g2"][np.minimum(v, out - 1)], 0)
        i, ok = self._at(m["pairs"], v * self.n + w, (v < out) & (w < out))
        p = np.where(ok & ~np.isnan(m["p2"][i]), m["p2"][i], p)
        c, context = self._at(m["pairs"], u * self.n + v, (u < out) & (v < out))
        p = p + np.where(context, m["g3"][c], 0)
        k, seen = self._at(m["triples"], c * self.n + w, context & (w < out))
        p = np.where(seen, m["p3"][k], p)
        return len(words), -float(p @ times) / len(words), -float(p.mean()), float(p.var()), float(seen.mean())

    @staticmethod
    def _at(keys: np.ndarray, asked: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(asked), np.int64)
        at[ask] = np.minimum(np.searchsorted(keys, asked[ask]), len(keys) - 1)
        return at, ask & (keys[at] == asked)


def trusted_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_ids of a bounded sample for train(), which quality() does without: of each language the trusted documents that hash lowest, TRUSTED_PER_LANGUAGE of them or as many as keep to its share of MODEL_CHARS."""
    trusted = labels.where("quality = 1 and doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < SAMPLED_TENTHS).select("doc_id").distinct()
    known = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.length("text").alias("chars")).join(trusted, "doc_id")
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang", F.col("lang").alias("group"))
    grouped = known.join(F.broadcast(common), "lang", "left").withColumn("group", F.coalesce("group", F.lit("other languages")))
    eligible = grouped.where(F.col("chars") <= TRUSTED_CHARS)
    sizes = eligible.groupBy("group").agg(F.count("*").alias("n"))  # LANGUAGES + 1 rows at most
    # a share of each language that holds several times the rows wanted: no more of them meet in one task
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    near = eligible.withColumn("place", place).join(F.broadcast(sizes), "group").where(F.col("place") * F.col("n") < 8 * TRUSTED_PER_LANGUAGE)
    w = Window.partitionBy("group").orderBy("place", "doc_id")
    chosen = near.withColumn("rank", F.row_number().over(w)).withColumn("upto", F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chosen.where((F.col("rank") <= TRUSTED_PER_LANGUAGE) & (F.col("upto") <= MODEL_CHARS // max(1, sizes.count()))).select("doc_id").distinct()


def trusted_part(labels: DataFrame) -> DataFrame:
    """doc_ids of all trusted documents that the model learns from: those of SAMPLED_TENTHS tenths by hash, the others set the quantiles."""
    return labels.where("quality = 1 and doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < SAMPLED_TENTHS).select("doc_id").distinct()


def _squeezed(a: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed: few of their bytes differ."""
    raw = np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _plain(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], 8 * n, "zstd"), np.uint8).reshape(8, n).T.copy().view(np.int64).ravel()


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with room for a lane behind them, where their words begin, how long these are, and how many words each text has; parted at _SPACE."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
    if len(raw) > 8:
        raw[:-8] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    word, ends = ~_IS_SPACE[raw[:-8]], ends - ends[0]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = ends[(ends > 0) & (ends < len(word))]  # words end with their text
    first[edges], last[edges - 1] = word[edges], word[edges - 1]
    at = np.flatnonzero(first)
    return raw, at, np.flatnonzero(last) + 1 - at, np.diff(np.searchsorted(at, ends))


def _hashed(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word of _split(), by lanes of eight bytes over all words at once; long words one by one."""
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h, todo = size.astype(np.uint64) * np.uint64(_MIX), np.arange(len(at))
    for word in np.flatnonzero(size > _LANES).tolist():
        h[word] = xxhash.xxh64_intdigest(raw[at[word] : at[word] + size[word]], 42)
    if len(at) and size.max() > _LANES:
        todo = np.flatnonzero(size <= _LANES)
    for k in range(0, _LANES, 8):
        x = lanes[at[todo] + k] & _BYTES[np.minimum(size[todo] - k, 8)] ^ h[todo]
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        h[todo] = x ^ x >> np.uint64(29)
        todo = todo[size[todo] > k + 8]
        if not len(todo):
            break
    return h.view(np.int64)


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, the words of all as numbers from 0, and the hash of each number."""
    raw, at, size, n = _split(texts)
    found = pa.array(_hashed(raw, at, size), pa.int64()).dictionary_encode()
    return n, found.indices.to_numpy(), found.dictionary.to_numpy()


@frugal
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and how often they occur in each piece of the texts."""
    for batch in parts(batches, 1000):
        _, x, hashes = _numbered(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(np.bincount(x, minlength=len(hashes)), pa.int64())], ["w", "n"])


class _Book:
    """Words by hash: the `common` have numbers in their order, `START` its own; any other that the filter of the model's words lets pass keeps a hash, the rest are UNKNOWN."""

    def __init__(self, common: np.ndarray, bits: np.ndarray | None):
        self.order = np.argsort(common)
        self.hashes, self.bits = common[self.order], bits

    def codes(self, h: np.ndarray) -> np.ndarray:
        rest = np.full(len(h), UNKNOWN)
        if self.bits is not None:
            at = h % (8 * len(self.bits))
            rest = np.where(self.bits[at >> 3] >> (at & 7) & 1, (h & _RARE_BITS) | _RARE, rest)
        asked = np.argsort(h)  # near ones one after another
        at, ok = _found(self.hashes, h[asked])
        if ok.any():
            rest[asked[ok]] = self.order[at[ok]]
        return rest


def _filter(words: DataFrame) -> np.ndarray:
    """Bits of words (w, a hash): 32 for each and FILTER_BITS in all at most, of which those at the words are set."""
    bucket = 1 << 15  # bits of Spark's bitmaps
    n = min(FILTER_BITS, -(-32 * max(1, words.count()) // bucket) * bucket)
    place = F.pmod("w", F.lit(n)) + 1
    rows = words.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(n // 8, np.uint8)
    for b, part in rows.collect():
        bits[(b - 1) * bucket // 8 : b * bucket // 8] = np.frombuffer(bytes(part), np.uint8)
    return bits


def _dealt(book, shards: int, rounds: int, turn: int, judged: bool):
    """A task that turns texts (columns of, text) into packed trigrams of the shards of one round: those of each text with how often they occur in it if judged, else of all its texts together."""

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: list[int] = []

        def packed() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            held.clear()
            rows = rows[:, np.argsort((rows[0] << 32) + rows[1])]
            at = np.flatnonzero(np.diff(rows[0], prepend=-1))
            for one in np.split(rows, at[1:], axis=1):
                of, n = np.unique(one[1], return_counts=True)
                body = [_squeezed(np.array(names, np.int64)[of]), _squeezed(n), *map(_squeezed, one[2:])]
                place = [pa.array([x], pa.int32()) for x in (one[0, 0] // rounds, one[0, 0], 1)]
                yield pa.RecordBatch.from_arrays([*place, *(pa.array([x], pa.binary()) for x in body)], _PACKED)
            names.clear()

        def hold(batch: pa.RecordBatch) -> None:
            n, numbers, hashes = _numbered(batch.column(1))
            if not len(numbers):
                return
            h = np.r_[START, hashes]
            codes = np.r_[START, book.value.codes(hashes)]
            shard = np.where(codes >= 0, codes % shards, codes)
            shard[0] = 0
            doc = np.repeat(np.arange(len(n)), n)
            x = np.zeros(len(numbers) + 2 * len(n), np.int64)  # two words START stand before each text
            x[np.arange(len(numbers)) + 2 * doc + 2] = numbers + 1
            here = (shard % rounds == turn) | (shard == UNKNOWN)
            mine = np.flatnonzero(here[x[1:-1]] & (x[2:] > 0))
            u, v, w = x[mine], x[mine + 1], x[mine + 2]
            # an unknown middle word has no counts to meet, so any shard will do and a frequent one fills none
            to = shard[v]
            lost = np.flatnonzero(to == UNKNOWN)
            to[lost] = (h[u[lost]] * 31 + h[w[lost]]) % shards
            if len(lost):
                of_turn = np.flatnonzero(to % rounds == turn)
                mine, to, u, v, w = mine[of_turn], to[of_turn], u[of_turn], v[of_turn], w[of_turn]
            of = np.repeat(np.arange(len(n)) + len(names), n + 2)[mine]
            names.extend(batch.column(0).to_pylist())
            key = (h[u] * 31 + h[v]) * 1000003 + h[w]
            if judged:
                key += of * _MIX
            order = np.argsort(key)
            first = _firsts(key[order])
            at, times = order[first], np.diff(first, append=len(order))
            if not len(at):
                return
            v = codes[v[at]]
            held.append(np.stack([to[at], of[at], times, codes[u[at]], np.where((v >= 0) & (v < _RARE), v // shards, v), codes[w[at]]]))

        for batch in parts(batches, 1000):
            hold(batch)
            if sum(r.shape[1] for r in held) > _GRAMS:
                yield from packed()
        if held:
            yield from packed()

    return deal


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """The shards of a partition that is sorted by them, each with its rows."""
    rows = (r for batch in batches for one in parts(iter([batch]), 1) for r in one.to_pylist())
    return itertools.groupby(rows, lambda r: r["shard"])


@frugal
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct trigrams of each shard with their counts, by middle, first and last word."""
    for shard, rows in _by_shard(batches):
        c, u, v, w = (np.concatenate(x) for x in zip(*([_plain(r[k]) for k in ("times", "u", "v", "w")] for r in rows), strict=True))
        order = _order(v, u, w)
        c, u, v, w = c[order], u[order], v[order], w[order]
        at = _firsts(v, u, w)
        body = [_squeezed(x) for x in (np.add.reduceat(c, at), u[at], v[at], w[at])]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in body)], ["shard", "times", "u", "v", "w"])


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by their columns, the first before the next."""
    key, most = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        values, place = np.unique(c, return_inverse=True)
        if most * len(values) >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            most = len(found)
        key, most = key * len(values) + place, most * len(values)
    return np.argsort(key)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted differ from those before them."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pairs(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle and last words of a shard's distinct trigrams and the number of words before them."""
    order = _order(v, w)
    v, w = v[order], w[order]
    at = _firsts(v, w)
    return v[at], w[at], np.diff(at, append=len(v))


@frugal
def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all shards have to know of each (level, shard, key, n): words before a word (1; with its shard), pairs (2) and trigrams (3) by their count, 5 for more."""
    for batch in batches:
        for r in batch.to_pylist():
            c, u, v, w = (_plain(r[k]) for k in ("times", "u", "v", "w"))
            _, last, n2 = _pairs(u, v, w)
            key, n1 = np.unique(last, return_counts=True)
            for level, k, n in ((1, key, n1), *((level, *np.unique(np.minimum(x, 5), return_counts=True)) for level, x in ((2, n2), (3, c)))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), level), pa.int32()), pa.array(np.full(len(k), r["shard"]), pa.int32()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["level", "shard", "key", "n"])


def _stepped(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array(d)[np.minimum(c, 3) - 1]


class _Shard:
    """The part of the model whose trigrams have their middle words in one shard; without a row there are none."""

    def __init__(self, row: dict | None, facts: dict):
        self.facts, self.rare, self.middle = facts, [], []
        if row is None:
            return
        c, u, v, w = (_plain(row[k]) for k in ("times", "u", "v", "w"))
        d2, d3 = facts["d2"], facts["d3"]
        self.rare = np.array(row["rare"] or [], np.int64)
        order = np.argsort(self.rare)
        self.rare, self.rare_p1 = self.rare[order], np.array(row["rare_p1"] or [], np.float64)[order]
        self.middle = v[_firsts(v)]
        self.vocabulary = np.unique(np.concatenate([u, w]))
        self.n = len(self.vocabulary) + 1
        self.places = np.full(len(facts["p1"]), -1)
        common = np.flatnonzero((self.vocabulary >= 0) & (self.vocabulary < len(self.places)))
        self.places[self.vocabulary[common]] = common
        v2, w2, c2 = _pairs(u, v, w)
        at = _firsts(v2)
        t2 = np.add.reduceat(c2, at)
        self.g2 = np.add.reduceat(_stepped(c2, d2), at) / t2
        i = np.searchsorted(self.middle, v2)
        self.pairs = i * self.n + np.searchsorted(self.vocabulary, w2)
        self.p2 = (c2 - _stepped(c2, d2)) / t2[i] + self.g2[i] * np.exp(self.p1(w2))
        at = _firsts(v, u)
        t3 = np.add.reduceat(c, at)
        self.contexts = np.searchsorted(self.middle, v[at]) * self.n + np.searchsorted(self.vocabulary, u[at])
        self.g3 = np.add.reduceat(_stepped(c, d3), at) / t3
        k = np.repeat(np.arange(len(at)), np.diff(at, append=len(v)))
        self.triples = k * self.n + np.searchsorted(self.vocabulary, w)
        lower = self.p2[np.searchsorted(self.pairs, np.searchsorted(self.middle, v) * self.n + np.searchsorted(self.vocabulary, w))]
        self.p3 = np.log((c - _stepped(c, d3)) / t3[k] + self.g3[k] * lower)
        self.p2, self.g2, self.g3 = np.log(self.p2), np.log(self.g2), np.log(self.g3)

    def p1(self, w: np.ndarray) -> np.ndarray:
        """Log-probabilities of words; NaN for a word that is neither common nor a last word in this shard's model."""
        p1 = self.facts["p1"]
        p = np.where(w == UNKNOWN, self.facts["floor"], np.nan)
        common = (w >= 0) & (w < len(p1))
        p[common] = p1[w[common]]
        if len(self.rare):
            at, ok = _found(self.rare, w)
            p = np.where(ok, self.rare_p1[at], p)
        return p

    def __call__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities of w after u and v, NaN where that of w alone is not here; what has to be added to that; and which trigrams the model has seen."""
        if not len(self.middle):
            return self.p1(w), np.zeros(len(w)), np.zeros(len(w), bool)
        i, known = _found(self.middle, v)
        base, p, seen = np.where(known, self.g2[i], 0), self.p1(w), np.zeros(len(w), bool)
        k = np.flatnonzero(known)
        (a, before), (b, after) = self.number(u[k]), self.number(w[k])
        j, pair = _found(self.pairs, i[k] * self.n + b)
        c, context = _found(self.contexts, i[k] * self.n + a)
        above = np.where(context & before, self.g3[c], 0)
        pair &= after
        base[k] += above
        p += base
        p[k[pair]] = (above + self.p2[j])[pair]
        both = np.flatnonzero(context & before & after)
        t, ok = _found(self.triples, c[both] * self.n + b[both])
        p[k[both[ok]]] = self.p3[t[ok]]
        seen[k[both[ok]]] = True
        return p, base, seen

    def number(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words in the shard's vocabulary, and which are in it."""
        common = (codes >= 0) & (codes < len(self.places))
        at = np.where(common, self.places[np.where(common, codes, 0)], -1) if len(self.places) else np.full(len(codes), -1)
        rest = np.flatnonzero(~common)
        k, ok = _found(self.vocabulary, codes[rest])
        at[rest[ok]] = k[ok]
        return np.maximum(at, 0), at >= 0


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys have what is asked, and which of it they have."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _measured(facts):
    """A task that reads each shard's part of the model and then the packed trigrams of texts: sums by text, and by last word w for those whose probability is not here, of what has to be added to that of w."""

    @frugal
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            part, rare = _Shard(None, facts.value), {"rare": None, "rare_p1": None}
            for row in rows:
                if row["kind"] == -1:
                    rare = row
                    continue
                if row["kind"] == 0:
                    part = _Shard(row | {k: rare[k] for k in ("rare", "rare_p1")}, facts.value)
                    continue
                times, u, v, w = (_plain(row[k]) for k in ("times", "u", "v", "w"))
                of, n = _plain(row["of"]), _plain(row["n"])
                p, base, seen = part(u, v, w)
                lost = np.isnan(p)
                if lost.any():
                    one, b = np.ones(lost.sum()), base[lost]
                    yield _sums(np.repeat(of, n)[lost], one, times[lost], b * times[lost], b, b * b, one - 1, pa.array(w[lost], pa.int64()))
                p, at = np.where(lost, 0, p), np.r_[0, np.cumsum(n)[:-1]]
                each = [np.add.reduceat(x, at) for x in ((~lost).astype(float), np.where(lost, 0, times), p * times, p, p * p, seen.astype(float))]
                yield _sums(of, each[0], each[1], *each[2:], pa.nulls(len(of), pa.int64()))

    return measure


def _sums(of, n, times, lp, p, pp, seen, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *(pa.array(x, pa.float64()) for x in (n, times, lp, p, pp, seen)), w], ["of", "n", "times", "lp", "p", "pp", "seen", "w"])


def sharded_scores(texts: DataFrame, learnt: DataFrame, words: DataFrame) -> DataFrame:
    """_Scorer's measures of texts (columns of, a hash of the text, and text) under the model of the stored texts `learnt`, of any size, whose words (w, a hash, and n) are counted and stored; drops both. Texts that repeat count their words each. Columns: of, n_words, nll, types_nll, spread, seen."""
    spark = texts.sparkSession
    common, total = words.orderBy(F.desc("n"), "w").limit(BROADCAST_WORDS).select("w").toArrow().column(0).to_numpy(), words.agg(F.sum("n")).first()[0]
    whole = len(common) < BROADCAST_WORDS
    book = spark.sparkContext.broadcast(_Book(common, None if whole else _filter(words)))
    rounds, shards = ROUNDS, ROUNDS * max(SHARDS, -(-total // (SHARD_WORDS * ROUNDS)))
    packed = "place int, shard int, kind int, of binary, n binary, times binary, u binary, v binary, w binary"

    def gathered_by_shard(rows: DataFrame, n: int) -> DataFrame:
        return rows.repartitionById(n, "place").sortWithinPartitions("shard", "kind")

    dealt = learnt.select(F.lit(0).cast("long").alias("of"), "text").mapInArrow(_dealt(book, shards, 1, 0, False), packed)
    counts = tidily_stored(gathered_by_shard(dealt, shards).mapInArrow(_counted, "shard int, times binary, u binary, v binary, w binary"))
    dropped(learnt, words)
    facts = tidily_stored(counts.mapInArrow(_facts, "level int, shard int, key long, n long"))
    by_count = {level: {r["key"]: r["n"] for r in facts.where(F.col("level") == level).groupBy("key").agg(F.sum("n").alias("n")).collect()} for level in (2, 3)}
    c1 = tidily_stored(facts.where("level = 1").groupBy("key").agg(F.sum("n").alias("c")))
    discount, _ = _discount(c1, "c")
    sums = c1.agg(F.sum("c").alias("t"), F.sum(discount).alias("g")).first()
    floor = sums["g"] / sums["t"] / WORD_TYPES
    p1 = c1.select("key", F.log((F.col("c") - discount) / F.lit(sums["t"]) + F.lit(floor)).alias("p1"))
    key, value = _columns(p1.where(F.col("key").between(0, len(common) - 1)))
    of_common = np.full(len(common), math.log(floor))
    of_common[key] = value
    known = spark.sparkContext.broadcast({"d2": _steps(by_count[2]), "d3": _steps(by_count[3]), "p1": of_common, "floor": math.log(floor)})
    p1 = tidily_stored(p1.where(F.col("key") >= len(common)).withColumnRenamed("key", "w"))
    rare = facts.where("level = 1").select("shard", F.col("key").alias("w")).join(p1, "w").groupBy("shard").agg(F.collect_list(F.struct("w", "p1")).alias("r"))
    rare = tidily_stored(rare.select("shard", F.col("r.w").alias("rare"), F.col("r.p1").alias("rare_p1")))
    dropped(facts, c1)
    place = (F.col("shard") / rounds).cast("int").alias("place")
    model = counts.select(place, F.lit(0).alias("kind"), "*").unionByName(rare.select(place, F.lit(-1).alias("kind"), "*"), allowMissingColumns=True)
    found = []
    for turn in range(rounds):
        asked = texts.mapInArrow(_dealt(book, shards, rounds, turn, True), packed)
        both = asked.unionByName(model.where(F.col("shard") % rounds == turn), allowMissingColumns=True)
        out = gathered_by_shard(both, shards // rounds).mapInArrow(_measured(known), "of long, n double, times double, lp double, p double, pp double, seen double, w long")
        found.append(tidily_stored(out.groupBy("of", "w").agg(*(F.sum(c).alias(c) for c in _SUMS))))
    dropped(counts, rare)
    sums = functools.reduce(DataFrame.unionByName, found)
    alone = F.coalesce("p1", F.lit(math.log(floor)))
    whole_p = [F.col("lp") + alone * F.col("times"), F.col("p") + alone * F.col("n"), F.col("pp") + 2 * alone * F.col("p") + alone * alone * F.col("n")]
    rest = sums.where("w is not null").join(p1, "w", "left").select("of", "w", "n", "times", *(c.alias(k) for k, c in zip(("lp", "p", "pp"), whole_p, strict=True)), "seen")
    each = sums.where("w is null").unionByName(rest).groupBy("of").agg(*(F.sum(c).alias(c) for c in _SUMS))
    mean = F.col("p") / F.col("n")
    scores = tidily_stored(each.select("of", F.col("times").cast("long").alias("n_words"), (-F.col("lp") / F.col("times")).alias("nll"), (-mean).alias("types_nll"), F.greatest(F.col("pp") / F.col("n") - mean * mean, F.lit(0.0)).alias("spread"), (F.col("seen") / F.col("n")).alias("seen")))
    dropped(p1, *found)
    return scores


def _z(measure: str, limit: str = "limit") -> Column:
    """A measure against the language's mean, in units of what a text of its length may vary."""
    return (F.col(measure) - F.col(f"{limit}.mean")) / F.sqrt(F.col(f"{limit}.between") + F.col(f"{limit}.within") / F.col("n_words") + 1e-6)


def _limits(judged: DataFrame, measure: str, by: list[str]) -> DataFrame:
    """For each language (or for all) a struct `measure`: mean, variance between and within documents, quantiles LOW and HIGH of z, and the number of documents. Every aggregate has a bounded state, so partial ones leave each task."""
    long = F.col("n_words") >= 100
    base = judged.groupBy(*by).agg(F.avg(F.when(long, F.col(measure))).alias("m1"), F.avg(measure).alias("m2"), F.var_pop(F.when(long, F.col(measure))).alias("between"), F.avg("spread").alias("within"))
    limit = F.struct(F.coalesce("m1", "m2").alias("mean"), F.coalesce("between", F.lit(0.25)).alias("between"), "within")
    base = stored(base.select(*by, limit.alias("limit")))
    near = F.broadcast(base) if base.count() <= BROADCAST_LANGUAGES else base  # judged rows stay where they are: none moves to its language
    both = judged.join(near, by) if by else judged.crossJoin(near)
    z = F.round(_z(measure), 2)
    cut = both.groupBy(*by, "limit").agg(F.percentile(z, F.array(F.lit(LOW), F.lit(HIGH))).alias("q"), F.count("*").alias("n"))
    return cut.select(*by, F.struct("limit.*", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n").alias(f"{measure}_limit"))


def _scored_beside(rows: DataFrame, model) -> DataFrame:
    """doc_id, lang and _Scorer's measures of rows, each scored where it is read, under a gathered model that is broadcast."""

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model.value)
        for batch in parts(batches):
            found = list(zip(*map(scorer, (x or "" for x in batch.column(2).to_pylist())), strict=True)) or [[]] * 5
            kinds = (pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], ["doc_id", "lang", "n_words", "nll", "types_nll", "spread", "seen"])

    return rows.mapInArrow(score, "doc_id long, lang string, n_words long, nll double, types_nll double, spread double, seen double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with n_words, nll (mean over words), perplexity, types_nll (mean over distinct trigrams), z and kept.

    z is nll against the language's trusted mean in units of what a text of its length may vary, types_z the same of
    types_nll; a document is kept when both lie between the language's quantiles LOW and HIGH of trusted documents
    outside those the model learns from. Above HIGH is text the model doesn't expect: perplexity judges every word as often as it
    occurs, types_nll keeps a repeated line from hiding what else there is. Below LOW are few common words over and
    over, unless many of the trigrams are in the model: then the document copies trusted text and is kept. Null or
    empty texts have no perplexity and are kept. A null or unknown language takes the quantiles of all. Repeated rows
    are judged each. Empty labels reject nothing, and an empty table gives an empty result. Very long texts are learnt
    and scored whole. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    own = stored(trusted_part(labels))
    learnt = tidily_stored(docs.join(own, "doc_id", "left_semi").select("text").distinct())
    words = tidily_stored(learnt.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    if (words.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_TRIGRAMS:
        model = tables(learnt)
        scored = stored(_scored_beside(rows, spark.sparkContext.broadcast(gathered(model))))
        if model["n"]:
            dropped(model["triples"], model["pairs"], model["words"])
        dropped(learnt, words)
    else:
        named = rows.select("doc_id", "lang", F.xxhash64("text").alias("of"), "text")
        texts = named.where("text is not null").select("of", "text")
        scores = found = sharded_scores(texts, learnt, words)
        measures = [F.coalesce(m, F.lit(0.0)).alias(m) for m in ("nll", "types_nll", "spread", "seen")]
        copies = named.groupBy("of").agg(F.count("*").alias("copies"))
        found = found.join(copies, "of").withColumn("n_words", F.expr("n_words div copies"))
        scored = tidily_stored(named.drop("text").join(found, "of", "left").select("doc_id", "lang", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), *measures))
        dropped(scores)
    trusted = labels.where("quality = 1").select("doc_id").distinct().join(own, "doc_id", "left_anti")
    held_out = stored(scored.join(trusted, "doc_id", "left_semi").where(F.col("n_words") > 0))
    usual = held_out.agg(F.percentile(F.round("seen", 3), 0.5)).first()[0] or 0.0
    copied = F.col("seen") > min(0.9, max(MEMORISED, 3 * usual))
    judged = held_out.where(~copied)
    out, inside = scored, F.lit(True)
    for measure in ("nll", "types_nll"):
        limit, by_lang = f"{measure}_limit", stored(_limits(judged, measure, ["lang"]).where(F.col(f"{measure}_limit.n") >= LEAST_TRUSTED))
        whole = _limits(judged, measure, []).collect()  # one row at most
        of_all = F.lit(None) if not whole else F.struct(*(F.lit(v).alias(k) for k, v in whole[0][limit].asDict().items()))
        out = out.join(F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGUAGES else by_lang, "lang", "left").withColumn(limit, F.coalesce(limit, of_all.cast(by_lang.schema[limit].dataType)))
        z = F.when(F.col("n_words") > 0, _z(measure, limit))
        inside = inside & (z <= F.col(f"{limit}.high")) & ((z >= F.col(f"{limit}.low")) | copied)
        out = out.withColumn("z" if measure == "nll" else "types_z", z)
    out = out.withColumn("kept", F.coalesce(inside, F.lit(True)))
    limits = [F.col("nll_limit.low").alias("low"), F.col("nll_limit.high").alias("high"), F.col("types_nll_limit.low").alias("types_low"), F.col("types_nll_limit.high").alias("types_high")]
    return out.select("doc_id", "lang", "n_words", "nll", F.exp("nll").alias("perplexity"), "types_nll", "seen", "z", "types_z", *limits, "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of trusted ones, and which are kept."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
