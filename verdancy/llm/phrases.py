"""Phrase collocations from counting quotient filters.

Words that are frequent enough to stand in a frequent phrase have numbers. An n-gram is a packed key of numbers, and an
invertible permutation spreads the keys evenly. A filter keeps distinct permuted keys in order: the high bits are the
quotient, kept as one bit for each quotient that occurs and one bit for each end of its run, the other bits are kept in
full as remainder beside a counter of variable length. Nothing is lost, so the counts are exact and the words come back
by the inverse permutation. Filters of shards, cut at ranges of the highest bits, are merged in order of the keys; no
range is heavier than another, whatever word or language is frequent.

Sizes are counted one after another: a longer phrase is counted only where its parts passed, by a bitmap of fixed size
that may let too many pass but never too few.
"""

from __future__ import annotations

import math
import struct
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdancy.llm.salted import beside
from verdancy.llm.storage import frugal, parts, small_batches, stored

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
FIRST = 2000  # candidates reported for each language
COVERED_PERCENT = 80  # of a candidate's occurrences within one longer candidate
CHUNK = 1 << 20  # words counted together in a shard, and entries held before filters are merged
COUNTED_WORDS = 200_000  # distinct words that a task counts before it hands them on
BROADCAST_WORDS, BROADCAST_BYTES = 1_000_000, 32 << 20  # a larger vocabulary is joined
GATE_BITS = 27
BREAK = b"."
_TO_BREAK = bytes.maketrans(b",;:!?\n\v\f\r", b"........." )
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased, parted at blanks and tabs, with BREAK between pieces."""
    return (text or "").encode().lower().translate(_TO_BREAK).replace(BREAK, b" . ").replace(b"\t", b" ").split(b" ")


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x + np.uint64(k)) * np.uint64(_ROUNDS[0] ^ (k & ~1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two halves of `width` bits, permuted by a balanced network of four rounds."""
    mask = np.uint64((1 << width) - 1)
    for k in _ROUNDS:
        high, low = low, high ^ (_mixed(low, k) & mask)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that permuted() came from."""
    mask = np.uint64((1 << width) - 1)
    for k in reversed(_ROUNDS):
        high, low = low ^ (_mixed(high, k) & mask), high
    return high, low


class QuotientFilter:
    """Distinct permuted keys in order with their counts. All keys share the `skip` highest bits, the range."""

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, width: int, skip: int):
        self.high, self.low, self.counts, self.width, self.skip = high, low, counts, width, skip

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, width: int, skip: int) -> QuotientFilter:
        """From keys in any order; equal ones are added up. Stable sorts merge what is in order already."""
        if 2 * width <= 64:
            order = np.argsort((high << np.uint64(width)) | low, kind="stable")
        else:
            order = np.lexsort((low, high))
        high, low, counts = high[order], low[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
        return cls(high[first], low[first], np.add.reduceat(counts, first), width, skip)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter of several of a range."""
        return cls.of(*(np.concatenate([getattr(f, part) for f in filters]) for part in ("high", "low", "counts")), filters[0].width, filters[0].skip)

    def ranges(self, bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The filter cut by the highest `bits` bits of its keys."""
        of = self.high >> np.uint64(self.width - bits)
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(of[a]), QuotientFilter(self.high[a:b], self.low[a:b], self.counts[a:b], self.width, bits)

    def packed(self) -> bytes:
        """Quotients that occur, ends of their runs, remainders, counters: one byte each, eight more from 255 on."""
        n, free = len(self.high), self.width - self.skip
        q = min(free, max(n.bit_length() - 1, 0))
        rest = free - q
        quotient = ((self.high >> np.uint64(rest)) & np.uint64((1 << q) - 1)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.concatenate((quotient[1:] != quotient[:-1], [True]))
        remainder = _narrow(self.high & np.uint64((1 << rest) - 1), rest) + _narrow(self.low, self.width)
        wide = self.counts[self.counts >= 255].astype("<u8").tobytes()
        return struct.pack("<IB", n, q) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + remainder + np.minimum(self.counts, 255).astype(np.uint8).tobytes() + wide

    @classmethod
    def unpacked(cls, data: bytes, width: int, skip: int, of_range: int) -> QuotientFilter:
        n, q = struct.unpack_from("<IB", data)
        rest, at = width - skip - q, 5

        def taken(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(taken(((1 << q) + 7) // 8), count=1 << q))
        ends = np.unpackbits(taken((n + 7) // 8), count=n)
        quotient = occupied[np.cumsum(ends) - ends].astype(np.uint64)
        high = _wide(taken(n * ((rest + 7) // 8)), n) | (quotient << np.uint64(rest)) | (np.uint64(of_range) << np.uint64(width - skip))
        low = _wide(taken(n * ((width + 7) // 8)), n)
        counts = taken(n).astype(np.int64)
        large = np.flatnonzero(counts == 255)
        counts[large] = taken(8 * len(large)).view("<u8").astype(np.int64)
        return cls(high, low, counts, width, skip)


def _narrow(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8].tobytes()


def _wide(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : x.size // n] = x.reshape(n, -1)
    return out.view("<u8").ravel().astype(np.uint64)


def keys(ids: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Halves and half width of the n-grams that begin at each place but the last n - 1."""
    x = ids.astype(np.uint64)
    w = [x[k : len(x) - n + 1 + k] for k in range(n)]
    if n == 2:
        return w[0], w[1], bits
    b = np.uint64(bits)
    return (w[0] << b) | w[1], (w[2] << b) | (w[3] if n == 4 else np.uint64(0)), 2 * bits


def ids_of(high: np.ndarray, low: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The numbers of the words of unpermuted keys, a row each."""
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    return np.stack([high, low] if n == 2 else [high >> b, high & mask, low >> b, low & mask][:n], 1).astype(np.int64)


def prints(high: np.ndarray, low: np.ndarray, gate_bits: int) -> np.ndarray:
    """Places in the gate's bitmap of permuted keys."""
    return (_mixed(high * np.uint64(3) + low, _ROUNDS[1]) >> np.uint64(64 - gate_bits)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words of docs (lang and text); each task hands on sums of COUNTED_WORDS words at most."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang].update(tokens(text))
            if sum(map(len, held.values())) > COUNTED_WORDS:
                yield from told(held)
                held.clear()
        yield from told(held)

    def told(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(BREAK, None), counts.pop(b"", None)
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), words, pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """words with id from 1 on without gaps, written."""
    placed = stored(words.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(before, F.lit(0)).alias("offset"))  # a row for each task
    return stored(placed.join(F.broadcast(offsets), part == F.col("part")).select(*words.columns, (F.col("offset") + F.col("at") % (1 << 33) + 1).cast("int").alias("id")))


def _sequences(ids: Iterable[list[int]]) -> Iterator[pa.RecordBatch]:
    """Rows of numbers, about CHUNK / 8 each, with one 0 between stretches."""
    held: list[int] = []

    def told() -> pa.RecordBatch:
        x = np.array(held + [0], np.int32)
        x = x[(x != 0) | np.concatenate(([False], x[:-1] != 0))]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int32()))], ["ids"])

    for some in ids:
        held += some
        held.append(0)
        if len(held) > CHUNK // 8:
            yield told()
            held.clear()
    if held:
        yield told()


def sequences(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """Rows of ids: the numbers of all words in order, 0 wherever a phrase can't go on. A small vocabulary is broadcast, else words are joined."""
    spark = docs.sparkSession
    if small:
        told = spark.sparkContext.broadcast(vocabulary.select("lang", "word", "id").toArrow())

        @frugal
        def by_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, dict[bytes, int]] = defaultdict(dict)
            for lang, word, number in zip(*(told.value.column(k).to_pylist() for k in range(3)), strict=True):
                known[lang][word.encode()] = number

            def ids() -> Iterator[list[int]]:
                for batch in parts(batches):
                    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        of = known.get(lang, {}).get
                        yield [of(w, 0) for w in tokens(text) if w]

            yield from _sequences(ids())

        return docs.mapInArrow(by_dictionary, "ids array<int>")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 50):
            for row, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = [w for w in tokens(text) if w]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(range(len(words)), pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string())], ["row", "at", "lang", "word"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ids() -> Iterator[list[int]]:
            last = None
            for batch in batches:
                row, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for some in np.split(np.arange(len(row)), np.flatnonzero(row[1:] != row[:-1]) + 1):
                    if len(some) and last is not None and row[some[0]] != last:
                        yield []
                    if len(some):
                        last = row[some[0]]
                        held = number[some].tolist()
                        yield held

        joined: list[int] = []

        def whole() -> Iterator[list[int]]:
            for some in ids():  # a text may go on in the next batch
                if not some:
                    yield list(joined)
                    joined.clear()
                joined.extend(some)
            yield list(joined)

        yield from _sequences(whole())

    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", "text").mapInArrow(listed, "row long, at long, lang string, word string"))
    rows = rows.select("row", "at", F.struct("lang", "word").alias("key"))
    named = beside(rows, "key", "at", vocabulary.select(F.struct("lang", "word").alias("key"), "id"), rows.count())
    return named.select("row", F.coalesce("id", F.lit(0)).alias("id"), "at").repartition("row").sortWithinPartitions("row", "at").mapInArrow(gathered, "ids array<int>")


def counted(sequences: DataFrame, n: int, bits: int, range_bits: int, gate: tuple[int, object] | None, least: int) -> DataFrame:
    """ids (an array of n numbers) and a, the occurrences of every phrase of n words that has `least`; print is its place in the next gate.

    gate is (bits, broadcast bitmap) of the frequent phrases of n - 1 words, or None.
    """
    width = bits if n == 2 else 2 * bits
    skip = min(range_bits, width)

    @frugal
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(np.asarray(batch.column(0)[k].values))
                size += len(held[-1])
                if size >= CHUNK:
                    yield from told(held)
                    held, size = [], 0
        yield from told(held)

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([*held, np.zeros(n, np.int32)])
        whole = np.ones(len(ids) - n + 1, bool)
        for k in range(n):
            whole &= ids[k : len(ids) - n + 1 + k] != 0
        if gate is not None and whole.any():
            high, low, half = keys(ids, n - 1, bits)
            place = prints(*permuted(high, low, half), gate[0])
            bitmap = np.frombuffer(gate[1].value, np.uint8)
            passed = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            whole &= passed[:-1] & passed[1:]
        if not whole.any():
            return
        high, low, _ = keys(ids, n, bits)
        high, low = permuted(high[whole], low[whole], width)
        cut = list(QuotientFilter.of(high, low, np.ones(len(high), np.int64), width, 0).ranges(skip))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in cut], pa.int32()), pa.array([f.packed() for _, f in cut], pa.binary())], ["range", "filter"])

    @frugal
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[QuotientFilter] = []
        size, at = 0, None
        for batch in batches:
            for of_range, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if of_range != at and held:
                    yield from frequent(QuotientFilter.merged(held))
                    held, size = [], 0
                at = of_range
                held.append(QuotientFilter.unpacked(data.as_py(), width, skip, of_range))
                size += len(held[-1].counts)
                if size >= CHUNK and len(held) > 1:
                    held = [QuotientFilter.merged(held)]
                    size = 0  # so that a large range is merged once for each CHUNK of new entries
        if held:
            yield from frequent(QuotientFilter.merged(held))

    def frequent(f: QuotientFilter) -> Iterator[pa.RecordBatch]:
        often = f.counts >= least
        if often.any():
            high, low = f.high[often], f.low[often]
            words = ids_of(*restored(high, low, width), n, bits)
            ids = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, n), pa.int32()), pa.array(words.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(f.counts[often]), pa.array(prints(high, low, GATE_BITS))], ["ids", "a", "print"])

    filters = sequences.mapInArrow(shard, "range int, filter binary")
    tasks = max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return filters.repartition(min(tasks, 1 << skip), "range").sortWithinPartitions("range").mapInArrow(merge, "ids array<int>, a long, print long")


def _gate(phrases: DataFrame) -> tuple[int, object]:
    """The bitmap of the places of phrases: 16 MB at most, whatever their number."""
    place = F.col("print") + 1  # Spark's bitmaps number from 1
    blocks = phrases.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = np.zeros((1 << GATE_BITS) // 8, np.uint8)
    for block, bits in blocks.toLocalIterator():  # (1 << GATE_BITS) / 32768 rows of 4096 bytes at most
        at = (block - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(bytes(bits), np.uint8)
    return GATE_BITS, phrases.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates with l, r and score of their lowest-scoring cut, the earliest of equal ones."""
    k = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cuts = candidates.select("ids", "a", k).select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    n = cuts.count()
    both = beside(cuts, "left", "right", counts.select(F.col("ids").alias("left"), F.col("a").alias("l")), n)
    both = beside(both, "right", "left", counts.select(F.col("ids").alias("right"), F.col("a").alias("r")), n)
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div cast(l + r as decimal(20,0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("ids", "a").agg(lowest).select("ids", "a", "cut.l", "cut.r", "cut.score")


def _standing(candidates: DataFrame) -> DataFrame:
    """candidates without those of which COVERED_PERCENT lie within one longer candidate, whatever becomes of that one."""
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))")
    covers = candidates.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    return candidates.join(covers, "ids", "left").where(F.coalesce(100 * F.col("longer") < COVERED_PERCENT * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of two to four words of each language that has any.

    Counts are by language, a null one being `und`. A null or empty text has no words, a very long one is read whole;
    a repeated row counts as often as it occurs; an empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = stored(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = numbered(words.where(F.col("n") >= least))
    size, chars, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = size.bit_length()
    range_bits = min(16, max(6, (total >> 18).bit_length()))
    rows = stored(sequences(docs, vocabulary, size <= broadcast_words and chars <= BROADCAST_BYTES))
    levels, gate = [], None
    for n in range(2, LONGEST + 1):
        levels.append(stored(counted(rows, n, bits, range_bits, gate, least)))
        gate = _gate(levels[-1]) if n < LONGEST else None
    candidates = levels[0].select("ids", "a")
    for level in levels[1:]:
        candidates = candidates.union(level.select("ids", "a"))
    candidates = stored(candidates)
    counts = candidates.union(vocabulary.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    scored = stored(_scored(_standing(candidates), counts))
    n = scored.count()
    spelt = beside(scored.select("ids", F.posexplode("ids").alias("at", "id")), "id", "ids", vocabulary.select("id", "lang", "word"), LONGEST * n)
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    texts = spelt.groupBy("ids").agg(F.first("lang").alias("lang"), phrase.alias("phrase"))

    def rank(*by: str | Column) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))

    salt = F.pmod(F.xxhash64("ids"), F.lit(max(8, math.isqrt(n // first + 1))))
    near = scored.join(texts, "ids").withColumn("salt", salt).withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= first)
    best = near.withColumn("rank", rank("lang").cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS p FROM worded CROSS JOIN (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, p, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), candidates AS (
  SELECT * FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.p, c.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1:]
), scored AS (
  SELECT lang, p, a, arg_min({{'l': l, 'r': r, 'score': score}}, {{'s': score, 'j': j}}) AS cut FROM cuts GROUP BY lang, p, a
), inner_parts AS (
  SELECT lang, k, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: p[i:i + m - 1])))) AS p FROM candidates
), covered AS (
  SELECT DISTINCT c.lang, c.p FROM candidates c JOIN inner_parts i ON i.lang = c.lang AND i.p = c.p WHERE 100 * i.a >= {COVERED_PERCENT} * c.a
), ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, cut.l AS l, cut.r AS r, cut.score AS score,
    row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM scored ANTI JOIN covered USING (lang, p)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {FIRST}
"""
