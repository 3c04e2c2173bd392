"""Best-fit packing of token sequences by linear grouping.

Large lengths are cut into groups of equal cardinality and rounded up to the largest of their group; configurations
of these few sizes are chosen; actual documents take the places; small lengths then go where they fit best. All of
the planning works on the histogram of lengths, which has at most `capacity` rows whatever the corpus holds.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdancy.llm.storage import frugal, parts, small_batches, stored

CAPACITY = 4096
GROUPS = 32
SMALL_SHARE = 8
SHARDS = 64
SHARD_ROWS = 1_000_000  # pieces for each shard where there are many
BROADCAST_ROWS = 1_000_000
EOS = 1
CACHE_WORDS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the other bytes for U+0100 onward."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _WordIds:
    """Token ids of whole texts as little-endian bytes, by way of a cache over the text's words.

    The vocabulary's pre-tokens never reach across white space, so a text's ids are those of its words in order. A
    word of Latin letters and marks after it is a run of letters and a run of marks, each a pre-token of its own.
    """

    LETTERS = _byte_letters()
    MARKS = ".,;:!?%$#&*"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        plain = word.rstrip(self.MARKS)
        low = plain.lower()
        if not (plain.isalpha() and (plain.isascii() or max(low) < "\u0250" and "\u0130" not in plain and unicodedata.is_normalized("NFC", word))):
            return self.whole(word)
        if (ids := self.letters.get(low)) is None:
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(self.LETTERS)
            found = [t.id for t in self.tokenizer.model.tokenize(spelt)]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.letters) < CACHE_WORDS:
                self.letters[low] = ids
        after = word[len(plain) :]
        if (mark := self.marks.get(after)) is None:
            mark = self.whole(after)
            if len(self.marks) < CACHE_WORDS:
                self.marks[after] = mark
        return ids + mark

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split parts at these, the vocabulary does not
                yield self.whole(text)
                continue
            words = text.split()
            new = {w: self.word(w) for w in set(words).difference(known)}
            if len(known) < CACHE_WORDS:
                known.update(new)
                yield b"".join(map(known.__getitem__, words))
            else:
                yield b"".join([new[w] if w in new else known[w] for w in words])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Documents as runs of at most `capacity` ids: doc_id, piece, start, length, ids_crc32. A null text is empty; each document ends with EOS."""

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = _WordIds(tokenizer_path), np.array([EOS], "<u4").tobytes(), 4 * capacity
        for batch in parts(batches):
            out: list[tuple] = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(cut, PIECES)


def _configuration(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """Of the patterns that hold the largest size left, the one that fills most: how often each size occurs in it."""
    first = next(i for i, c in enumerate(counts) if c)
    room = capacity - sizes[first]
    reach = [np.zeros(room + 1, bool)]
    reach[0][0] = True
    for i, s in enumerate(sizes):
        now, left = reach[-1].copy(), counts[i] - (i == first)
        for k in range(1, min(left, room // s) + 1):
            now[k * s :] |= reach[-1][: room + 1 - k * s]
        reach.append(now)
    used, at = [0] * len(sizes), int(np.flatnonzero(reach[-1])[-1])
    for i in range(len(sizes) - 1, -1, -1):
        while not reach[i][at]:
            used[i] += 1
            at -= sizes[i]
    used[first] += 1
    return used


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for `histogram[length]` pieces of each length: rows (length, first rank, pieces, first sequence, pieces in each sequence, offset), and the number of sequences."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[list[int]]] = defaultdict(list)  # residual -> [first sequence, sequences]
    keys: list[int] = []
    taken: dict[int, int] = defaultdict(int)
    sequences = 0

    def room(residual: int, base: int, n: int) -> None:
        if residual and n:
            if not free[residual]:
                insort(keys, residual)
            free[residual].append([base, n])

    def put(length: int, n: int, base: int, each: int, offset: int) -> None:
        rows.append((length, taken[length], n * each, base, each, offset))
        taken[length] += n * each

    # linear grouping of the large lengths
    small = capacity // SMALL_SHARE
    large = sorted((x for x in histogram if x > small), reverse=True)
    total = sum(histogram[x] for x in large)
    bounds = [total * (g + 1) // max(1, min(groups, total)) for g in range(min(groups, total))]
    runs: list[list[list[int]]] = [[] for _ in bounds]
    g = seen = 0
    for x in large:
        left = histogram[x]
        while left:
            n = min(left, bounds[g] - seen)
            if n:
                runs[g].append([x, n])
            seen, left = seen + n, left - n
            g += seen == bounds[g]
    sizes, counts = [r[0][0] for r in runs], [sum(n for _, n in r) for r in runs]

    # configurations of the rounded sizes, filled with actual lengths
    while any(counts):
        used = _configuration(sizes, counts, capacity)
        times = min(counts[i] // u for i, u in enumerate(used) if u)
        slots = []
        for i, u in enumerate(used):
            counts[i] -= u * times
            for _ in range(u):
                need, got = times, []
                while need:
                    head = runs[i][0]
                    n = min(need, head[1])
                    got.append([head[0], n])
                    head[1] -= n
                    need -= n
                    if not head[1]:
                        runs[i].pop(0)
                slots.append(got)
        done = 0
        while done < times:
            n, offset = min(s[0][1] for s in slots), 0
            for s in slots:
                put(s[0][0], n, sequences, 1, offset)
                offset += s[0][0]
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
            room(capacity - offset, sequences, n)
            sequences, done = sequences + n, done + n

    # small lengths, largest first, each where it leaves least room
    for x in sorted((x for x in histogram if x <= small), reverse=True):
        left = histogram[x]
        while left:
            at = bisect_left(keys, x)
            if at == len(keys):
                n = -(-left // (capacity // x))
                room(capacity, sequences, n)
                sequences += n
                continue
            residual = keys[at]
            base, n = free[residual].pop()
            if not free[residual]:
                keys.pop(at)
            each = min(residual // x, left)
            use = min(n, left // each)
            put(x, use, base, each, capacity - residual)
            room(residual - each * x, base, use)
            room(residual, base + use, n - use)
            left -= use * each
    return rows, sequences


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast where it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Gives each piece (doc_id, piece, start, length, ids_crc32) its sequence_id and offset.

    A piece of `capacity` ids is a sequence by itself and needs no place. The others are ranked among those of their
    length by shards, one for each SHARD_ROWS pieces (SHARDS at least), so that a frequent length is no single task.
    The plan has a few rows for each of at most `capacity` lengths; it and the shards' counts are broadcast as long as
    their counted rows are few. Repeated rows are packed once each; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces)
    full, part = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    found = part.groupBy("length").agg(F.count("*").alias("n")).collect()  # fewer than `capacity` rows
    histogram = {r["length"]: r["n"] for r in found}
    shards = max(SHARDS, -(-sum(histogram.values()) // SHARD_ROWS))
    rows, sequences = plan_packing(histogram, capacity, groups)
    part = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = part.groupBy("length", "shard").count()
    base = counts.select("length", "shard", (F.sum("count").over(Window.partitionBy("length").orderBy("shard")) - F.col("count")).alias("before"))
    plan = spark.createDataFrame(rows, "length long, lo long, n long, first long, each long, at long")
    rank = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = part.withColumn("rank", rank).join(_small(base, shards * len(histogram)), ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    nth = F.col("rank") - F.col("lo")
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    placed = (
        ranked.join(_small(plan, len(rows)), "length")
        .where((nth >= 0) & (nth < F.col("n")))
        .select(
            *columns,
            (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
        )
    )
    alone = full.select(*columns, (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises whole documents and packs them into sequences of at most `capacity` ids.

    doc_id may be null or repeat: each row is packed as it is. Columns beside doc_id and text are ignored.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return best_fit_pack(token_pieces(docs, tokenizer_path, capacity), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
