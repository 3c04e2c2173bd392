"""Maximal periodic runs of words, found online by catchers over blocks of each power of two.

A square is a stretch of words said twice in a row. When a block of B words is completed, it catches the squares of
periods 2B - 1 to 4B - 2: the second half of such a square holds a completed block of B words, and the same words stand
one period before it. Each earlier occurrence at such a distance opens a suffix comparison, which goes back as far as
words agree with those a period before, and forward with every word that is appended. A comparison as long as its
period is a square; as it goes on, its squares merge into one run. Blocks deep inside a run of a shorter period find
only that period's multiples there, so they are looked up before it only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.storage import frugal, parts, small_batches

LEAST = 12
CHARACTERS = 0x110000
_WORD = re.compile(r"[^ \t-\r]+")
RUNS = "array<struct<start:long,length:long,period:long>>"


def _find(words: Sequence, block: Sequence, low: int, high: int) -> int:
    """The first place from low where block stands and ends by high, or -1."""
    if isinstance(words, str):
        return words.find(block, low, high)
    for i in range(low, high - len(block) + 1):
        if words[i : i + len(block)] == block:
            return i
    return -1


class SquareCatcher:
    """Runs of the words appended so far.

    Words are kept as one character each while there are few enough different ones, else as numbers. `least` is the
    least length of a run; periods p are reported from a length of max(least, 2p).
    """

    def __init__(self, least: int = LEAST):
        self.least = least
        self.numbers: dict[str, int] = {}
        self.words: Sequence = ""
        self.open: dict[int, tuple[int, int]] = {}  # period: places [low, high) whose words equal those a period before; high is the end
        self.reached: dict[int, int] = {}  # period: end of the last comparison
        self.closed: list[tuple[int, int, int]] = []  # (start, end, period) of runs that have ended

    def append(self, words: Sequence[str]) -> None:
        """Appends words, one or many: comparisons go on over them, then the blocks that they complete are caught."""
        before = len(self.words)
        number = self.numbers
        for w in words:
            number.setdefault(w, len(number))
        if isinstance(self.words, str) and len(number) <= CHARACTERS:
            letter = {w: chr(number[w]) for w in set(words)}
            self.words += "".join(map(letter.__getitem__, words))
        else:
            if isinstance(self.words, str):
                self.words = list(map(ord, self.words))
            self.words += [number[w] for w in words]
        n = len(self.words)
        for period, (low, high) in list(self.open.items()):
            self._settle(period, low, self._forward(high, period))
        size = 2
        while 2 * size <= n:
            self._catch(size, before // size + 1, n // size)
            size *= 2

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period."""
        found = self.closed + [run for period, (low, high) in self.open.items() if (run := self._run(low, high, period))]
        return sorted((low, high - low, period) for low, high, period in found)

    def _catch(self, size: int, first: int, last: int) -> None:
        """Looks up the completed blocks first to last of `size` words at their distances; blocks of two words also those below."""
        nearest, farthest = (1 if size == 2 else 2 * size - 1), 4 * size - 2
        deep = self._deep(size)
        at_deep = 0
        words = self.words
        for end in range(first * size, last * size + 1, size):
            start = end - size
            low, high = max(0, start - farthest), end - nearest
            while at_deep < len(deep) and deep[at_deep][1] < end:
                at_deep += 1
            if at_deep < len(deep) and deep[at_deep][0] <= start:
                high = min(high, deep[at_deep][0] + size - 1)
            if high - low < size:
                continue
            block = words[start:end]
            at = _find(words, block, low, high)
            while at >= 0:
                period = start - at
                if self.reached.get(period, 0) <= start:
                    self._settle(period, self._back(start, period), self._forward(end, period))
                at = _find(words, block, at + 1, high)

    def _deep(self, size: int) -> list[tuple[int, int]]:
        """Long runs of periods up to `size`: what a block inside one equals inside it lies at a multiple of the run's period. Two of them overlap by less than two blocks."""
        found = self.closed + [(low - period, high, period) for period, (low, high) in self.open.items()]
        return sorted((low, high) for low, high, period in found if period <= size and high - low >= 5 * size - 2)

    def _settle(self, period: int, low: int, high: int) -> None:
        """Keeps a comparison over [low, high): open at the end of the words, else a run or nothing."""
        self.reached[period] = high
        if high == len(self.words):
            self.open[period] = (low, high)
            return
        self.open.pop(period, None)
        if run := self._run(low, high, period):
            self.closed.append(run)

    def _run(self, low: int, high: int, period: int) -> tuple[int, int, int] | None:
        """The run of a comparison, if it holds a square, is long enough and has no shorter period."""
        start = low - period
        if high - low < period or high - start < self.least:
            return None
        root = self.words[start:low]
        return (start, high, period) if _find(root + root, root, 1, 2 * period) == period else None

    def _forward(self, at: int, period: int) -> int:
        """The first place from `at` whose word isn't that of a period before: stretches double, then halve."""
        words, n, step = self.words, len(self.words), 4
        while at < n and words[at : at + step] == words[at - period : at - period + min(step, n - at)]:
            at, step = at + step, 2 * step
        if at >= n:
            return n
        while step:
            if at + step <= n and words[at : at + step] == words[at - period : at - period + step]:
                at += step
            step //= 2
        return at

    def _back(self, at: int, period: int) -> int:
        """The first place of the stretch before `at` whose words are those of a period before."""
        words, step = self.words, 4
        while at - step >= period and words[at - step : at] == words[at - step - period : at - period]:
            at, step = at - step, 2 * step
        while step:
            if at - step >= period and words[at - step : at] == words[at - step - period : at - period]:
                at -= step
            step //= 2
        return at


def collapsed(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words left when each run keeps its first period only."""
    kept, at = [], 0
    for start, end in sorted((start + period, start + length) for start, length, period in runs):
        if end > at:
            kept += words[at : max(start, at)]
            at = end
    return kept + list(words[at:])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length and period in words, by start, then period), collapsed (the text with each run cut to its first period, words joined by one space).

    Words are parted at blanks and \\t to \\r only. A null or empty text has no runs and collapses to the empty text; a
    very long one is read whole, at C speed and in memory of a few times its size. Repeated rows and rows without a
    doc_id are judged each; an empty table gives an empty result; extra columns are ignored.
    """

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found, left = [], []
            for text in batch.column(1).to_pylist():
                words = _WORD.findall(text or "")
                catcher = SquareCatcher(least)
                catcher.append(words)
                runs = catcher.runs()
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                left.append(" ".join(collapsed(words, runs)))
            run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(run)), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, f"doc_id long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id as text) is divisible by ten, the words from place a on repeat the first p of them: a and p follow the rest of the hash."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    told = hashed.where("h % 10 = 0").withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))").cast("long"))
    again: Column = F.expr("transform(sequence(0, n - 1), i -> words[cast(if(i >= a, a + (i - a) % p, i) as int)])")
    told = told.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.lit("")).alias("text"))
    return told.union(hashed.where("h is null or h % 10 <> 0").select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which have planted ones."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs from all pairs of equal words: stretches of places whose words equal those a period before, without those that a shorter period covers.
OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id::BIGINT AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ord(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) AS h
  FROM documents
), placed AS (
  SELECT *, row_number() OVER () AS rid, len(ws)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM hashed
), docs AS (
  SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END + 1]) END AS ws
  FROM placed
), words AS (
  SELECT rid, unnest(ws) AS w, unnest(range(n)) AS i FROM docs
), pairs AS (
  SELECT x.rid AS rid, y.i - x.i AS q, y.i AS i FROM words x JOIN words y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i
), stretches AS (
  SELECT rid, q, min(i) AS low, count(*)::BIGINT AS m
  FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM pairs) GROUP BY rid, q, g
), squares AS (
  SELECT rid, q AS period, low - q AS start, m + q AS length FROM stretches WHERE m >= q AND m + q >= 12
), runs AS (
  SELECT * FROM squares s WHERE NOT EXISTS (
    SELECT 1 FROM squares t WHERE t.rid = s.rid AND t.period < s.period AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), told AS (
  SELECT rid, count(*)::BIGINT AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY rid
), dropped AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS left_text FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_text, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
