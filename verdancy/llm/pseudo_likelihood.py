"""Language-model scores by masked pseudo-likelihood.

A network with a window to both sides predicts each token of a text from its neighbours, the token itself masked.
The sum of the log-probabilities is the document's score. The network knows the corpus's most frequent words; the
others fall into classes by their ending, and a word's share of its class is counted over all documents. Documents are
dealt to shards by a hash of the row, so many that each has about SHARD_CHARS characters; a copy of the network is trained
on each shard in numpy, and the copies' parameters are averaged by the number of tokens that each has seen. A small
corpus is gone over several times. Neither the order of rows nor their partitions change a score beyond its last digits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.storage import frugal, parts, small_batches, stored

WORDS = 448
ENDINGS = 64
GROUPS = 23  # the 512 tokens are predicted in two steps: a group of tokens, then the token in it
SIZE = 23
HIDDEN = 24
WINDOW = 2
BATCH = 8192
RATE = 0.1
SHARD_CHARS = 24_000_000  # of a shard's texts; a task holds their tokens, two bytes each, while it trains
TAUGHT_CHARS, MOST_ROUNDS = 72_000_000, 24  # a corpus of fewer characters is gone over again
PIECE = 500  # texts whose tokens are mixed in training
COUNTED_WORDS = 200_000
CARRIED_WORDS = 200_000  # the most frequent words' counts travel to the workers, the others' are joined
_CACHE_WORDS = 200_000


def _tokens_of() -> int:
    return WORDS + ENDINGS


def counted_words(docs: DataFrame) -> DataFrame:
    """Every word of all documents with its count; partial counts leave a task whenever they get many."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in parts(batches):
            for x in batch.column(0).to_pylist():
                found.update((x or "").split())
            if len(found) > COUNTED_WORDS:
                yield out()
                found.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counted: DataFrame) -> list[str]:
    """The WORDS most frequent words."""
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()]


def class_counts(counted: DataFrame, words: list[str]) -> tuple[DataFrame, np.ndarray, dict[str, int]]:
    """Counts of all words that stand in classes, the total of each class, and the counts of as many of these words, above a count, as are carried."""
    fixed = counted.sparkSession.createDataFrame([(w,) for w in words], "word string")
    rare = counted.join(F.broadcast(fixed), "word", "left_anti")
    totals = np.ones(ENDINGS)
    for r in rare.groupBy((F.crc32(F.right("word", F.lit(2))) % ENDINGS).alias("c")).agg(F.sum("n").alias("n")).collect():
        totals[r["c"]] = r["n"]
    least, room = None, CARRIED_WORDS
    for n, size in sorted(map(tuple, rare.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        room -= size
        if room < 0:
            break
        least = n
    carried = {} if least is None else dict(zip(*(c.to_pylist() for c in rare.where(F.col("n") >= least).toArrow().columns), strict=True))
    return rare, totals, carried


class _Ids:
    """Token ids of texts, each text with pads to both sides."""

    def __init__(self, words: list[str]):
        self.fixed = {w: i for i, w in enumerate(words)}
        self.known = dict(self.fixed)

    def _id(self, w: str) -> int:
        found = self.fixed.get(w)
        return WORDS + zlib.crc32(w[-2:].encode()) % ENDINGS if found is None else found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        known = self.known
        new = {w: self._id(w) for w in set(words).difference(known)}
        if len(known) < _CACHE_WORDS:
            known.update(new)
            new = None
        ids = map(known.__getitem__, words) if not new else (new[w] if w in new else known[w] for w in words)
        return np.fromiter(ids, np.int16, len(words))


class _Shares(_Ids):
    """Token ids of texts with the log-probabilities of words in their classes."""

    def __init__(self, words: list[str], totals: np.ndarray, carried: dict[str, int]):
        super().__init__(words)
        self.at = {w: i for i, w in enumerate([*words, *carried])}
        self.token = np.array([self._id(w) for w in self.at], np.int16)
        self.less = np.log(totals)
        self.share = np.r_[np.zeros(len(words)), np.log(np.array(list(carried.values()), float)) - self.less[self.token[len(words) :] - WORDS]]

    def __call__(self, text: str | None) -> tuple[np.ndarray, float, Counter]:
        """Ids, the sum of log-probabilities within classes as far as counts are carried, and the words whose log-count is still to be added."""
        words = (text or "").split()
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        open_ = np.flatnonzero(at < 0)
        ids = self.token[at]
        total = self.share[at[at >= 0]].sum()
        missing = Counter(words[i] for i in open_.tolist())
        if missing:
            own = {w: self._id(w) for w in missing}
            ids[open_] = [own[words[i]] for i in open_.tolist()]
            total -= self.less[ids[open_] - WORDS].sum()
        return ids, float(total), missing


class Network:
    """tanh of summed position-wise embeddings, then a softmax over groups and one over the group's tokens."""

    SHAPES = {"e": (2 * WINDOW, WORDS + ENDINGS + 1, HIDDEN), "b": (HIDDEN,), "g": (HIDDEN, GROUPS), "gb": (GROUPS,), "t": (GROUPS, HIDDEN, SIZE), "tb": (GROUPS, SIZE)}

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(11)
            self.p = {k: (rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for k, s in self.SHAPES.items()}
        else:
            self.p, at = {}, 0
            for k, s in self.SHAPES.items():
                n = int(np.prod(s))
                self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
                at += n
        self.seen = {k: np.full(s, 1e-6, np.float32) for k, s in self.SHAPES.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        e = self.p["e"]
        h = e[0][around[0]]
        for k in range(1, 2 * WINDOW):
            h += e[k][around[k]]
        h += self.p["b"]
        return np.tanh(h, out=h)

    @staticmethod
    def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An order in which each group's tokens stand together, their groups and places in it, and where groups begin."""
        order = np.argsort(target % GROUPS, kind="stable")  # neighbours in frequency are in different groups
        group, within = target[order] % GROUPS, target[order] // GROUPS
        return order, group, within, np.searchsorted(group, np.arange(GROUPS + 1))

    # logits stand in columns, so that sums over a softmax run along whole rows
    def _group_logits(self, h: np.ndarray) -> np.ndarray:
        return self.p["g"].T @ h.T + self.p["gb"][:, None]

    def _logits(self, h: np.ndarray, g: int) -> np.ndarray:
        spare = np.arange(SIZE) * GROUPS + g >= _tokens_of()
        return self.p["t"][g].T @ h.T + np.where(spare, np.float32(-1e9), self.p["tb"][g])[:, None]

    @staticmethod
    def _chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-softmax of each column at its target."""
        top = x.max(0)
        return x[at, np.arange(x.shape[1])] - top - np.log(np.exp(x - top).sum(0))

    @staticmethod
    def _error(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Softmax of each column less its one-hot target, in place."""
        x -= x.max(0)
        np.exp(x, out=x)
        x /= x.sum(0)
        x[at, np.arange(x.shape[1])] -= 1
        return x

    def log_probabilities(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        order, group, within, cut = self._by_group(target)
        h = self._hidden(around[:, order])
        found = self._chosen(self._group_logits(h), group)
        for g in range(GROUPS):
            lo, hi = cut[g], cut[g + 1]
            if lo < hi:
                found[lo:hi] += self._chosen(self._logits(h[lo:hi], g), within[lo:hi])
        out = np.empty(len(target))
        out[order] = found
        return out

    def learn(self, target: np.ndarray, around: np.ndarray) -> None:
        """One AdaGrad step on the mean negative log-probability."""
        n = len(target)
        order, group, within, cut = self._by_group(target)
        around = around[:, order]
        h = self._hidden(around)
        d = self._error(self._group_logits(h), group)
        grad = {"g": (d @ h).T, "gb": d.sum(1), "t": np.zeros(self.SHAPES["t"], np.float32), "tb": np.zeros(self.SHAPES["tb"], np.float32)}
        back = d.T @ self.p["g"].T
        for g in range(GROUPS):
            lo, hi = cut[g], cut[g + 1]
            if lo < hi:
                q = self._error(self._logits(h[lo:hi], g), within[lo:hi])
                grad["t"][g], grad["tb"][g] = (q @ h[lo:hi]).T, q.sum(1)
                back[lo:hi] += q.T @ self.p["t"][g].T
        back *= 1 - h * h
        grad["b"] = back.sum(0)
        grad["e"] = np.zeros(self.SHAPES["e"], np.float32)
        for k in range(2 * WINDOW):
            o = np.argsort(around[k], kind="stable")
            line = around[k][o]
            first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            grad["e"][k][line[first]] = np.add.reduceat(back[o], first, axis=0)
        for k, x in grad.items():
            x = x * np.float32(1 / n)
            self.seen[k] += x * x
            x /= np.sqrt(self.seen[k])
            self.p[k] -= np.float32(RATE) * x


def _windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Targets and, for each place of the window, the tokens there; the pad stands between texts."""
    pad = np.full(WINDOW, _tokens_of(), np.int16)
    line = np.concatenate([x for t in texts for x in (t, pad)] or [pad])
    line = np.concatenate([pad, line])
    at = np.flatnonzero(line != _tokens_of())
    return line[at], np.stack([line[at + k] for k in (*range(-WINDOW, 0), *range(1, WINDOW + 1))])


def dealt(docs: DataFrame, chars: int) -> DataFrame:
    """shard, lot (the order in it), rounds (over the corpus) and text of all rows."""
    shards = -(-chars // SHARD_CHARS) or 1
    rounds = min(MOST_ROUNDS, max(1, TAUGHT_CHARS // max(chars, 1)))
    lot = F.xxhash64(F.col("doc_id").cast("string"), "text")
    return docs.select(F.pmod(lot, F.lit(shards)).cast("int").alias("shard"), lot.alias("lot"), F.lit(rounds).alias("rounds"), "text")


def train(docs: DataFrame, words: list[str]) -> np.ndarray:
    """Parameters averaged over the networks of the shards of dealt(), weighted by tokens; every document is seen by one of them, in an order of hashes. Only token ids move."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    @frugal
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(known.value)
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([ids(x).tobytes() for x in batch.column(3).to_pylist()], pa.binary())], ["shard", "lot", "rounds", "ids"])

    @frugal
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rounds, held = None, 1, []
        for batch in batches:
            for own, again, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != shard:  # shards come one after another
                    yield from taught(shard, rounds, held)
                    shard, rounds, held = own, again, []
                held.append(np.frombuffer(ids, np.int16))
        yield from taught(shard, rounds, held)

    def taught(shard: int | None, rounds: int, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not texts:
            return
        net, order, n = Network(), np.random.default_rng(shard), sum(map(len, texts))
        for _ in range(rounds):
            for top in range(0, len(texts), PIECE):
                target, around = _windows(texts[top : top + PIECE])
                mixed = order.permutation(len(target))
                for at in range(0, len(target), BATCH):
                    own = mixed[at : at + BATCH]
                    net.learn(target[own], around[:, own])
        flat = np.r_[net.flat().astype(float) * n, n]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), shard, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["shard", "i", "x"])

    by_shard = docs.select("shard", "lot", "rounds", "text").mapInArrow(numbers, "shard int, lot long, rounds int, ids binary")
    by_shard = by_shard.repartition("shard").sortWithinPartitions("shard", "lot", "ids").select("shard", "rounds", "ids")
    copies = by_shard.mapInArrow(fit, "shard int, i int, x double")  # a row for each parameter and shard
    # added up as decimals, partial sums first, so that the last digits don't depend on tasks either
    sums = copies.groupBy("i").agg(F.sum(F.col("x").cast("decimal(28,10)")).cast("double").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    return (sums[:-1] / sums[-1]).astype(np.float32) if len(sums) and sums[-1] else Network().flat()


def pseudo_likelihoods(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, log_likelihood (summed), mean_log_likelihood.

    A word that the network doesn't know by itself has the probability of its class, times its share of the class in
    the counts of all documents. Null and empty texts have no tokens, a sum of 0 and no mean. Repeated rows are scored
    each; whole texts are read, however long. An empty table gives an empty result. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    counted = stored(counted_words(docs))
    words = frequent_words(counted)
    words += [f"\x00{k}" for k in range(WORDS - len(words))]  # a small corpus leaves places that no word takes
    rare, totals, carried = class_counts(counted, words)
    chars = counted.agg(F.sum(F.col("n") * (F.length("word") + 1))).first()[0] or 0
    model = docs.sparkSession.sparkContext.broadcast((words, totals, carried, train(dealt(docs, chars), words)))

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals, carried, flat = model.value
        shares, net, row = _Shares(words, totals, carried), Network(flat), TaskContext.get().partitionId() << 40
        for batch in parts(batches):
            texts, within, missing = zip(*map(shares, batch.column(1).to_pylist()), strict=True)
            sizes = np.array([len(t) for t in texts], np.int64)
            target, around = _windows(texts)
            found = [net.log_probabilities(target[at : at + BATCH], around[:, at : at + BATCH]) for at in range(0, len(target), BATCH)]
            each = np.r_[0.0, np.cumsum(np.concatenate(found).astype(float))] if found else np.zeros(1)
            ends = np.cumsum(sizes)
            rows = np.arange(row, row := row + len(texts), dtype=np.int64)
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()))
            left = [pa.array([list(x) for x in part], kind) for part, kind in zip((missing, [m.values() for m in missing]), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(sizes), pa.array(each[ends] - each[ends - sizes] + np.array(within)), *left], ["row", "doc_id", "n_tokens", "known", "word", "times"])

    scored = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "row long, doc_id long, n_tokens long, known double, word array<string>, times array<int>"))
    left = scored.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    added = left.join(rare, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("added"))
    out = scored.select("row", "doc_id", "n_tokens", "known").join(added, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("added", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of all documents under a network trained on all of them."""
    return pseudo_likelihoods(spark.read.parquet(f"{sf_dir}/documents.parquet"))
