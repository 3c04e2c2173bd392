"""Toxicity by noisy-channel deobfuscation.

Spans that hold a sign, a digit or a letter twice in a row, single characters in a row, or short pieces with marks
between them become lattices of what their characters may stand for: substituted, separated, repeated or unchanged. A Viterbi search under a character trigram
model of all documents picks the likeliest reading. The restored words' features, chosen on labelled rows, score the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.storage import dropped, frugal, parts, small_batches, stored

SAMPLE = 24_000  # bound of the labelled sample
CACHE_WORDS = 150_000
COUNTED = 150_000  # features counted at a time
EVIDENCE = 24.0  # least log-likelihood ratio of a feature
PREFIXES = (3, 4, 5, 6, 7, 8)
HEAD = 3  # letters by which words without features are told early
_NONE: dict[str, float] = {}
SUBSTITUTED = 2.0  # cost of reading a character as another, in nats
DROPPED = 1.5  # cost of leaving out a repeated letter: a true double is as likely as the model says
ALPHABET = 128  # characters of the model, the commonest of all documents; the others share one
OTHER = "\ufffd"

# What a disguising character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
_SEPARATORS = ".-_*·"
_LETTER = r"[^\W\d_]"
_SIGN = r"[0-9@$!|+€]"
_ONE = rf"(?:{_LETTER}|{_SIGN})"
_WORDS = re.compile(rf"{_LETTER}+")
_RUNS = re.compile(rf"{_ONE}+")
_LEET = re.compile(_SIGN)
_TWICE = re.compile(rf"({_ONE})\1")
_JOINED = re.compile(rf"(?<!{_ONE}){_ONE}(?:[{re.escape(_SEPARATORS)}]+{_ONE}){{2,}}(?!{_ONE})")
_APART = re.compile(rf"(?<!\S){_ONE}(?:[{re.escape(_SEPARATORS)}]*\s+[{re.escape(_SEPARATORS)}]*{_ONE}){{2,}}(?!{_ONE})")
_PIECES = re.compile(rf"{_ONE}+(?:[{re.escape(_SEPARATORS)}]{_ONE}+)+")
_LEFT_OUT = re.compile(rf"[\s{re.escape(_SEPARATORS)}]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(rf"[\s0-9{re.escape(_SEPARATORS)}]*")
_COUNTED = re.compile(rf"(?:{_LETTER}|[0-9])+")
PIECE = 200  # longer disguised runs are read in pieces, none is left out


class CharModel:
    """Character trigrams with word marks: log-probabilities by additive smoothing, from counts of words.

    Digits have none, since what holds them beside letters may be disguised: an unchanged digit costs more than its substitution.
    """

    def __init__(self, counts: dict[str, int]):
        self.three: Counter = Counter()
        self.two: Counter = Counter()
        letters = set()
        for gram, n in counts.items():
            if not _DIGIT.search(gram):
                self.three[gram] += n
                self.two[gram[:2]] += n
                letters.update(gram)
        self.letters = letters
        self.size = max(2, len(letters))

    @lru_cache(maxsize=20_000)  # noqa: B019
    def __call__(self, before: str, letter: str) -> float:
        before, letter = ("".join(c if c in self.letters or c.isdigit() else OTHER for c in part) for part in (before, letter))
        return math.log((self.three.get(before + letter, 0) + 0.05) / (self.two.get(before, 0) + 0.05 * self.size))


def restored(span: str, lm: CharModel) -> str:
    """The likeliest reading of a span: a Viterbi search whose states are the last two characters read.

    Any character may be substituted, any that reads as the letter before it left out as its repetition; separators and
    white space are left out; digits may stay as they are.
    """
    beam: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    for c in span:
        if _LEFT_OUT.match(c):
            continue  # every path leaves it out
        ways = [(x, SUBSTITUTED) for x in LEET.get(c, "")]
        if c.isalnum():
            ways.append((c, 0.0))
        else:
            ways.append(("", 2 * SUBSTITUTED))
        after: dict[str, tuple[float, str]] = {}
        for state, (cost, said) in beam.items():
            for x, price in ways:
                to = state if not x else state[1] + x
                total = cost + price - (lm(state, x) if x else 0.0)
                if to not in after or total < after[to][0]:
                    after[to] = (total, said + x)
                if x and x == state[1] and (state not in after or cost + price + DROPPED < after[state][0]):
                    after[state] = (cost + price + DROPPED, said)
        beam = after
    return min(((cost - lm(state, "$"), said) for state, (cost, said) in beam.items()))[1]


class Reader:
    """Distinct restored words of a text, lower-cased. Only disguised spans have lattices of more than one path; plain words read as themselves."""

    def __init__(self, lm: CharModel, heads: set[str] | None = None):
        self.lm, self.heads = lm, heads
        self.known: dict[str, tuple[str, ...]] = {}

    def reaches(self, span: str) -> bool:
        """Whether some path of the span's lattice may begin with one of the wanted heads, or is shorter than these."""
        begun = {""}
        for c in span:
            if _LEFT_OUT.match(c):
                continue
            after: set[str] = set()
            for said in begun:
                for x in LEET.get(c, "") + (c if c.isalnum() else ""):
                    after.add(said + x)
                    if said[-1:] == x:
                        after.add(said)
                if not c.isalnum():
                    after.add(said)
            if any(len(x) == HEAD and x in self.heads for x in after):
                return True
            begun = {x for x in after if len(x) < HEAD}
            if not begun:
                return False
        return True

    def restore(self, span: str) -> Iterator[str]:
        if _NUMBER.fullmatch(span):
            return
        for at in range(0, len(span), PIECE):
            piece = span[at : at + PIECE]
            if self.heads is not None and not self.reaches(piece):
                continue
            said = restored(piece, self.lm)
            if said and said != piece:
                yield said

    def read(self, token: str) -> tuple[str, ...]:
        """The words of a token that stands between white space."""
        plain = token.rstrip(".,;:?!")
        if plain.isalpha():  # one run of letters
            return (plain, *self.restore(plain)) if _TWICE.search(plain) else (plain,)
        words = _WORDS.findall(token)
        for m in _JOINED.finditer(token):
            words += self.restore(m[0])
        for m in _PIECES.finditer(token):
            if sum(map(len, words)) > 2 and min(map(len, _RUNS.findall(m[0]))) <= 2:
                words += self.restore(m[0])
        for run in _RUNS.findall(token):
            run = run.rstrip("!")  # at a word's end this is punctuation, the other signs may be
            for span in dict.fromkeys((run, run.rstrip("!|+"), run.rstrip("!|+@$€"))):
                if _LEET.search(span) or _TWICE.search(span):
                    words += self.restore(span)
        return tuple(words)

    def token(self, token: str) -> tuple[str, ...]:
        words = self.known.get(token)
        if words is None:
            words = self.read(token)
            if len(self.known) < CACHE_WORDS:
                self.known[token] = words
        return words

    def spelt_apart(self, low: str, tokens: set[str]) -> Iterator[str]:
        """Readings of single letters in a row."""
        if any(len(t.strip(_SEPARATORS)) == 1 for t in tokens):
            for m in _APART.finditer(low):
                yield from self.restore(m[0])

    def __call__(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        tokens = set(low.split())
        words = {w for t in tokens for w in self.token(t)}
        words.update(self.spelt_apart(low, tokens))
        return words


def features_of(word: str) -> list[str]:
    return [f"{word}$", *(f"{word[:k]}" for k in PREFIXES if len(word) >= k)]


class _Grams:
    """Counts of the character trigrams of runs of letters and digits, marked as ^^run$, by code point."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.index = np.zeros(0x110000, np.int64)  # 0: not yet looked at, 1: no letter or digit, else its number
        self.letters = ["", "", "^", "$"]

    def add(self, texts: list[str | None]) -> None:
        line = np.frombuffer(" ".join(["", *((x or "").lower() for x in texts), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        new = np.unique(line[self.index[line] == 0])
        for c in map(chr, new.tolist()):
            known = _COUNTED.fullmatch(c) is not None
            self.index[ord(c)] = len(self.letters) if known else 1
            self.letters += [c] if known else []
        x = self.index[line]
        here = np.flatnonzero(x > 1)
        before = np.where(x[here - 1] > 1, x[here - 1], 2)
        first = np.where((before > 2) & (x[here - 2] > 1), x[here - 2], 2)
        last = here[x[here + 1] == 1]
        ends = np.where(x[last - 1] > 1, x[last - 1], 2)
        size = 1 << 20  # letters have numbers of 20 bits
        code = np.concatenate([(first * size + before) * size + x[here], (ends * size + x[last]) * size + 3])
        for v in pa.array(code).value_counts().to_pylist():
            self.counts[v["values"]] += v["counts"]

    def table(self) -> tuple[list[str], list[int]]:
        word = lambda c: "".join(self.letters[k] for k in (c >> 40, c >> 20 & 0xFFFFF, c & 0xFFFFF))
        return [word(c) for c in self.counts], list(self.counts.values())


def _char_counts(texts: DataFrame) -> dict[str, int]:
    """Character trigrams of all texts' runs of letters and digits, over ALPHABET characters and one for all others: no more than (ALPHABET + 3) ** 3 reach the driver."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for batch in parts(batches, 100):  # some twenty bytes a character while they are counted
            grams.add(batch.column(0).to_pylist())
        names, n = grams.table()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

    rows = texts.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = stored(rows)
    letters = rows.select(F.explode(F.split("gram", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    common = [r["c"] for r in letters.where(~F.col("c").isin("", "^", "$")).orderBy(F.desc("n"), "c").limit(ALPHABET).collect()]
    if letters.count() > ALPHABET:
        own = F.transform(F.split("gram", ""), lambda c: F.when(c.isin("", "^", "$", *common), c).otherwise(OTHER))
        rows = rows.groupBy(F.array_join(own, "").alias("gram")).agg(F.sum("n").alias("n"))
    found = dict(zip(*(c.to_pylist() for c in rows.toArrow().columns), strict=True))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with labels of the rows to learn from: crc32 of the doc_id modulo 5 isn't 0; at most SAMPLE, those that hash lowest."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")  # a repeated doc_id is learnt from once


def train(sample: DataFrame, docs: DataFrame) -> dict:
    """Character model of all docs; features with their log-odds, and a logistic calibration, from a bounded table of (text, toxic)."""
    lm = CharModel(_char_counts(docs))
    bound = sample.sparkSession.sparkContext.broadcast(lm)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Reader(bound.value), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1))], ["f", "clean", "toxic"])

        for batch in parts(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in reader(text) for f in features_of(w)}:
                    found.setdefault(f, [0, 0])[1 if toxic else 0] += 1
            if len(found) > COUNTED:
                yield out()
                found.clear()
        yield out()

    total = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    prior = (n1 + 0.5) / (n1 + n0 + 1)
    if not n1 or not n0:
        return {"lm": lm, "odds": {}, "fit": np.array([math.log(prior / (1 - prior)), 0, 0, 0])}
    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").cast("double").alias("b"), F.sum("toxic").cast("double").alias("a"))
    share = F.col("a") + F.col("b")
    part = lambda x, n: F.when(x > 0, x * F.log(x / (share * n / (n0 + n1)))).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), n1) + part(F.col("b"), n0))
    kept = rows.withColumn("g", evidence).where((F.col("g") >= EVIDENCE) & (F.col("a") * n0 > F.col("b") * n1)).orderBy(F.desc("g"), "f").collect()  # as many as a bounded sample gives evidence of
    odds = {r["f"]: math.log((r["a"] + 0.2) / (n1 + 0.4)) - math.log((r["b"] + 0.2) / (n0 + 0.4)) for r in kept}
    model = {"lm": lm, "odds": odds}
    sent = sample.sparkSession.sparkContext.broadcast(model)

    @frugal
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in parts(batches):
            seen = np.array([judge.evidence(x) for x in batch.column(0).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(seen[:, k]) for k in range(3)), pa.array(np.array(batch.column(1).to_pylist(), float))], ["x0", "x1", "x2", "y"])

    data = sample.select("text", F.col("toxic").cast("int")).mapInArrow(look, "x0 double, x1 double, x2 double, y double").toPandas().to_numpy()
    model["fit"] = _logistic(data[:, :3], data[:, 3] > 0)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Judge:
    def __init__(self, model: dict):
        self.odds, self.fit = model["odds"], model.get("fit")
        self.heads = {f[:HEAD] for f in self.odds}  # of words of three letters or more; most words share none
        self.reader = Reader(model["lm"], self.heads)
        self.known: dict[str, dict[str, float]] = {}
        self.single: set[str] = set()  # tokens of one character

    def _strong(self, words: Iterable[str]) -> dict[str, float]:
        odds, heads = self.odds, self.heads
        found = {w: max((odds[f] for f in features_of(w) if f in odds), default=0.0) for w in words if len(w) < HEAD or w[:HEAD] in heads}
        return {w: x for w, x in found.items() if x}

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Largest log-odds of a word, the sum of the four after it, and how many words have any."""
        low = (text or "").lower()
        tokens, known, found = set(low.split()), self.known, {}
        for t in tokens:
            strong = known.get(t)
            if strong is None:
                strong = self._strong(self.reader.read(t))
                if len(t.strip(_SEPARATORS)) == 1:
                    self.single.add(t)
                if len(known) < CACHE_WORDS:
                    known[t] = strong or _NONE
            if strong:
                found.update(strong)
        if not self.single.isdisjoint(tokens):
            found.update(self._strong(self.reader.spelt_apart(low, tokens)))
        strong = sorted(found.values(), reverse=True)
        return (strong[0] if strong else 0.0), sum(strong[1:5]), math.log1p(len(strong))

    def score(self, text: str | None) -> float:
        t = float(self.fit[0] + np.dot(self.fit[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, t))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts score what a text without evidence does; repeated rows are scored each; a null doc_id is not
    held out; a document labelled twice is toxic if either label says so. Without labels of both kinds every text
    scores the prior. An empty table gives an empty result. Very long texts are read whole, word by word; disguised runs
    longer than PIECE characters are restored in pieces, whose edges may read differently. Labels, language, source and
    id are no inputs of a score, and extra columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    sample = stored(labelled_sample(docs, labels))
    model = docs.sparkSession.sparkContext.broadcast(train(sample, docs))
    dropped(sample)

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model.value)
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([judge.score(x) for x in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from four fifths of the labels."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
