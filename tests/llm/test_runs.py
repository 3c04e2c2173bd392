"""Runs of words against all stretches and periods tried one by one."""

import random
import time
import zlib

import pytest

from verdancy.llm import runs as module
from verdancy.llm.runs import SquareCatcher, collapsed, op11_periodic_runs, periodic_runs


def brute(words, least=12):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            low = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            start, length = low - q, i - low + q
            said = words[start : start + length]
            if i - low >= q and length >= least and not any(all(said[k] == said[k - p] for k in range(p, length)) for p in range(1, q)):
                found.append((start, length, q))
            i += i == low
    return sorted(found)


def texts(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        words = [str(r.randrange(r.choice([1, 2, 3, 5, 40]))) for _ in range(r.randint(0, 90))]
        if words and r.random() < 0.6:
            p = r.randint(1, 30)
            for i in range(r.randrange(len(words)) + p, len(words)):
                words[i] = words[i - p] if r.random() < 0.98 else "z"
        yield words


def caught(words, stretches):
    catcher, at = SquareCatcher(), 0
    for n in stretches:
        catcher.append(words[at : at + n])
        at += n
    catcher.append(words[at:])
    return catcher.runs()


@pytest.mark.parametrize("characters", [0x110000, 3])
def test_runs_equal_brute_force(monkeypatch, characters):
    monkeypatch.setattr(module, "CHARACTERS", characters)
    for words in texts(600, characters):
        assert caught(words, []) == brute(words)


def test_stretches_of_any_size_give_the_same_runs():
    r = random.Random(4)
    for words in texts(150, 5):
        assert caught(words, [1] * len(words)) == caught(words, [r.randint(0, 9) for _ in range(12)]) == brute(words)


@pytest.mark.parametrize("words", [["a"] * 60_000, ["a", "b", "c"] * 20_000, (["a"] * 50 + ["b"]) * 1000], ids=["one word", "three words", "runs of runs"])
def test_long_periodic_texts_take_little_time(words):
    began = time.time()
    longest = max(caught(words, []), key=lambda run: run[1])
    assert longest[:2] == (0, len(words)) and time.time() - began < 10


def test_collapsed_keeps_first_periods():
    words = "x a b a b a b a b a b a b y y y y y y y y y y y y z".split()
    assert " ".join(collapsed(words, brute(words))) == "x a b y z"
    assert collapsed([], []) == []


def test_edge_cases(spark):
    line = "one two three\t"
    rows = [(1, None, 7), (2, "", 7), (3, line * 4, 7), (3, line * 4, 7), (None, "a\u00a0b " * 12, 7), (4, "w " * 11, 7), (5, " ".join(f"u{i}" for i in range(40_000)), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed[:14]) for r in periodic_runs(docs).collect()), key=str)
    assert got == [(0, [(0, 12, 1)], "a\u00a0b"), (1, [], ""), (2, [], ""), (3, [(0, 12, 3)], "one two three"), (3, [(0, 12, 3)], "one two three"), (4, [], "w w w w w w w "), (5, [], "u0 u1 u2 u3 u4")]
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query_on_planted_runs(spark, tmp_path):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 70)))) for k in range(300)] + [(None, "a " * 30), (301, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[None].period == 1
    for k, text in rows[:300]:
        words, h = text.split(), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        expected = brute(words)
        best = max(expected, key=lambda run: (run[1], -run[0], -run[2]), default=(None, None, None))
        assert (got[k].n_runs, got[k].start, got[k].length, got[k].period) == (len(expected), *best)
