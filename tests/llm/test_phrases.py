"""Phrase collocations: filters against plain dictionaries, results against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from verdancy.llm.phrases import QuotientFilter, collocations, ids_of, keys, permuted, prints, restored, tokens


def filled(seed, width, n, skip=0, of_range=0, most=400):
    r = np.random.default_rng(seed)
    high, low = (r.integers(0, 1 << min(width - s, 62), n, np.uint64) for s in (skip, 0))
    high |= np.uint64(of_range) << np.uint64(width - skip)
    again = r.integers(0, n, n)
    return high[again], low[again], r.integers(1, most, n)


@pytest.mark.parametrize("width", [5, 17, 32, 34, 62])
def test_permutation_is_invertible(width):
    high, low, _ = filled(1, width, 500)
    a, b = permuted(high, low, width)
    assert (a >> np.uint64(width) == 0).all() and (b >> np.uint64(width) == 0).all()
    back = restored(a, b, width)
    assert (back[0] == high).all() and (back[1] == low).all()
    assert len(set(zip(a.tolist(), b.tolist()))) == len(set(zip(high.tolist(), low.tolist())))


@pytest.mark.parametrize(("width", "skip"), [(4, 2), (17, 6), (32, 8), (34, 6), (62, 16)])
def test_filters_lose_nothing(width, skip):
    plain, filters = Counter(), []
    for seed in range(4):
        high, low, counts = filled(seed, width, 1 + 300 * seed, skip, 1)
        for h, lo, c in zip(high.tolist(), low.tolist(), counts.tolist()):
            plain[h, lo] += c
        filters.append(QuotientFilter.unpacked(QuotientFilter.of(high, low, counts, width, skip).packed(), width, skip, 1))
    merged = QuotientFilter.unpacked(QuotientFilter.merged(filters).packed(), width, skip, 1)
    got = list(zip(merged.high.tolist(), merged.low.tolist()))
    assert got == sorted(plain) and dict(zip(got, merged.counts.tolist())) == plain


def test_ranges_cut_a_filter():
    high, low, counts = filled(3, 12, 900)
    whole = QuotientFilter.of(high, low, counts, 12, 0)
    cut = [QuotientFilter.unpacked(f.packed(), 12, 5, r) for r, f in whole.ranges(5)]
    assert np.concatenate([f.high for f in cut]).tolist() == whole.high.tolist() and np.concatenate([f.counts for f in cut]).tolist() == whole.counts.tolist()


def test_packed_filters_are_compact():
    high, low, _ = filled(5, 17, 40_000, 6, 3)
    f = QuotientFilter.of(high, low, np.ones(len(high), np.int64), 17, 6)
    assert len(f.packed()) < 5 * len(f.high)  # 34 bits of key and a counter


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 17), (4, 16), (4, 31)])
def test_keys_give_their_words_back(n, bits):
    ids = np.random.default_rng(n).integers(1, min(1 << bits, 1 << 31) - 1, 50).astype(np.int32)
    high, low, width = keys(ids, n, bits)
    back = ids_of(*restored(*permuted(high, low, width), width), n, bits)
    assert back.tolist() == [ids[i : i + n].tolist() for i in range(51 - n)]
    assert prints(high, low, 20).max() < 1 << 20


def plain_collocations(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * counts[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:first])]
    return sorted(out)


def corpus(seed=2):
    r = random.Random(seed)
    words = ["the", "of", "été", "NEW", "york", "a", "b c", "x\x01", "ß", "York", *[f"w{i}" for i in range(30)]]
    rows = [(None, None), ("en", ""), ("en", ". , ;"), ("", "the of the of")]
    for _ in range(400):
        said = []
        for _ in range(r.randint(0, 40)):
            said.append(r.choice(["new york city", "in the end of", "w1 w1 w1 w1 w1", "as well as"]) if r.random() < 0.2 else words[min(int(r.expovariate(0.15)), len(words) - 1)])
            said.append(r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!\r\n", " "]))
        rows.append((r.choice(["en", "en", "de", None]), "".join(said)))
    return rows + rows[10:14]


@pytest.mark.parametrize("broadcast_words", [1000, 0], ids=["broadcast", "joined"])
def test_results_equal_plain_counting(spark, broadcast_words):
    rows = corpus()
    docs = spark.createDataFrame([(*row, 1, 2) for row in rows], "lang string, text string, n int, ids int").repartition(5)
    got = sorted(tuple(x) for x in collocations(docs, least=5, first=40, broadcast_words=broadcast_words).collect())
    expected = plain_collocations(rows, 5, 40)
    assert got == expected and max(row[1] for row in got) == 40 and {len(row[2].split(" ")) for row in got} == {2, 3, 4}


def test_nothing_frequent_is_an_empty_result(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert collocations(docs).collect() == [] and collocations(docs.limit(0)).collect() == []


def test_tokens():
    assert [w for w in tokens("ÄB Cd.e,\tF") if w] == ["Äb".encode(), b"cd", b".", b"e", b".", b"f"] and tokens(None) == [b""]
