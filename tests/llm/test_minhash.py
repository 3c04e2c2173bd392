import random

import pytest

from verdancy.llm.minhash import near_duplicates
from verdancy.llm.salted import with_smallest

DOCS = "doc_id long, text string, class string, key long, home string, component long"


def brute(rows, width, percent):
    texts = {}
    for i, x in rows:
        if i is not None:
            texts[i] = max(texts.get(i, x or ""), x or "", key=lambda t: (len(shingles(t, width)), t))
    sets = {i: shingles(x, width) for i, x in texts.items()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def shingles(text, width):
    w = text.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def texts():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base[:8]:
        for changes in (1, 2, 4, 6, 9):
            c = list(b)
            for _ in range(changes):
                c[r.randrange(60)] = r.choice(words)
            out.append(" ".join(c))
    chain = list(base[8])
    for _ in range(10):  # neighbours are alike, the ends are not
        chain[r.randrange(60)] = r.choice(words)
        out.append(" ".join(chain))
    shared = [r.choice(words) for _ in range(60)]
    for _ in range(300):  # one large group around a common text, its members changed by differing amounts
        c = list(shared)
        for _ in range(r.choice((1, 2, 3, 5, 8))):
            c[r.randrange(60)] = r.choice(words)
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, width):
    rows = [(i, x) for i, x in enumerate(texts())] + [(900, "ONE two"), (901, "one TWO"), (902, "one"), (903, "One"), (904, ""), (905, None), (906, " \t\n"), (907, "É x"), (908, "é x")]
    got = near_duplicates(spark.createDataFrame([(i, x, "c", 1, "h", 2) for i, x in rows], DOCS), width=width).collect()
    expected = brute(rows, width, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_extremes(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(None, "a b c", "", 0, "", 0), (None, None, "", 0, "", 0), (1, "a b c", None, None, None, None), (1, "a b c", "", 0, "", 0), (2, "a b c", "", 0, "", 0), (7, long, "", 0, "", 0), (5, long, "", 0, "", 0)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, DOCS), width=2).collect(), key=str)
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {i: r.component_id for i, r in named.items()} == {1: 1, 2: 1, 5: 5, 7: 5}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)] * 2
    assert named[5].n_shingles == 29_999


def test_repeated_ids_count_by_one_text(spark):
    """Of a repeated doc_id the text with most shingles counts, wherever it stands in string order."""
    letters = "a b c d e f g h i j"
    rows = [(1, letters), (1, "zz yy"), (2, letters + " k"), (3, "zz yy"), (4, None), (4, "q r s"), (5, "q r s"), (6, letters), (6, "z " + letters)]
    table = spark.createDataFrame([(i, x, "c", 1, "h", 2) for i, x in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table.repartition(5), width=2).collect()}
    assert got == brute(rows, 2, 80)
    assert got[1] == (9, 1) and got[2] == (10, 1) and got[3] == (1, 3) and got[5] == (2, 4)


def test_frequent_key_meets_its_smallest_by_salts(spark):
    rows = [("k", i) for i in range(5_000, 0, -1)] + [("other", 7), (None, 3), ("k", None)]
    more = spark.createDataFrame([(1, "one")], "first long, said string")
    got = with_smallest(spark.createDataFrame(rows, "key string, value long"), "key", "value", "first", 200_000, more).collect()
    assert len(got) == len(rows)
    assert {(r.key, r.first, r.said) for r in got if r.value} == {("k", 1, "one"), ("other", 7, None), (None, None, None)}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
