import hashlib
import re

from verdancy.llm.decontamination import contamination

DOCS = "doc_id long, text string, row string, ws string, item_id string"
ITEMS = "item_id long, text string, window string"


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), x or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, x in items:
        t = words(x)
        for k in range(max(1, len(t) - 9)) if t else ():
            part = t[k : k + 10]
            for at in range(len(w) - len(part) + 1):
                if w[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_equals_brute_force(spark):
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(1, f"{ten} lambda mu"), (2, "Short Item"), (3, "word"), (4, None), (5, "..."), (10, f"{ten} lambda mu"), (11, "Éa éa x"), (None, "nameless item here")]
    docs = [
        (1, f"start {ten.upper()} lambda, mu end"), (2, f"x {ten}"), (3, "short   item; short item"), (4, "word word sword"), (5, None), (6, ""), (7, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (8, " ".join([ten, "lambda mu"] * 400)), (9, "éa éa x éA"), (10, "Éa éa X"), (None, "short item"), (1, "short item"), (12, "short"), (13, "word"), (14, "a nameless item here"), (15, "Short Item" * 3),
    ]
    got = contamination(spark.createDataFrame([(i, x, "r", "w", "i") for i, x in docs], DOCS), spark.createDataFrame([(i, x, "w") for i, x in items], ITEMS)).collect()
    expected = sorted(((i, *brute(x, items)) for i, x in docs), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == expected


def test_no_broadcast_gives_the_same(spark, monkeypatch):
    from verdancy.llm import decontamination

    docs = spark.createDataFrame([(k, f"a b c d e f g h i j k{k} one two", "", "", "") for k in range(20)], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f g h i j", ""), (2, "one two", "")], ITEMS)
    small = sorted(map(tuple, contamination(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, contamination(docs, items).collect())) == small
    assert {r[2] for r in small} == {12}


def test_empty_tables(spark):
    none = hashlib.sha256(b"").hexdigest()
    docs, items = spark.createDataFrame([(1, "a b", "", "", "")], DOCS), spark.createDataFrame([(1, "a b", "")], ITEMS)
    assert tuple(contamination(docs, items.limit(0)).first()) == (1, 2, 0, 0, none, False)
    assert contamination(docs.limit(0), items).collect() == []
