"""Secret scans: patterns on hand-made texts, and ownership against plain counting over a small corpus."""

import hashlib
import random
from collections import defaultdict

from verdancy.llm.secrets import op13_secret_scans, ownership, places, secrets

KEY = "k9fQ2mZx71LpVb4tR8wc"  # 20 varied characters
WORD = "hunter2hunter3abcd"  # 18: live where a pattern names it elsewhere
TEXTS = [
    (1, f"api_key: '{KEY}' and more", "src0", "en"),
    (2, f"see {KEY}. It stands alone", "src0", "de"),
    (3, f"password = {WORD}", "src1", None),
    (4, f"the {WORD} again, é {WORD}", "src1", "en"),
    (5, "PASSWORD=abc token: tok3n_ Secret==aaaaaaa", "src2", "en"),
    (6, None, None, None),
    (7, "", "src3", "en"),
    (8, "mail4.example.com and a1b2c3d4e5f6/g7h8i9j0k1l2", "src3", "en"),
    (9, "AKIA" + "B" * 15 + " AKIA" + "Q7" * 9, "src4", "en"),
    (10, "f" * 23 + " " + "0a" * 14 + "g", "src4", "en"),
] + [(20 + k, "token=Ex4mpleEx4mpleAbc99 and Ex4mpleEx4mpleAbc99", f"src{k}", "en") for k in range(6)]


def test_patterns():
    assert [(p["kind"], p["start"], p["end"]) for p in places(TEXTS[4][1])] == [("assign", 13, 26), ("assign", 27, 42)]
    assert [(p["kind"], p["start"], p["end"]) for p in places(TEXTS[8][1])] == [("access", 20, 42)]
    assert [(p["kind"], p["start"], p["end"]) for p in places(TEXTS[9][1])] == [("hex", 24, 52)]
    assert places("paſsword=abcdefg toKen=abcdefg") == []
    assert [(p["kind"], p["start"]) for p in places("token: secret: abcdef1")] == [("assign", 0)]  # the first match takes the second name


def test_ownership_decides(spark):
    docs = spark.createDataFrame([(*row, 1) for row in TEXTS], "doc_id long, text string, source string, lang string, spans int")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.owners, s.repositories, s.verdict) for s in r.spans] for r in secrets(docs).collect()}
    assert len(got) == len(TEXTS)
    assert got[1] == [("assign", 0, 30, 1, 2, "live")]
    assert got[2] == [("owned", 4, 24, 1, 2, "live")]
    assert got[3] == [("assign", 0, 29, 1, 2, "live")]
    assert got[4] == [("owned", 4, 22, 1, 2, "live"), ("owned", 32, 50, 1, 2, "live")]
    assert got[6] == got[7] == got[8] == []
    assert got[20] == [("assign", 0, 25, 6, 6, "copied")]
    assert secrets(docs.limit(0)).collect() == []


def test_query_equals_plain_counting(spark, tmp_path):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789"
    values = ["".join(r.choice(letters) for _ in range(r.choice([10, 14, 18, 24]))) for _ in range(40)]
    forms = ["{}", "password={}", "token = \"{}\"", "AKIA" + "X9" * 8, "deadbeef" * 3, "plain words."]
    rows = [(k, " ".join(r.choice(forms).format(values[min(int(r.expovariate(0.1)), 39)]) for _ in range(r.randint(0, 6))), f"src{r.randrange(8)}", r.choice(["en", "de", None])) for k in range(300)]
    rows += [rows[4], (None, f"x {values[0]}", None, None), (400, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    owners, named = defaultdict(set), defaultdict(int)
    for _, text, source, _ in rows:
        for p in places(text or ""):
            owners[p["hash"]].add(source)
            named[p["hash"]] += p["kind"] != "owned"
    expected = []
    order = ["assign", "access", "hex", "owned"]
    for k, text, _, _ in rows:
        kept = [p for p in places(text or "") if p["kind"] != "owned" or (p["looks_live"] and len(owners[p["hash"]]) < 5 and (p["alone"] or named[p["hash"]]))]
        kept.sort(key=lambda p: (p["start"], order.index(p["kind"])))
        lines = [f"{p['kind']}:{p['start']}:{p['end']}" for p in kept]
        base = hashlib.sha256(",".join(x for x in lines if x[:5] != "owned").encode()).hexdigest()
        expected.append((k, *(sum(p["kind"] == kind for p in kept) for kind in order), base, ",".join(lines), sum(p["looks_live"] and len(owners[p["hash"]]) < 5 for p in kept), sum(len(owners[p["hash"]]) >= 5 for p in kept)))
    got = [tuple(x) for x in op13_secret_scans(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(row[4] for row in got) > 0 and sum(row[8] for row in got) > 0


def test_a_hash_of_many_places_is_counted_as_pairs(spark):
    found = spark.range(5000).selectExpr("'h' as hash", "cast(id % 7 as string) as owner", "struct(cast(id % 21 as string) as r) as repository", "if(id % 5 = 0, 'assign', 'owned') as kind")
    assert [tuple(x) for x in ownership(found).collect()] == [("h", 7, 21, 5000, 1000)]
