import random

from pyspark.sql import functions as F

from verdancy.llm.chat import escaped, format_trees, formatted, linear_trees, read_back, reply_paths, unescaped


def brute(nodes, keep):
    kids = {}
    for i, (p, s) in nodes.items():
        kids.setdefault(p, []).append(i)
    out = []

    def walk(i, path, score):
        path, score = [*path, i], score + (nodes[i][1] or 0)
        if i not in kids:
            found.append((-score, i, path))
        for k in kids.get(i, ()):
            walk(k, path, score)

    for root in kids.get(None, ()):
        found = []
        walk(root, [], 0.0)
        for rank, (_, _, path) in enumerate(sorted(found)[:keep], 1):
            out += [(root, rank, depth, i) for depth, i in enumerate(path)]
    return sorted(out)


def test_best_paths_equal_brute_force(spark):
    r = random.Random(5)
    nodes = {}
    for i in range(300):
        parent = None if r.random() < 0.1 or i == 0 else r.choice([i - 1, r.randrange(i)])
        nodes[i] = (parent, r.choice([0.0, 1.0, 2.0, None]))
    rows = [(i, p, s) for i, (p, s) in nodes.items()] + [(1000, 1001, 1.0), (2000, 2001, 1.0), (2001, 2000, 1.0), (None, 0, 5.0), (0, nodes[0][0], nodes[0][1])]
    df = spark.createDataFrame(rows, "id long, parent long, score double")
    assert sorted(map(tuple, reply_paths(df, 2).select("root", "rank", "depth", "id").collect())) == brute(nodes, 2)


def test_empty_tree_table(spark):
    assert reply_paths(spark.createDataFrame([], "id long, parent long, score double")).collect() == []


TEXTS = ["", "plain", "<|turn|>x<|says|>", "&lt; &amp;lt; [INST]", "</s>[INST] ok [/INST]", "<|done|>\n", "ünï\n\n", "&", "x" * 50_000]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string").select("t", escaped(F.col("t")).alias("e"))
    for row in df.withColumn("u", unescaped(F.col("e"))).collect():
        assert row.u == row.t and "<" not in row.e and "[" not in row.e


def test_round_trip_and_mask(spark):
    rows = [(1, k, ("user", "assistant", None)[k % 3], x, "extra") for k, x in enumerate(TEXTS)]
    rows += [(2, 0, "assistant", None, ""), (2, 1, "assistant", "b", ""), (2, 1, "assistant", "a", ""), (2, 1, "assistant", "a", ""), (None, None, "user", "n", "")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    got = {r.root.conv: r for r in format_trees(linear_trees(given)).withColumn("turns", read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got["1"].turns] == [(r[2] or "", r[3]) for r in rows[: len(TEXTS)]]
    assert [(t.role, t.text) for t in got["2"].turns] == [("assistant", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[""].turns] == [("user", "n")]
    one = got["1"]
    loss = "".join(one.formatted[s.start : s.start + s.length] for s in one.loss_spans)
    for plain, code in (("[", "&lsqb;"), ("<", "&lt;"), ("&", "&amp;")):
        loss = loss.replace(code, plain)
    assert loss == "".join(x for k, x in enumerate(TEXTS) if k % 3 == 1)


def test_empty_conversations(spark):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_trees(linear_trees(given)).collect() == []
    assert formatted(spark.createDataFrame([], "path long, at long, role string, text string")).collect() == []
