"""The pipeline on a small corpus: each stage's decisions, and what comes out at the end."""

import random

import pytest

import corpus_pipeline
from verdancy.llm.minhash import near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars int, rejected_id string"
WORDS = "the of and river stone walks under bright field slow rain garden green open small tree with from near light".split()


@pytest.fixture(scope="module")
def made():
    r = random.Random(11)
    text = lambda n: " ".join(r.choice(WORDS[: 6 if r.random() < 0.4 else None]) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        words = text(r.randint(40, 90)).split()
        if i % 7 == 3:
            words = [f"{w.upper()}!!{k}" for k, w in enumerate(words)]
        elif i % 5 == 1:
            words[r.randrange(len(words))] = r.choice(["scoundrel", "sc0undrel", "scooooundrel"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 7 != 3), int(i % 7 != 3 and i % 5 == 1)))
    clean = [i for i, q, t in labels if q and not t]
    item = text(14)
    near = rows[clean[0]][1].split()
    near[5] = "stone" if near[5] != "stone" else "river"
    rows += [(1000, rows[clean[0]][1]), (1001, rows[clean[1]][1]), (1002, f"{text(30)} {item} {text(30)}"), (1003, None), (1004, ""), (1005, text(6000)), (None, text(50)), (1006, "river stone"), (1006, text(60))]
    return [(i, t, "en", "s", 0, "x") for i, t in rows], labels, item, clean


def test_stages_and_run(spark, tmp_path, made):
    rows, labels, item, clean = made
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept[-1], folder).write.parquet(f"{folder}/stage{k}")
        kept.append(spark.read.parquet(f"{folder}/stage{k}"))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in d.collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    junk, toxic = {i for i, q, _ in labels if not q}, {i for i, _, t in labels if t}
    assert len(ids[1] & junk) <= 0.05 * len(junk) and len(ids[2] & toxic) <= 0.05 * len(toxic)
    assert len(ids[4] & set(clean)) >= 0.95 * len(clean)
    assert 1000 not in ids[3] or clean[0] not in ids[3]
    assert {r.doc_id for r in near_duplicates(kept[2]).collect() if r.kept} == ids[3] - {None}
    assert (1002 in ids[3]) and (1002 not in ids[4]) and {1003, 1004, 1005, None} <= ids[4]
    assert [len(r.text) > 20 for r in kept[4].where("doc_id = 1006").collect()] == [True]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece) for r in packed if r.piece == 0 and r.doc_id is not None) == sorted((i, 0) for i in ids[4] if i is not None)
    by = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and sum(r.length for r in packed if r.doc_id == 1005) > 4096
