"""Queries that SQL can express beside their SQL: on the given tables, and on small tables with planted cases."""

import os
import random

import duckdb
import pytest

from verdancy.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compared(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet{'/*.parquet' * os.path.isdir(f'{sf_dir}/{t}.parquet')}'")
    df = registry.queries()[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    expected = con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    return got


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compared(spark, name, SF)


def planted(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs, items = [(1, None), (2, ""), (3, "alone"), (4, "alone"), (5, "ALONE")], [(1, None), (2, "Lone item"), (3, " ".join(words[:14])), (4, "w7")]
    for i in range(6, 90, 3):
        text = [r.choice(words) for _ in range(r.randint(11, 60))]
        near = [w if r.random() > 0.06 else r.choice(words) for w in text]
        docs += [(i, " ".join(text)), (i + 1, " ".join(near)), (i + 2, " ".join(near).upper())]
    docs += [(100, "é" + " ".join(words[2:13]) + " tail"), (101, "a lone, ITEM here"), (102, " ".join(words[:9]))]
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = [(i, [x + r.gauss(0, 0.28) for x in base[i % 12]]) for i in range(120)]
    vectors += [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [None] + [1.0] * 15), (204, []), (205, vectors[3][1]), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    return docs, items, vectors


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, items, vectors = planted()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_planted_near_duplicates(spark, tables):
    assert any(not kept for *_, kept in compared(spark, "op1_minhash_near_dedup", tables))


def test_planted_windows(spark, tables):
    assert {row[0] for row in compared(spark, "op3_benchmark_decontamination", tables) if row[5]} >= {100, 101}


def test_planted_vectors(spark, tables):
    assert max(n for _, n, *_ in compared(spark, "op8_embedding_near_dedup", tables)) > 3
