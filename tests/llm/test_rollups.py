"""Rollups whose commits break off, and the query's three batches against plain counting."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from verdancy.llm.rollups import Rollup, op5_token_rollups
from verdancy.sources.commits import Batches

CHANGES = "source string, lang string, tokenizer string, docs long, tokens long"


def test_a_killed_second_commit_loses_nothing(spark, tmp_path, monkeypatch):
    rollup = Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("s", "en", "v", 1, 10), ("s", None, "v", 1, 5)], CHANGES)
    rollup.commit("a", one)
    before = sorted(map(str, rollup.totals().collect()))
    lost = one.withColumn("tokens", F.when(F.col("tokens") > 5, F.raise_error(F.lit("lost")).cast("long")).otherwise(1))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("a", lost)
    monkeypatch.setattr(Batches, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    for name in ("a", "b"):
        with pytest.raises(RuntimeError, match="killed"):
            rollup.commit(name, one)
    monkeypatch.undo()
    assert sorted(map(str, rollup.totals().collect())) == before
    rollup.commit("a", one)
    rollup.commit("b/=%", one)
    assert {r.docs for r in rollup.totals().collect()} == {2}
    with pytest.raises(ValueError, match="name"):
        rollup.commit("", one)


def test_query_equals_plain_counting(spark, tmp_path):
    rows = [(1, "a b c", "en", "s"), (2, "a b c", "de", "t"), (3, None, "en", "s"), (4, "", None, None), (5, "une phrase", "fr", "t"), (6, "une phrase", "fr", "t"), (6, "une phrase", "fr", "t"), (7, "x " * 30_000, "en", "s"), (None, "a b c", "en", "s")]
    spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = lambda t: len(tk.encode(t or "", add_special_tokens=False).ids)
    first = {}
    for k, text, *_ in rows:
        if k is not None:
            first[text or ""] = min(first.get(text or "", k), k)
    docs, tokens = Counter(), Counter()
    for k, text, lang, source in rows:
        if k is None or first[text or ""] == k:
            docs[source, lang] += 1
            tokens[source, lang] += n(text) + 1
    got = {(r.source, r.lang): (r.tokenizer, r.docs, r.tokens) for r in op5_token_rollups(spark, str(tmp_path)).collect()}
    assert got == {key: ("word_bpe_49k+end", docs[key], tokens[key]) for key in docs}
