"""Quality, toxicity, pseudo-likelihood and token rollups."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdancy.llm.pseudo_likelihood import BATCH, Network, _Ids, _windows, pseudo_likelihoods
from verdancy.llm.quality import quality
from verdancy.llm.rollups import Rollup, signed, token_counts
from verdancy.llm.toxicity import CharModel, Reader, toxicity

DOCS = "doc_id long, text string, lang string, source string, kept string, score string, n_words string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "the of and river stone walks under bright field slow rain garden green open small tree with from near light".split()


def corpus(n=400, seed=2):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(WORDS[: 5 if r.random() < 0.4 else None]) for _ in range(r.randint(30, 80))]
        junk, toxic = i % 7 == 3, i % 5 == 1
        if toxic:
            words[r.randrange(len(words))] = r.choice(["scoundrel", "sc0undrel", "s c o u n d r e l", "scooooundrel", "dunce"])
        if junk:
            words = [f"{w.upper()}!!{k}" for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en" if i % 3 else None, "s", "k", "x", "n"))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


EDGES = [(9000, None, "en", "s", "", "", ""), (9001, "", None, None, None, None, None), (9002, "word " * 60_000, "xx", "s", "", "", ""), (None, "the of river", "en", "s", "", "", ""), (1, "the of", "en", "s", "", "", "")]


def test_quality_separates_and_handles_edges(spark):
    rows, labels = corpus()
    got = quality(spark.createDataFrame(rows + EDGES, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], LABELS)).collect()
    assert len(got) == len(rows) + len(EDGES)
    by = {r.doc_id: r for r in got}
    junk = [by[i].kept for i, q, _ in labels if not q]
    clean = [by[i].kept for i, q, _ in labels if q and i != 1]
    assert sum(junk) <= 0.05 * len(junk) and sum(clean) >= 0.95 * len(clean)
    assert by[9000].kept and by[9001].kept and by[9000].n_words == 0 and by[9002].n_words == 60_000
    assert {r.doc_id for r in got if r.doc_id is None} == {None}


def test_quality_without_labels_or_rows(spark):
    rows, labels = corpus(20)
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    assert all(r.kept for r in quality(docs, none).collect())
    assert quality(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_restored_readings():
    counts = {}
    for w in ("loser", "idiot", "stupid", "river", "been"):
        for i in range(len(w) + 1):
            counts[f"^^{w}$"[i : i + 3]] = counts.get(f"^^{w}$"[i : i + 3], 0) + 5
    reader = Reader(CharModel(counts))
    for text, word in (("a l0ser", "loser"), ("you i.d.i.o.t", "idiot"), ("l o s e r", "loser"), ("$tup1d!", "stupid"), ("looooser", "loser"), ("RIVER", "river"), ("been", "been")):
        assert word in reader(text)
    assert reader(None) == reader("") == set()
    assert len(max(reader("a" * 100_000), key=len)) == 100_000


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus(600)
    got = toxicity(spark.createDataFrame(rows + EDGES, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], LABELS)).collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: t for i, q, t in labels if q and i != 1}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (9000, 9001, None))


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = corpus(20)
    docs = spark.createDataFrame(rows, DOCS)
    assert len({r.score for r in toxicity(docs, spark.createDataFrame([], LABELS)).collect()}) == 1
    assert toxicity(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_network_gradient_and_normalisation():
    net, r = Network(), np.random.default_rng(0)
    around = r.integers(0, 513, (4, 1)).astype(np.int16)
    everything = np.arange(512, dtype=np.int16)
    assert np.isclose(np.exp(net.log_probabilities(everything, np.repeat(around, 512, 1))).sum(), 1, atol=1e-5)
    target, around = r.integers(0, 8, 4000).astype(np.int16), r.integers(0, 8, (4, 4000)).astype(np.int16)
    around[1] = target  # the left neighbour tells the token
    before = net.log_probabilities(target, around).mean()
    for _ in range(60):
        net.learn(target, around)
    assert net.log_probabilities(target, around).mean() > before + 3


def test_pseudo_likelihoods_of_edges(spark):
    rows, _ = corpus(60)
    got = pseudo_likelihoods(spark.createDataFrame(rows + EDGES, DOCS).repartition(3)).collect()
    assert len(got) == len(rows) + len(EDGES)
    by = {r.doc_id: r for r in got if r.doc_id != 1}
    assert by[9000].n_tokens == 0 and by[9000].log_likelihood == 0 and by[9000].mean_log_likelihood is None
    assert by[9002].n_tokens == 60_000 and all(r.log_likelihood < 0 for r in got if r.n_tokens)
    ids, net = _Ids(WORDS + [f"\x00{k}" for k in range(448 - len(WORDS))]), Network()
    texts = [ids(t) for t in ("the of river", "", "stone walks unknownish")]
    target, around = _windows(texts)
    assert len(target) == 6 and around.shape == (4, 6) and around[0, 0] == around[2, 2] == around[1, 3] == 512 and BATCH > 6
    assert np.isfinite(net.log_probabilities(target, around)).all()
    assert pseudo_likelihoods(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_dont_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr("verdancy.llm.pseudo_likelihood.SHARD_CHARS", 30_000)
    docs = spark.createDataFrame(corpus(300)[0] + EDGES, DOCS)
    one, other = ({(r.doc_id, r.n_tokens): r.mean_log_likelihood for r in pseudo_likelihoods(docs.repartition(n, "text")).collect()} for n in (2, 9))
    assert one == pytest.approx(other, abs=1e-5)


def test_texts_score_above_their_shuffled_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r, some = random.Random(1), [x for x in docs.where("doc_id % 10 = 0").collect() if len((x.text or "").split()) > 20]
    mixed = [(x.doc_id + 10**6, " ".join(r.sample(x.text.split(), len(x.text.split())))) for x in some]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(mixed, "doc_id long, text string"))
    got = {x.doc_id: x.mean_log_likelihood for x in pseudo_likelihoods(both).where("doc_id % 10 = 0").collect()}
    above = sum(got[k - 10**6] > got[k] for k, _ in mixed)
    assert above >= 0.95 * len(mixed), (above, len(mixed))


def test_rollup_follows_its_changes(spark, tmp_path):
    rows = [(1, "a b c", "en", "s"), (2, "d e", None, None), (3, None, "en", "s"), (4, "x " * 50_000, "en", "t"), (1, "a b c", "en", "s")]
    counted = token_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), public_tokenizers.path("word_bpe_49k.json")).cache()
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(r.tokens for r in counted.collect()) == sorted(len(tk.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows)
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().collect() == []
    for _ in range(3):
        rollup.commit("one", signed(counted, 1, "v1"))
    rollup.commit("two", signed(counted.where("doc_id = 4"), -1, "v1").union(signed(counted.where("doc_id = 4"), 1, "v2", "tokens + 1")))
    rollup.commit("none", signed(counted.limit(0), 1, "v1"))
    expected = {("s", "en", "v1", 3, 6), (None, None, "v1", 1, 2), ("t", "en", "v2", 1, 50_001)}
    assert {tuple(r) for r in rollup.totals().collect()} == expected
    rollup.compact(str(tmp_path / "c"))
    assert {tuple(r) for r in Rollup(spark, str(tmp_path / "c")).totals().collect()} == expected


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clean_documents(spark, tmp_path, stage):
    from corpus_pipeline import STAGES

    rows, labels = corpus(120)
    docs = spark.createDataFrame([(i, t, la, s, len(t)) for i, t, la, s, *_ in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (500, "", "en", "s", 0)], docs.schema))
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert {None, 500} <= left and (0 in left) == (stage != 3)
    assert docs.limit(0).columns == STAGES[stage][1](spark, docs.limit(0), str(tmp_path)).columns
    assert out.where(F.col("doc_id").isNull()).count() == 1
