"""The Kneser-Ney model against a plain one that works on dictionaries."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from verdancy.llm import quality as module
from verdancy.llm.quality import WORD_TYPES, _Scorer, quality, train, trusted_sample


def plain_model(texts):
    """Probability of a word after two others, from the definition of interpolated modified Kneser-Ney smoothing."""
    c3 = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split()]
        c3.update(zip(w, w[1:], w[2:], strict=False))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)

    def discounts(counts):
        n1, n2, n3, n4 = (max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        one = 1 - 2 * y * n2 / n1
        two = min(max(one, 2 - 3 * y * n3 / n2), 1.9)
        three = min(max(two, 3 - 4 * y * n4 / n3), 2.9)
        return lambda c: one if c == 1 else two if c == 2 else three

    levels = []
    for counts in (c1, c2, c3):
        d, total, left = discounts(counts), Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d(c)
        levels.append((counts, d, total, left))

    def p(gram):
        found = 1 / WORD_TYPES
        for k, (counts, d, total, left) in enumerate(levels):
            g = gram[2 - k :]
            if total[g[:-1]]:
                c = counts.get(g, 0)
                found = (c - d(c) if c else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * found
        return found

    return p


def nll(p, text):
    w = ["<s>", "<s>", *text.split()]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    each = {g: -math.log(p(g)) for g in grams}
    return sum(each[g] for g in grams) / len(grams), sum(each.values()) / len(each)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(60)]
    return [" ".join(r.choices(words, k=r.randrange(1, 40))) for _ in range(50)]


def test_model_equals_plain_kneser_ney(spark, texts):
    scorer, p = _Scorer(train(spark.createDataFrame([(t,) for t in texts], "text string"))), plain_model(texts)
    for asked in [*texts[:20], "unknown", "w1 unknown w1 w1", "w1 w1 w1 " * 50, " ".join(reversed(texts[3].split())), "w1 w2 never w2 w1"]:
        n, words, types, _, _ = scorer(asked)
        assert n == len(asked.split())
        assert (words, types) == pytest.approx(nll(p, asked), rel=1e-5)
    once, often = scorer("w1 w1 w1"), scorer("w1 w1 w1 " * 50)
    assert once[1] > often[1]  # perplexity is that of all words


def test_probabilities_sum_to_one_but_for_the_unknown(texts):
    p, seen = plain_model(texts), {w for t in texts for w in t.split()}
    for context in (("<s>", "<s>"), tuple(texts[0].split()[:2]), ("no", "such")):
        assert 0.5 < sum(p((*context, w)) for w in seen) < 1


def test_columns_of_query(spark):
    docs = spark.createDataFrame([(k, " ".join(f"a{(k * j) % 17}" for j in range(30)), "en", "x") for k in range(200)] + [(900, None, None, "x"), (901, "", "en", "x"), (None, "a1 a2", "en", "x")], "doc_id long, text string, lang string, limit string")
    labels = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int")
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[900].kept and by[900].z is None and by[901].n_words == 0
    assert all(math.isclose(r.perplexity, math.exp(r.nll)) for r in rows)


def test_other_white_space_is_part_of_a_word(spark):
    """Training and scoring part words alike: at blanks and \\t to \\r only."""
    odd = ["a\u00a0b c\u3000d e", "x\u2003y z\x85w", "q\x1cr s\x1ft"]
    plain = ["a_b c_d e", "x_y z_w", "q_r s_t"]
    one, other = (_Scorer(train(spark.createDataFrame([(t + " tail",) for t in some * 5], "text string"))) for some in (odd, plain))
    for a, b in zip(odd, plain, strict=True):
        assert one(a)[0] == other(b)[0] == len(b.split()) and one(a)[1:3] == pytest.approx(other(b)[1:3], rel=1e-6)


def test_the_sample_has_a_bound_over_all_languages(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', 20) as text", "concat('l', id % 4) as lang")
    labels = spark.range(400).selectExpr("id as doc_id", "1 as quality")
    whole = trusted_sample(docs, labels).count()
    monkeypatch.setattr(module, "MODEL_CHARS", 4 * 1000)
    assert whole > 100 and 4 * 5 < trusted_sample(docs, labels).count() <= 4 * 10
    monkeypatch.setattr(module, "MOST_TRIGRAMS", 3)
    with pytest.raises(ValueError, match="more than a model may have"):
        train(spark.createDataFrame([("a b c d e f",)], "text string"))


def test_the_model_learns_from_all_trusted_documents_but_the_held_out(spark):
    """Also beyond a few hundred of a language, and from very long ones."""
    docs = spark.range(1000).selectExpr("id as doc_id", "'en' as lang", "concat_ws(' ', transform(sequence(1, if(id = 7 or id = 8, 6000, 12)), k -> concat('d', id, 'w', k))) as text")
    labels = spark.range(1000).selectExpr("id as doc_id", "1 as quality")
    learnt = {r.doc_id for r in labels.where("pmod(xxhash64(doc_id), 10) < 6").collect()}
    assert len(learnt) > 500 and learnt & {7, 8}
    assert {r.doc_id for r in quality(docs, labels).where("seen = 1").collect()} == learnt


def test_joined_scores_equal_those_beside_a_broadcast(spark, texts, monkeypatch):
    rows = [(k, t, "en") for k, t in enumerate([*texts * 4, "unknown", "w1 unknown w1 w1", "w1 w1 w1 " * 50, "w1\u00a0w2 w1", "", "  ", None])] + [(3, texts[3], None), (None, texts[1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(150)], "doc_id long, quality int")
    get = lambda: sorted(quality(docs, labels).collect(), key=lambda r: (str(r.doc_id), str(r.lang)))
    beside = get()
    monkeypatch.setattr(module, "BROADCAST_TRIGRAMS", 0)
    for a, b in zip(beside, get(), strict=True):
        assert (a.doc_id, a.lang, a.n_words, a.kept) == (b.doc_id, b.lang, b.n_words, b.kept)
        assert all(x == y or x == pytest.approx(y, rel=1e-4, abs=1e-4) for x, y in zip(a[3:-1], b[3:-1], strict=True))


@pytest.mark.parametrize("common", [0, 5, 1000])
def test_scores_in_shards_equal_those_beside_a_broadcast(spark, texts, monkeypatch, common):
    """Also where words beyond the common ones keep their hashes and meet their probabilities in a join."""
    asked = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "unknown", "w1 unknown w1 w1", "unknown other " * 30, "w1 w1 w1 " * 50, "w2 other", " ".join(reversed(texts[3].split()))])], "of long, text string")
    learnt = module.stored(spark.createDataFrame([(t,) for t in texts[:25]], "text string"))
    words = module.stored(learnt.mapInArrow(module._word_counts, "w long, n long").groupBy("w").sum("n").toDF("w", "n"))
    scorer = _Scorer(train(learnt))
    monkeypatch.setattr(module, "BROADCAST_WORDS", common)
    found = {r.of: r for r in module.sharded_scores(asked, learnt, words).collect()}
    for of, text in asked.collect():
        assert tuple(found[of])[1:] == pytest.approx(scorer(text), rel=1e-5, abs=1e-6), text


def test_no_shuffle_of_the_scores_stays_on_disk(spark, texts, monkeypatch):
    """Each round's trigrams are deleted before the next one's are written."""
    monkeypatch.setattr(module, "BROADCAST_TRIGRAMS", 0)
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(len(texts))], "doc_id long, quality int")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    real, left = module.tidily_stored, []

    def watched(df):
        before = tracker.shuffleStatuses().size()
        found = real(df)
        left.append(tracker.shuffleStatuses().size() - before)
        return found

    monkeypatch.setattr(module, "tidily_stored", watched)
    quality(docs, labels).count()
    assert len(left) > module.ROUNDS and max(left) <= 0


def test_words_are_split_and_hashed_together(monkeypatch):
    """As one by one, in whole batches and slices of them; only words too long for that are hashed by themselves."""
    r, asked = random.Random(2), []
    monkeypatch.setattr(module.xxhash, "xxh64_intdigest", lambda w, seed: asked.append(len(w)) or hash(bytes(w)) % (1 << 64))
    bits = ["a", "b", " ", "\t", "\v", "\f", "\r\n", "é", " ", "\x1c", "\x85", "\x00", "y" * 8, "z" * 9, "q" * 64, "p" * (64 + 1)]
    texts = [None, "", " ", *(r.choice([None, "".join(r.choices(bits, k=r.randrange(12)))]) for _ in range(2000)), "end"]
    whole = pa.array(texts, pa.string())
    for start, n in ((0, len(texts)), (0, 1), (1, 1), (700, 900), (len(texts) - 1, 1), (5, 0)):
        asked.clear()
        counts, numbers, hashes = module._numbered(whole.slice(start, n))
        words = [module._WORD.findall(t or "") for t in texts[start : start + n]]
        assert counts.tolist() == [len(w) for w in words]
        known = {}
        assert numbers.tolist() == [known.setdefault(w, len(known)) for ws in words for w in ws]
        assert len(hashes) == len(known) == len(set(hashes.tolist()))
        assert asked == [len(w.encode()) for ws in words for w in ws if len(w.encode()) > 64]
