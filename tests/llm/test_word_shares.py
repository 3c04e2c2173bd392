"""Every word of the corpus has a probability of its own in the pseudo-likelihood."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from verdancy.llm import pseudo_likelihood
from verdancy.llm.pseudo_likelihood import Network, pseudo_likelihoods


@pytest.mark.parametrize("carried", [200_000, 500, 0])
def test_rare_words_of_one_ending_differ_by_their_counts(spark, monkeypatch, carried):
    monkeypatch.setattr(pseudo_likelihood, "CARRIED_WORDS", carried)
    common = " ".join(f"w{k}x" for k in range(448))
    rows = [(k, common) for k in range(20)] + [(100, "w1x plainest w2x"), (101, "w1x gibberest w2x"), (102, "plainest " * 6), (103, None), (100, "w1x plainest w2x"), (None, "w1x ñé w2x"), (104, "a")]
    got = pseudo_likelihoods(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    # plainest stands 8 times and gibberest once, in one class of 9
    assert math.isclose(by[100].log_likelihood - by[101].log_likelihood, math.log(8), abs_tol=1e-4)
    assert all(r.log_likelihood < 0 for r in got if r.n_tokens) and by[103].log_likelihood == 0
    assert [r.log_likelihood for r in got if r.doc_id == 100] == [by[100].log_likelihood] * 2


def plain_sum(texts, asked):
    """Sum over words of log p(group), p(token in the group) and the word's share of its class, one word at a time."""
    counts = Counter(w for t in texts for w in t.split())
    words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: pseudo_likelihood.WORDS]]
    token = lambda w: words.index(w) if w in words else pseudo_likelihood.WORDS + zlib.crc32(w[-2:].encode()) % pseudo_likelihood.ENDINGS
    classes = Counter()
    for w, n in counts.items():
        classes[token(w)] += n
    p, pad = Network().p, pseudo_likelihood._tokens_of()
    ids, total = [token(w) for w in asked.split()], 0.0
    for i, w in enumerate(asked.split()):
        h = p["b"].astype(float)
        for k, at in enumerate((i - 2, i - 1, i + 1, i + 2)):
            h = h + p["e"][k][ids[at] if 0 <= at < len(ids) else pad]
        h = np.tanh(h)
        g, within = ids[i] % pseudo_likelihood.GROUPS, ids[i] // pseudo_likelihood.GROUPS
        groups = p["g"].T @ h + p["gb"]
        inside = [p["t"][g][:, j] @ h + p["tb"][g][j] for j in range(pseudo_likelihood.SIZE) if j * pseudo_likelihood.GROUPS + g < pad]
        total += groups[g] - np.log(np.exp(groups).sum()) + inside[within] - np.log(np.exp(inside).sum())
        if ids[i] >= pseudo_likelihood.WORDS:
            total += math.log(counts[w] / classes[ids[i]])
    return total


def test_scores_equal_a_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "train", lambda docs, words: Network().flat())
    r = random.Random(1)
    texts = [" ".join(f"v{int(r.paretovariate(0.4)) % 5000}{r.choice(['', 'ing', 'er'])}" for _ in range(r.randrange(0, 60))) for _ in range(120)]
    got = pseudo_likelihoods(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(texts) and len({w for t in texts for w in t.split()}) > pseudo_likelihood.WORDS + 200
    for x in got:
        assert x.log_likelihood == pytest.approx(plain_sum(texts, texts[x.doc_id]), rel=1e-4, abs=1e-4)
