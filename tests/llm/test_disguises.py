"""Disguises at a word's end, by several means at once, and spelt apart with signs."""

import math
import random
import re
from collections import Counter

import pytest

from verdancy.llm import toxicity as module
from verdancy.llm.toxicity import DROPPED, LEET, SUBSTITUTED, CharModel, Reader, _char_counts, restored


@pytest.fixture(scope="module")
def reader(spark):
    text = "the idiot is a loser and an asshole full of shit , ass , cuss the stupid dunce in 1995 or 455 to 2001 , 300 of 1234 rivers " * 50
    return Reader(CharModel(_char_counts(spark.createDataFrame([(text,), (None,)], "text string"))))


@pytest.mark.parametrize(
    ("text", "word"),
    [("1d107", "idiot"), ("idi07", "idiot"), ("a55", "ass"), ("shi7", "shit"), ("@$$hole", "asshole"), ("i d 1 o t", "idiot"), ("i.d.1.o.t", "idiot"), ("l  o  s  e  r", "loser"), ("i. d. i. o. t", "idiot"), ("l0000ser", "loser"), ("1diooooot", "idiot"), ("an a$$", "ass"), ("loser$$$", "loser")]
    + [(x, "idiot") for x in ("idi0+", "1.d.i.o.t", "i.d.1.0.t", "iddiioott", "idioot", "id-iot", "1dd1o.t")]
    + [(x, "loser") for x in ("lo-ser", "l0o0s3r", "looos3r", "lo.s3r", "l o o s e r")]
    + [("cu$$", "cuss"), ("dunc3", "dunce"), ("stup1ddd", "stupid"), ("$tuppid", "stupid")],
)
def test_read(reader, text, word):
    assert word in reader(text)


def best_by_enumeration(span, lm):
    """The least cost over all readings of a span, each character's choices tried one by one."""
    found = {}

    def go(k, said, cost):
        if k == len(span):
            state = ("^^" + said)[-2:]
            found[said] = min(found.get(said, math.inf), cost - lm(state, "$"))
            return
        c, last = span[k], ("^^" + said)[-2:]
        if c in " .-":
            return go(k + 1, said, cost)
        for x in LEET.get(c, ""):
            go(k + 1, said + x, cost + SUBSTITUTED - lm(last, x))
            if last[1] == x:
                go(k + 1, said, cost + SUBSTITUTED + DROPPED)
        if c.isalnum():
            go(k + 1, said + c, cost - lm(last, c))
            if last[1] == c:
                go(k + 1, said, cost + DROPPED)
        else:
            go(k + 1, said, cost + 2 * SUBSTITUTED)

    go(0, "", 0.0)
    return found


@pytest.mark.parametrize("span", ["1d10t", "l00$er", "a55h0le", "s.h.1.7", "i d d 1 o", "$$!", "iddiioott", "l0o0s3r", "300", "|0$3r!"])
def test_viterbi_equals_enumeration(reader, span):
    costs = best_by_enumeration(span, reader.lm)
    assert costs[restored(span, reader.lm)] == pytest.approx(min(costs.values()))


def test_plain_text_stays(reader):
    assert reader("in 1995 or 2001") == {"in", "or"}
    assert reader("the river!") == {"the", "river"}


def test_trigrams_equal_plain_counts(spark):
    r, texts = random.Random(7), ["", None, "a", "É à1 \U0001f600x", "ab--c\nDE 12", "İı ß"]
    texts += ["".join(r.choices("abcÄé19 .-_\n", k=r.randrange(0, 80))) for _ in range(300)]
    expected = Counter()
    for t in texts:
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            w = f"^^{w}$"
            expected.update(w[i : i + 3] for i in range(len(w) - 2))
    assert _char_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)) == expected


@pytest.mark.parametrize("span", ["1d10t", "l00$er", "s.h.1.7", "i d d 1 o", "$$!", "iddiioott", "llette", "$$", "!a!1!o"])
def test_a_span_is_left_out_only_where_no_reading_has_a_head(reader, span):
    every = {s for s in best_by_enumeration(span, reader.lm)}
    heads = {s[:3] for s in every if len(s) >= 3}
    for head in heads:
        assert Reader(reader.lm, {head}).reaches(span)
    assert Reader(reader.lm, {"qqq"}).reaches(span) == any(len(s) < 3 for s in every)


WORDS = ["trash", "pathetic", "idiot", "disgusting", "stupid", "clown", "scum", "loser", "moron"]
FORMS = {
    "letters by digits": lambda w: "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}.get(c, c) for c in w),
    "spelt apart": " ".join,
    "dotted": ".".join,
    "a letter thrice": lambda w: w[: len(w) // 2] + 3 * w[len(w) // 2] + w[len(w) // 2 + 1 :],
    "apart and digits": lambda w: " ".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5"}.get(c, c) for c in w),
}


def test_disguises_under_a_model_of_given_documents(spark):
    """Each form of disguise of words that the documents hold also undisguised; at most one reading in twenty may differ."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    reader = Reader(CharModel(_char_counts(docs)))
    wrong = [(name, w) for name, form in FORMS.items() for w in WORDS if w not in reader(f"the {form(w)} and")]
    assert len(wrong) <= len(FORMS) * len(WORDS) // 20, wrong


def test_an_unchanged_digit_costs_more_than_its_substitution(reader):
    assert restored("1d107", reader.lm) == "idiot" and reader("in 1995 or 4 5 5") == {"in", "or"}


def test_the_model_has_a_bound_whatever_the_script(spark, monkeypatch):
    monkeypatch.setattr(module, "ALPHABET", 5)
    text = " ".join(chr(0x4E00 + k) + chr(0x4E00 + 7 * k % 900) for k in range(900)) + " aa bb ab ba abc" * 900
    counts = _char_counts(spark.createDataFrame([(text,)], "text string"))
    letters = {c for gram in counts for c in gram}
    assert len(letters) <= 5 + 3 and module.OTHER in letters
    whole = _char_counts(spark.createDataFrame([("ab abc",)], "text string"))
    assert sum(whole.values()) == sum(len(w) for w in ("ab", "abc")) + 2 and CharModel(counts)("^^", "\u3042") == CharModel(counts)("^^", "\u3044")
