import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdancy.llm.packing import _WordIds, pack_documents, plan_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, length long, rank string, shard int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.text(alphabet=st.sampled_from(list("aBzZ éÉßœŒİıſΣσς'’.,!?%$#&*\t\n\x1c\x85 ́ 日本1２<|>_-=s")), max_size=40), max_size=4))
@settings(max_examples=300, deadline=None)
def test_word_ids_are_the_tokenizers(texts):
    tk, ids = Tokenizer.from_file(PATH), _WordIds(PATH)
    texts = [*texts, "it's we'll <|endoftext|>x <|startoftext|>"]
    for text, got in zip(texts, ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_tightly(seed):
    r = random.Random(seed)
    top = r.choice([30, 700, 4096])
    histogram = defaultdict(int)
    for _ in range(r.choice([1, 50, 3000])):
        histogram[r.randint(1, top) if r.random() < 0.7 else r.randint(1, 60)] += r.choice([1, 1, 5])
    histogram = {k: v for k, v in histogram.items() if k <= 4096}
    rows, n = plan_packing(dict(histogram))
    ranks, places = defaultdict(set), defaultdict(list)
    for length, lo, count, first, each, at in rows:
        for k in range(count):
            assert lo + k not in ranks[length]
            ranks[length].add(lo + k)
            places[first + k // each].append((at + k % each * length, length))
    assert {k: len(v) for k, v in ranks.items()} == histogram and set(places) == set(range(n))
    for own in places.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= 4096
    total = sum(k * v for k, v in histogram.items())
    assert n <= max(-(-total // 4096) * 1.05 + 1, sum(v for k, v in histogram.items() if k > 2048) + total / 4096 * 0.5 + 1)


def test_documents_are_packed_whole(spark, tokenizer):
    long = "The quick brown Fox! " * 4000
    rows = [(1, "Hello World", 1, "r", 2), (2, "", 1, "r", 2), (3, None, 1, "r", 2), (4, long, 1, "r", 2), (1, "Hello World", 1, "r", 2), (None, "no id", 1, "r", 2), (5, "été 5 <|endoftext|>", 1, "r", 2)]
    got = pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    expected = []
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected += [(doc, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        assert [a for a, _ in sorted(own)] == np.r_[0, np.cumsum([n for _, n in sorted(own)])[:-1]].tolist()
        assert sum(n for _, n in own) <= 4096
    assert len(by) == -(-sum(e[3] for e in expected) // 4096)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS)).collect() == []
