"""Ids and decoded texts equal the tokenizers library's, word by word merging or not."""

import random

import pytest
from tokenizers import Tokenizer

from tianguis.llm.bpe import Bpe, bpe_round_trip, default_vocab


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocab())


@pytest.fixture(scope="module")
def bpe():
    return Bpe(default_vocab())


def odd_texts(n=400):
    rng = random.Random(1)
    pool = "abcdefghij  KLM'\"!?.,123½²éÉüß漢字кирΣσς İı́\x1c\x85　🙂👍🏽\n\t-_'s't're'll"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return texts + ["A <|ENDOFTEXT|> B <|endoftext|>É", "ÀÉÎÕÜ's Straße, ÑANDÚ. Ǆ ǅ ŉ ſ ÿŸ 1É2", "hello <|endoftext|>world<|startoftext|><|endoftext|> <|endof", "", "   ", "a" * 5000, "!?" * 2000]


def test_equals_the_library(bpe, library):
    texts = odd_texts()
    for text, (ids, decoded) in zip(texts, bpe.encode_texts(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False)


def around(c):
    """A code point alone, within, before and after letters, after a mark's base and between digits."""
    return f"{c} a{c}b {c}E e{c} 1{c}2 '{c} A\u030a{c}"


def test_every_code_point(bpe, library):
    """All code points up to the supplementary planes' letters, and every 61st of the rest."""
    points = [i for i in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A0, 0xD800), *range(0xE000, 0x20000, 3), *range(0x20000, 0x110000, 61))]
    texts = [around(chr(i)) for i in points]
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [hex(i) for i, w, (ids, _) in zip(points, want, bpe.encode_texts(texts)) if ids != " ".join(map(str, w.ids))]
    assert wrong == []


def test_verification_accepts_exactly_the_words_that_merging_leaves(bpe):
    rng = random.Random(2)
    words = list({"".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14))) for _ in range(800)})
    proposals, encoded = [bpe.propose(w) for w in words], bpe.encode_words(words)
    assert encoded == [bpe.merge(w) for w in words]
    kept = sum(p == e for p, e in zip(proposals, encoded))
    assert 0 < kept < len(words)


def test_scan_and_heap_merge_alike(bpe):
    rng = random.Random(3)
    for n in (1, 2, 5, 30, 48, 49, 200):
        word = "".join(rng.choice("theandi") for _ in range(n))
        ids = [bpe.start[c] for c in word[:-1]] + [bpe.stop[word[-1]]]
        assert bpe._merge_scan(list(ids)) == bpe._merge_heap(list(ids)) == bpe.merge(word)


def test_rows_nulls_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "One two", "z"), (3, "One two", "z"), (None, "a", "w")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe_round_trip(docs).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 3] and got[1][1:] == got[2][1:] == ("", "") and got[3] == got[4]
    assert bpe_round_trip(docs.limit(0)).count() == 0


def test_cache_may_be_smaller_than_a_batch(monkeypatch, library):
    b = Bpe(default_vocab())
    b.pieces.half = b.words.half = 3
    for _ in range(3):
        for text, (ids, _) in zip(odd_texts(30), b.encode_texts(odd_texts(30))):
            assert ids == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
