"""Every id lies in exactly one piece, sequences are gapless, and padding is little."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tianguis.llm.bpe import default_vocab
from tianguis.llm.packing import WINDOW, Packer, WordIds, pack


def check(rows, texts):
    """rows against whole-text encoding by the library; returns the padded share."""
    library = Tokenizer.from_file(default_vocab())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= WINDOW
        padded += 0 if at & (at - 1) == 0 else WINDOW - at
    return padded / (WINDOW * max(1, len(by_seq)))


def test_pieces_of_all_kinds_of_texts(spark):
    rng = random.Random(4)
    words = ["the", "and", "Érable", "x1", "!?", "<|endoftext|>", "ﬁn"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 300, 2500, 12000])))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "word " * 30000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, start int").repartition(5)
    assert check(pack(docs).collect(), texts) < 0.01


def test_many_partitions_merge_in_levels(spark):
    texts = [(i, "a b c " * (i % 50)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(70)
    assert check(pack(docs).collect(), texts) < 0.01


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same words here"), (1, "same words here")], "doc_id long, text string")
    got = pack(docs).collect()
    assert sum(r.length for r in got) == 2 * got[0].doc_tokens
    assert pack(docs.limit(0)).count() == 0


def test_best_fit_and_bounded_windows():
    p = Packer(0, open_windows=2, slack=0)
    ids = lambda n: np.arange(n, dtype="<u4").tobytes()
    p.add(1, 0, 4000, ids(4000))
    p.add(2, 0, 3000, ids(3000))
    p.add(3, 0, 90, ids(90))  # fits both; the fuller one holds it better
    assert [w[0] for w in p.open] == [4090, 3000]
    p.add(4, 0, 2000, ids(2000))  # fits none, none may be opened: the fullest is filled and emitted
    assert len(p.open) <= 2 and p.done and sum(r[4] for r in p.done) == WINDOW
    p.finish()
    assert sum(r[4] for r in p.done) == 4000 + 3000 + 90 + 2000


def test_word_cache_equals_whole_text_encoding():
    from test_bpe import odd_texts

    library, ids = Tokenizer.from_file(default_vocab()), WordIds(default_vocab())
    for text, got in zip(odd_texts(200), ids(odd_texts(200))):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
