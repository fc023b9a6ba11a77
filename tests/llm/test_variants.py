"""Single edits by tiles against edit distances word by word."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from tianguis.llm import variants

RUN = regex.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:k] + long_[k + 1:] == short for k in range(len(long_)))


def brute_words(docs):
    count = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def brute(words):
    out, form = [], {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def random_words(k, letters, seed):
    rng = random.Random(seed)
    words = {}
    while len(words) < k:
        w = "".join(rng.choices(letters, k=rng.randint(5, 9)))
        for _ in range(3):
            words[w] = rng.choice([3, 4, 6, 9, 50, 100])
            p = rng.randrange(len(w) + 1)
            w = rng.choice([w[:p] + rng.choice(letters) + w[p:], w[:max(p - 1, 0)] + w[p:], w[:p] + rng.choice(letters) + w[p + 1:]])
            if len(w) < 5:
                break
    return words


@pytest.mark.parametrize("letters, lot", [("ab", 1024), ("abcé", 8), ("aß÷y", 3)])
def test_forms_equal_brute_force(spark, monkeypatch, letters, lot):
    monkeypatch.setattr(variants, "LOT", lot)
    monkeypatch.setattr(variants, "LETTERS_A_TASK", 3000)
    words = random_words(250, letters, lot)
    got = variants.of_words(spark.createDataFrame([*words.items()], "word string, n long"))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(words)


def test_texts_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [*random_words(60, "abcdé", 1), "a" * 400, "a" * 401, "b" + "a" * 400]
    docs = [(i, " ".join(rng.choices([*vocabulary, "Übung", "ÜBUNG", "naïve", "x×y÷z"], k=80)) + "-9_ĸ") for i in range(60)]
    docs += [(None, "kelvin Kelvin kelvin Kelvin"), (7, None), (8, ""), (9, "1234 ... "), *[docs[0]] * 3]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "id": F.lit(2), "half": F.lit(3)})
    want = brute(brute_words(docs))
    got = variants.variants(frame).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == want and any(r[1] for r in want)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c")]):
        assert variants.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_a_chain_of_forms(spark):
    words = {"abcde": 3, "abcdef": 8, "abcdefg": 20, "abcdefgh": 50, "abcdefghi": 110, "other": 9}
    got = {r.word: r.root for r in variants.of_words(spark.createDataFrame([*words.items()], "word string, n long")).collect()}
    assert set(got.values()) == {"abcdefghi", "other"}


def test_each_pair_of_a_tile_counts_once():
    words = ["abcde", "abcdx", "xbcde", "abcdef", "bcde"]
    rows = []
    for lots in (1, 2):
        lot = np.arange(len(words)) % lots
        for half in ("<ab", ">de"):
            for i in range(lots):
                for j in range(i, lots):
                    rows += [(half, 5, i, j, int(lot[k]), k, w, 3 + k) for k, w in enumerate(words) if lot[k] in (i, j)]
        t = pd.DataFrame(rows, columns=["half", "m", "i", "j", "lot", "id", "word", "n"])
        got = variants.compared(t).set_index("id")["n_near"].to_dict()
        # all words stand in both groups here, so each pair of length 5 or 5 and 6 is found exactly once
        want = {k: sum(one_edit(w, v) and min(len(w), len(v)) == 5 for v in words) for k, w in enumerate(words)}
        assert got == {k: n for k, n in want.items() if n}
        rows = []
