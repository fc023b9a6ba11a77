"""Base spans equal the plain patterns; the field adds other mentions of what they found."""

import itertools
import random
import re

import numpy as np
import pytest

from tianguis.llm.pii import BUCKETS, LABELS, NONE, Field, Words, base_spans, counts, edit_hashes, find_pii, luhn, one_edit, redact, redacted, same_number, shape, similar

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_equals_the_patterns():
    rng = random.Random(5)
    pool = ["1", "23", "255", "256", "007", ".", ".", "@", "@", "a", "b.c", "_", "+", "+4", "-", " ", "(", ")", "4111 1111 1111 1111", "é", "\n", "٣", "x@y.z", "10.0.0.1", "+1 (499) 555-6503"]
    for _ in range(5000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "a@" * 50_000, "+1 " * 50_000, "1.2.3.4 " * 20_000, "1-" * 100_000])
def test_long_runs_are_linear(text):
    base_spans(text)


def documents():
    rng = random.Random(6)
    rows = []
    for i in range(200):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        text = f"hello call {phone} or mail user{i}@mail{i % 7}.example.org on {rng.randint(1, 31)}.{rng.randint(1, 12)}. number {rng.randint(100, 99999)}"
        rows.append((i, text + (f" again dial 1 {phone[3:]} bye" if i % 5 == 0 else "")))
    return rows


def test_other_mentions_are_added_and_clean_texts_left_alone(spark):
    rows = documents() + [(900, None), (901, ""), (902, "nothing here 12 or 2024-01-01 or 555-1234"), (None, "a@b.c a@b.c"), (3, documents()[3][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    found = find_pii(docs, Field(counts(docs))).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text in rows:
        r = by_id[i]
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == [(PLAIN[k][0], s, e) for k, s, e in plain(text or "")]
        assert set(base) <= {(s.kind, s.start, s.end) for s in r.spans}
        added = [text[s.start : s.end] for s in r.spans if (s.kind, s.start, s.end) not in base]
        if i is not None and i < 200 and i % 5 == 0:
            assert len(added) == 1 and added[0].endswith(re.search(r"\d{3}-\d{4}", text)[0])
        else:
            assert added == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c now", 14, "x"), (2, None, None, None), (3, "clean", 99, "y")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: r for r in redact(docs, Field(counts(docs))).collect()}
    assert (got[1].text, got[1].n_chars, got[1].source) == ("mail [EMAIL] now", 16, "x")
    assert got[2].text is None and tuple(got[3]) == (3, "clean", 99, "y")
    assert redacted("0123456789", [(0, 1, 4), (3, 3, 6)]) == "0[EMAIL]6789"
    assert redact(docs.limit(0), Field(counts(docs.limit(0)))).count() == 0


def field_of(spark):
    rng = random.Random(8)
    rows = documents() + [(1000 + i, f"offices +44 20 79{rng.randint(10, 99)} {rng.randint(1000, 9999)} and 4{rng.randint(100, 999)} rooms {i}") for i in range(100)]
    return Field(counts(spark.createDataFrame(rows, "doc_id long, text string")))


def test_other_writings_of_a_number_are_found(spark):
    field = field_of(spark)
    cases = {
        "Call +44 20 7946 0958 today. Ask there, or 020 7946 0958 later.": ["020 7946 0958"],
        "Call +1 (499) 555-6503 today, or write 499-555-6503 here, or (499) 555-6503.": ["499-555-6503", "(499) 555-6503"],
        "First 2079460958 and only then +44 20 7946 0958.": ["2079460958"],
        "Call +44 20 7946 0958 today; room 7946 or 0958 and 17 7946 0959 are others, like 2024-01-01.": [],
        "No known number: 020 7946 0958, 499-555-6503, 2079460958.": [],
    }
    docs = spark.createDataFrame([*enumerate(cases)], "doc_id long, text string")
    for r in find_pii(docs, field).collect():
        text, want = list(cases.items())[r.doc_id]
        base = {(s.kind, s.start, s.end) for s in r.base}
        assert [text[s.start : s.end] for s in r.spans if (s.kind, s.start, s.end) not in base] == want, text
        assert all(s.kind == "phone" for s in r.spans)


def test_similar_words_share_a_potential():
    rng = random.Random(9)
    words = ["".join(rng.choices("ab1", k=rng.randint(8, 10))) for _ in range(150)]
    known = {w: i for i, w in enumerate(dict.fromkeys(words[:40]))}
    others = {w: [1000 + i] for i, w in enumerate(dict.fromkeys(words[40:])) if w not in known}
    want = {k for w, (k,) in others.items() if any(one_edit(w, v) for v in known)}
    assert {k for _, k in similar(known, others)} == want and want
    assert all(one_edit(next(w for w, i in known.items() if i == a), next(w for w, (k,) in others.items() if k == b)) for a, b in similar(known, others))
    h, gaps = edit_hashes("abcd")
    assert [int(g) for g in gaps] == [int(edit_hashes(x)[0]) for x in ("bcd", "acd", "abd", "abc")] and int(h) == int(edit_hashes("abcd")[0])
    w = Words()
    text = "write jane.smith7@example.org or jane.smth7@example,org"
    w.add(text, base_spans(text))
    assert w.anchored() == {1} and (0, 1) in w.skip


def test_words_are_read_whole():
    assert shape("a" * 100 + "1" * 30 + "-" * 9) == "a0- 20" and shape("x" * 70 + "@9") == "a@0 1" and shape("a.b" * 40) != shape("a.b" * 41)
    assert same_number("02079460958", "442079460958") and not same_number("72079460958", "442079460958") and not same_number("0000000", "0000000")


@pytest.mark.parametrize("n, chain, skip", [(1, [], []), (3, [(0, 1), (1, 2)], []), (5, [(0, 1), (3, 4)], [(0, 3), (2, 3)]), (4, [(0, 1), (2, 3)], [(0, 3)])])
def test_beliefs_are_exact_on_trees(n, chain, skip):
    """On graphs without loops message passing gives the marginals of the whole table of labellings."""
    rng = np.random.Generator(np.random.PCG64(n))
    k = len(LABELS)
    field = Field({"shape": rng.integers(0, 40, BUCKETS * k).astype(float), "cue": rng.integers(0, 40, BUCKETS * k).astype(float), "chain": rng.integers(1, 60, k * k).astype(float), "skip": np.array([30.0, 10.0])})
    w = Words()
    w.shape, w.cue, w.label = list(range(n)), list(range(7, 7 + n)), [NONE] * (n - 1) + [2 if n > 1 else NONE]
    w.chain, w.skip = chain, skip
    table = np.zeros([k] * n)
    for y in itertools.product(range(k), repeat=n):
        e = sum(field.shape[w.shape[i], y[i]] + field.cue[w.cue[i], y[i]] + (30.0 if w.label[i] == y[i] != NONE else 0.0) for i in range(n))
        table[y] = np.exp(e + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in skip))
    p = field.beliefs(w)
    for i in range(n):
        want = table.sum(axis=tuple(j for j in range(n) if j != i))
        assert np.allclose(p[i], want / want.sum(), atol=1e-4)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_pii(docs, Field(counts(docs))).count() == 0
