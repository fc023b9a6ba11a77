"""Places equal those of a plain search; partial copies of longer templates are labelled; the plan holds no Python."""

import random
import re

import __spark_entry__ as E
from tianguis.llm.licenses import PHRASES, license_matches, op8_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), sorted((label, i) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").write.parquet(f"{tmp_path}/documents.parquet")
    return op8_licenses(spark, str(tmp_path)).collect()


def test_places_equal_a_plain_search(spark, tmp_path):
    rng = random.Random(7)
    pool = ["cc", "by", "CC", "By", "general", "Public", "licenses", "license", "all", "rights", "reserved", "é", "x1", "\u212a", "lİcense"]
    rows = [(i, rng.choice([" ", "-", ", ", "\u00a0 "]).join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "cc by " * 20_000), (403, " .,!"), (None, "cc by"), (5, rows[5][1])]
    got = run(spark, tmp_path, rows)
    assert len(got) == len(rows)
    want = sorted((str(i), n, len(p), min((x for _, x in p), default=-1), max((x for _, x in p), default=-1), ",".join(sorted({k for k, _ in p}))) for i, t in rows for n, p in [plain(t)])
    value = lambda x: -1 if x is None else x
    assert sorted((str(r.doc_id), r.n_words, r.n_base, value(r.first_word), value(r.last_word), r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_only_a_to_z_are_lower_cased(spark, tmp_path):
    notice = "this work is licensed under the gnu general public license version 3"
    odd = {i: notice.replace(c, d) for i, (c, d) in enumerate([("k", "\u212a"), ("i", "\u0130"), ("s", "\u017f"), ("e", "É")], 100)}
    rows = [(1, notice), (2, notice.upper()), (3, notice.title()), *odd.items()]
    rows += [(10 + i, notice.replace(c, c.upper())) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    got = {r.doc_id: r for r in run(spark, tmp_path, rows)}
    assert all(got[i].labels == "gpl,gpl-3.0" and got[i].score == 1.0 for i in got if i not in odd)
    assert got[100].n_words == 12 and all("gpl-3.0" not in got[i].labels or got[i].score < 1 for i in odd)
    assert got[101].base_labels == "" and got[103].base_labels == ""


def test_edited_copies_of_longer_templates(spark, tmp_path):
    bsd = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    w = bsd.split()
    rows = [(1, "Some words. " + bsd), (2, " ".join(w[:10] + ["also"] + w[10:])), (3, " ".join(w[:8])), (4, " ".join(reversed(w))), (5, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in run(spark, tmp_path, rows)}
    assert got[1].labels == "bsd" and got[1].score == 1.0
    assert got[2].labels == "bsd" and 0.85 <= got[2].score < 1
    assert got[3].labels == got[4].labels == "" and got[3].score == 0
    assert got[5].labels == "cc-by,cc-by-nc-4.0"


def test_native_plan_and_empty_table(spark):
    text = E.queries()["op8_licenses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text) and "BroadcastNestedLoop" not in text
    assert text.count("FileScan parquet") == 1
    assert license_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0
