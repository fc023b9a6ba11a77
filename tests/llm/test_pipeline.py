"""Each stage's decisions take effect; all rows and columns of clean documents stay."""

import zlib

import corpus_pipeline
from tianguis.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"]


def test_stages(spark, tmp_path):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(80))
    rows = [(1, clean, "en", "s", len(clean)), (2, clean + " tail", "en", "s", len(clean) + 5), (3, None, "en", "s", 0), (4, "12 34 %%", None, None, 8), (5, "write to me@here.org please", "en", "t", 27),
            (5, "write to me@here.org please", "en", "t", 27), (None, "no id at all", "en", None, None), (6, "short", "en", "u", 5)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = {}
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], ([1, 2, 5, 5, 6, None], [1, 5, 6, None], [1, 5, 6, None])):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
        assert [r.doc_id for r in kept[name]] == want, name
    last = {r.doc_id: r for r in kept["personal_data"]}
    assert last[5].text == "write to [EMAIL] please" and last[5].n_chars == len(last[5].text)
    assert tuple(last[1]) == rows[0] and tuple(last[6]) == rows[7] and tuple(last[None]) == rows[6]
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {1, 5, 6, None}


def test_language_without_labels(spark):
    """Where nothing can be learned, or only from documents that another query holds out, only null texts and texts without a letter go."""
    texts = [(1, "a clean text"), (2, None), (3, "12 34 %%"), (4, ""), (None, "another one")]
    for lang in (None, "und"):
        docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t in texts], COLUMNS)
        assert sorted(r.text for r in corpus_pipeline.keep_identified(spark, docs, "").collect()) == ["a clean text", "another one"]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "a clean text", "en", "s", 0) for i in held], COLUMNS)
    assert corpus_pipeline.keep_identified(spark, docs, "").count() == len(held) > 0


def test_the_learned_languages_decide(spark, monkeypatch):
    """With profiles of something else the same documents go."""
    from tianguis.llm import pipeline_stages

    texts = ["the cat and the dog sat there", "der hund und die katze sind da", "qxzvw jkqpx wvzzq kkxqj vxwqz"]
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(texts * 4, ["en", "de", None] * 4))]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted({r.text for r in corpus_pipeline.keep_identified(spark, docs, "").collect()}) == sorted(texts[:2])
    other = pipeline_stages.profiles(spark.createDataFrame([(texts[2] * 9, "xx")], "text string, lang string"))
    monkeypatch.setattr(pipeline_stages, "profiles", lambda docs: other)
    assert {r.text for r in corpus_pipeline.keep_identified(spark, docs, "").collect()} == {texts[2]}


def test_repeated_and_null_ids_lose_their_copies(spark):
    text = lambda k, n=80: " ".join(f"{k}word{i}" for i in range(n))
    a, b, c, d = map(text, "abcd")
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c + " tail"), (None, d), (None, d), (None, d + " tail"), (None, a), (None, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS).repartition(3)
    got = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text[:5]) for r in got) == [("1", "aword"), ("2", "bword"), ("3", "cword"), ("None", "dword"), ("None", "eword")]


def test_run_over_a_table_and_an_empty_one(spark, tmp_path):
    spark.createDataFrame([(1, "a text", "en", "s", 6)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1} and sum(r.length for r in got) == got[0].doc_tokens
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
