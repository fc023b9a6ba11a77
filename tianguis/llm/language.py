"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds
(multiplies) its letters' vectors, each permuted by its place in the trigram. A text bundles (adds) the
vectors of its trigrams, a language those of all its training texts; texts go
to the language whose vector has the largest cosine.

Bundling is linear, so a task counts the trigrams it meets per language and adds
each distinct one once, times its count; tasks return one vector per
language. What the driver gets is one vector per language, whatever the number of documents.

A null text, or one without a letter, is ``und`` with score 0. Ties go to the
alphabetically first language; with no learned language every text is ``und``. Repeated rows are returned
each and count each in training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import cut, table, worker_cache
from tianguis.operators.stats import value_at

DIMENSIONS = 1024
#: Symbols: 0 between words, 1 to 26 for a to z, the others by code point for all other letters: those of the Latin, Greek
#: and Cyrillic alphabets up to U+04EE have one each, later ones share. The most whose trigrams can be numbered in 32 bits.
SYMBOLS = 1290
UNDETERMINED = "und"
SEED = 20
#: Letters of a long text that are bundled at a time.
CHUNK = 1 << 20


class Letters:
    """Letter vectors and the symbol of each code point."""

    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.Generator(np.random.PCG64(SEED))
        base = (rng.integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)
        self.placed = [np.roll(base, 2 - i, axis=1) for i in range(3)]
        self.dimensions = dimensions
        points = np.arange(0x110000, dtype=np.int32)
        alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.symbol = np.where(alpha, 27 + points % (SYMBOLS - 27), 0)
        self.symbol[97:123] = np.arange(1, 27)

    def trigrams(self, text: str) -> np.ndarray:
        """Trigram codes of a text; word ends are symbols, runs of them count once."""
        s = self.symbol[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
        return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each times its count (exact: integers in doubles)."""
        out = np.zeros(self.dimensions)
        for i in range(0, len(codes), 2048):
            c = codes[i : i + 2048]
            bound = self.placed[0][c // (SYMBOLS * SYMBOLS)] * self.placed[1][c // SYMBOLS % SYMBOLS]
            bound *= self.placed[2][c % SYMBOLS]
            w = counts[i : i + 2048]
            out += w.astype(np.float32) @ bound.astype(np.float32) if w.sum() < 1 << 24 else w.astype(np.float64) @ bound
        return out

    def of_text(self, text: str | None) -> np.ndarray | None:
        """A text's vector, or None if it has no letter."""
        codes = self.trigrams(text) if text else np.empty(0, np.int32)
        return self.bundle(*np.unique(codes, return_counts=True)) if len(codes) else None


def letters() -> Letters:
    return worker_cache("letters", Letters)


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """One bundled vector per language from (lang, text); the languages are a small set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hd, total = letters(), {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                held, size = [], 0
                for t in texts:
                    held.append(hd.trigrams(t))
                    size += len(held[-1])
                    if size > CHUNK:
                        add(hd, total, lang, held)
                        held, size = [], 0
                if held:
                    add(hd, total, lang, held)
        if total:
            yield pd.DataFrame({"lang": [k for k, v in total.items() for _ in v], "i": [i for v in total.values() for i in range(len(v))], "x": [int(x) for v in total.values() for x in v]})

    def add(hd: Letters, total: dict[str, np.ndarray], lang: str, held: list[np.ndarray]) -> None:
        v = hd.bundle(*np.unique(np.concatenate(held), return_counts=True))
        total[lang] = total[lang] + v if lang in total else v

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang").agg(F.collect_list(F.struct("i", "x")).alias("v")).collect():
        v = np.zeros(DIMENSIONS)
        v[[e["i"] for e in r["v"]]] = [e["x"] for e in r["v"]]
        if v.any():
            out[r["lang"]] = v
    return dict(sorted(out.items()))


class Judge:
    """Languages and scores of texts, by cosine with the learned vectors."""

    def __init__(self, learned: dict[str, np.ndarray]):
        self.names = [*learned]
        self.unit = np.stack([v / np.linalg.norm(v) for v in learned.values()]) if learned else np.zeros((0, DIMENSIONS))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        hd, lang, score = letters(), [], []
        for t in texts:
            v = hd.of_text(t) if self.names else None
            n = 0.0 if v is None else float(np.linalg.norm(v))
            cosines = self.unit @ v / n if n else np.zeros(len(self.names))
            best = int(np.argmax(cosines)) if v is not None else -1
            lang.append(self.names[best] if best >= 0 else UNDETERMINED)
            score.append(float(min(1.0, max(0.0, cosines[best]))) if best >= 0 else 0.0)
        return lang, score


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` (doc_id, text, any others) as (doc_id, lang_pred, score)."""
    judge = Judge(learned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = judge(b["text"].where(b["text"].notna(), None).tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "lang_pred": lang, "score": score})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


#: Standard deviations of a cosine by chance (1 / sqrt(DIMENSIONS)) that an answer must exceed. A text that
#: has nothing to do with any of four languages does so about one time in twenty.
CHANCE = 2.25
#: Of the labelled documents with a right answer at most this share may fall below the bar.
RIGHT_BELOW = 0.001


def least_confidence(docs: DataFrame, learned: dict[str, np.ndarray], chance: float = CHANCE) -> float:
    """The cosine that an answer must reach: what chance reaches, or less where labelled documents
    (lang, text) with right answers lie below it. So profiles learned from little reject little.
    All labelled documents are judged; what the driver gets is two counts and one score."""
    judge = Judge(learned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = judge(b["text"].tolist())
            right = np.array(lang) == b["lang"].to_numpy()
            yield pd.DataFrame({"score": np.array(score)[right]})

    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    scores = cut(labelled.mapInPandas(run, "score double"), "scores")
    bar = chance / DIMENSIONS ** 0.5
    below = scores.filter(F.col("score") < bar)
    rank = math.ceil(scores.count() * RIGHT_BELOW)
    return value_at(below, "score", rank) if 0 < rank <= below.count() else bar


def determined(docs: DataFrame, learned: dict[str, np.ndarray], least: float = CHANCE / DIMENSIONS ** 0.5, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, as they are: those whose best cosine with a
    learned language is at least ``least`` and, with ``wanted``, whose language is one of these. With no
    learned language, those with a letter."""
    judge = Judge(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            if judge.names:
                told = [x != UNDETERMINED and s >= least and (wanted is None or x in wanted) for x, s in zip(*judge(texts))]
            else:
                told = [bool(t) and len(letters().trigrams(t)) > 0 for t in texts]
            yield b.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """True for the documents that training must not see; null ids are not trained on."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents that are not held out, applied to all."""
    docs = table(spark, sf_dir, "documents")
    learned = profiles(docs.filter(~held_out()))
    return identify(docs, learned).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
