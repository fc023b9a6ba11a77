"""Bounded-space online packing of token sequences.

Each input partition keeps a fixed number of open windows. A document's ids
fill whole windows first; its tail goes to the open window it fits best (the
smallest gap that holds it). When it fits none and no window may be opened,
the fullest window is emitted: if its gap is above ``slack``, the tail is cut
to fill the gap first. The windows still open at a partition's end are the
leftovers; groups of ``FAN`` partitions merge theirs with the same rule, level
by level, until one group is left. What that group cannot fill is emitted in
runs whose lengths are powers of two, which need no padding.

A null or empty text is a document of the closing id alone. Rows repeat as
given, each as a document of its own; columns other than id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.bpe import Splitter, ascii_lower, default_vocab, split_spaces
from tianguis.llm.common import cut, table, worker_cache

WINDOW = 4096
#: Open windows per partition.
OPEN_WINDOWS = 8
#: A window whose gap is at most this many ids is emitted without cutting a tail for it.
SLACK = 16
#: Partitions whose leftovers one task merges: at most FAN * OPEN_WINDOWS windows.
FAN = 32
END_ID = 2
#: Half of the pieces, and of the words, that a worker remembers.
CACHE_WORDS = 250_000
#: Below this many bits of a window's number count windows of one task; above them stand level and task.
WINDOW_BITS = 30

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
OUT = f"window long, closed boolean, part int, {FIELDS}, offset long, ids binary"


class Remembered(dict):
    """Values made on first use. About ``2 * half`` stay: when the young half is
    full (``turn``) it becomes the old one, and old keys still in use move back."""

    def __init__(self, half: int, make):
        self.half, self.make, self.old = half, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Ids of whole texts by the tokenizers library: each distinct word, as the
    vocabulary's word splitter cuts it, goes through the library's model once
    and is kept as little-endian bytes. A word of ASCII letters is a piece of its own and is kept
    among the pieces only."""

    def __init__(self, path: str, remembered: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words_of = Splitter(path)
        self.model = self.tokenizer.model.tokenize
        self.words = Remembered(remembered, self._word)
        self.pieces = Remembered(remembered, self._piece)

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model(word)], "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if "<|" in piece:  # may hold a special token, which is not normalised
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words_of(piece)
        if words == [piece]:
            return self._word(piece)
        return b"".join([self.pieces[w] if w.isascii() and w.isalpha() else self.words[w] for w in words])

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.words.turn()
        self.pieces.turn()
        known = self.pieces.__getitem__
        # a special token must be written in lower case, so texts that may hold one stay as they are
        return [b"".join(map(known, split_spaces(t if "<|" in t else ascii_lower(t)))) for t in texts]


class Packer:
    """The open windows of one task. Pieces are (doc_id, start, doc_tokens, ids)."""

    def __init__(self, prefix: int, open_windows: int = OPEN_WINDOWS, slack: int = SLACK):
        self.prefix, self.most, self.slack = prefix << WINDOW_BITS, open_windows, slack
        self.open: list[list] = []  # [used, pieces]
        self.done: list[tuple] = []
        self.made = 0

    def emit(self, pieces: list[tuple], closed: bool = True) -> None:
        at, window = 0, self.prefix + self.made
        self.made += 1
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.done.append((window, closed, doc, start, n, zlib.crc32(ids), total, at, None if closed else ids))
            at += n

    def add(self, doc: int | None, start: int, total: int, ids: bytes) -> None:
        while (n := len(ids) // 4) >= WINDOW:
            self.emit([(doc, start, total, ids[: 4 * WINDOW])])
            ids, start = ids[4 * WINDOW :], start + WINDOW
        if not n:
            return
        fits = [w for w in self.open if w[0] + n <= WINDOW]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.most:
            best = [0, []]
            self.open.append(best)
        else:
            best = max(self.open, key=lambda w: w[0])
            gap = WINDOW - best[0]
            if gap > self.slack:
                best[1].append((doc, start, total, ids[: 4 * gap]))
                ids, start = ids[4 * gap :], start + gap
            self.open.remove(best)
            self.emit(best[1])
            return self.add(doc, start, total, ids)
        best[1].append((doc, start, total, ids))
        best[0] += n
        if best[0] == WINDOW:
            self.open.remove(best)
            self.emit(best[1])

    def leave(self) -> None:
        """The open windows become leftovers."""
        for w in self.open:
            self.emit(w[1], closed=False)
        self.open = []

    def finish(self) -> None:
        """Close everything: windows that are full up to the slack as they are,
        the rest joined end to end and cut into whole windows and powers of two."""
        rest = []
        for w in sorted(self.open, key=lambda w: -w[0]):
            if WINDOW - w[0] <= self.slack:
                self.emit(w[1])
            else:
                rest += w[1]
        self.open = []
        left = sum(len(p[3]) // 4 for p in rest)
        while left:
            room = min(WINDOW, 1 << (left.bit_length() - 1))
            left -= room
            run = []
            while room:
                doc, start, total, ids = rest.pop(0)
                n = min(room, len(ids) // 4)
                run.append((doc, start, total, ids[: 4 * n]))
                if len(ids) > 4 * n:
                    rest.insert(0, (doc, start + n, total, ids[4 * n :]))
                room -= n
            self.emit(run)

    def take(self, part: int) -> pd.DataFrame:
        rows, self.done = self.done, []
        f = pd.DataFrame(rows, columns=["window", "closed", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "ids"])
        return f.assign(part=part, doc_id=pd.array(f["doc_id"], "Int64"))[[c.split()[0] for c in OUT.split(", ")]]


def merger(level: int, last: bool, open_windows: int, slack: int):
    """Packs the leftovers of ``FAN`` parts of the level below again."""

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        part = int(f["part"].iloc[0]) // FAN
        packer = Packer(level << 28 | part, open_windows, slack)
        f = f.sort_values(["window", "offset"])
        for i, start, total, ids in zip(f["doc_id"], f["start"], f["doc_tokens"], f["ids"]):
            packer.add(None if pd.isna(i) else int(i), int(start), int(total), bytes(ids))
        packer.finish() if last else packer.leave()
        return packer.take(part)

    return merge


def pack(docs: DataFrame, vocab_path: str | None = None, open_windows: int = OPEN_WINDOWS, slack: int = SLACK, remembered: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Workers remember about 2 * ``remembered`` pieces, and words, which costs memory and spares time."""
    docs = docs.select("doc_id", "text")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = vocab_path or default_vocab()
        encode = worker_cache(f"ids:{path}:{remembered}", lambda: WordIds(path, remembered))
        part = TaskContext.get().partitionId()
        packer, close = Packer(part, open_windows, slack), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            texts, ids = b["text"].fillna("").tolist(), [None if pd.isna(i) else int(i) for i in b["doc_id"]]
            for k in range(0, len(texts), 500):
                for i, e in zip(ids[k : k + 500], encode(texts[k : k + 500])):
                    packer.add(i, 0, len(e) // 4 + 1, e + close)
                yield packer.take(part)
        packer.leave()
        yield packer.take(part)

    made = cut(docs.mapInPandas(first, OUT), "pack")
    parts = 1 + (made.agg(F.max("part")).first()[0] or 0)
    done, level = [made.filter("closed")], 0
    while True:
        level += 1
        last = parts <= FAN

        merged = made.filter("NOT closed").groupBy(F.expr(f"part div {FAN}").alias("group")).applyInPandas(merger(level, last, open_windows, slack), OUT)
        made = merged if last else cut(merged, "pack")
        done.append(made.filter("closed"))
        if last:
            break
        parts = -(-parts // FAN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
