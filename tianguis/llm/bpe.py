"""BPE encoding and decoding by speculation and verification.

Each word is first cut by greedy longest match against the vocabulary. The
proposal equals the merge result exactly when every token is reproduced by
merging its own characters and every adjacent pair of tokens is compatible,
that is, no merge across the boundary would have come before the merges that
formed its two neighbours. Compatibility is tested for all pairs of a batch at
once with array operations; only words with a failing pair are merged one
merge at a time.

Null and empty texts give no tokens. Rows repeat as given; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tianguis.llm.common import PieceCache, table, worker_cache

#: The vocabulary file's word splitter, for ASCII text after lower-casing.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Latin letters with marks, among others.
LATIN = range(0xC0, 0x250)
END = "</w>"
#: White space of the vocabulary's normaliser; str.split() also cuts at \x1c-\x1f.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
EXTRA_SPLIT = re.compile("[\x1c-\x1f]")
NEVER = np.int64(1) << 60
NO_RANK = 1 << 60
#: Half of the pieces, and of the words, that a worker remembers.
CACHE_WORDS = 500_000
#: Up to this many symbols a word is merged by scanning its pairs, beyond by a heap.
SCAN_SYMBOLS = 48


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_spaces(text: str) -> list[str]:
    """Pieces between white space as the vocabulary's normaliser sees it."""
    if EXTRA_SPLIT.search(text):
        return [x for x in SPACE.split(text) if x]
    return text.split()


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, nothing else. Doing so before normalising changes no word and leaves fewer spellings to remember."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Splitter:
    """Words, in byte characters, of the pieces between white space, as the vocabulary file's own
    normaliser and splitter make them, whatever Python's tables say of letters, numbers and lower case.
    The Latin letters that the two leave single and whole are looked up once; pieces of these and ASCII are split here,
    any other piece by the two themselves. No character composes or joins a word across white space, so
    pieces can go alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.normalise, self.split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        for i in LATIN:
            low = self.normalise(f"a{chr(i)}a")[1:-1]
            if len(low) == 1 and ord(low) in LATIN and len(self.split(f"a{low}a")) == 1:
                self.low[i] = low
        known = "".join(map(chr, (i for i in self.low if i in LATIN)))
        letters = "a-z" + "".join(sorted({c for c in self.low.values() if not c.isascii()}))
        self.plain = re.compile(f"[\\x00-\\x7f{known}]+").fullmatch
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+").findall

    def __call__(self, piece: str) -> list[str]:
        if piece.isascii():
            piece = piece.lower()
            words = [piece] if piece.isalpha() else ASCII_WORD.findall(piece)
        elif self.plain(piece):
            words = self.words(piece.translate(self.low))
        else:
            return [w for w, _ in self.split(self.normalise(piece))]
        return [w if w.isascii() and w.isprintable() else "".join([CHARS[b] for b in w.encode()]) for w in words]


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself,
    the others follow from code point 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


CHARS = byte_chars()


class Bpe:
    """Vocabulary with merges, as arrays indexed by token id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.vocab = vocab
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max(max(vocab.values()), max(self.specials.values(), default=0))
        self.token = [""] * n
        for t, i in (*vocab.items(), *self.specials.items()):
            self.token[i] = t
        self.chars, self.words_of = CHARS, Splitter(path)
        self.rank = np.full(n, -1, np.int64)
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        pairs, self.merges = [], {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merges[a, b] = (r, c)
            pairs.append((a << 32 | b, r))
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = r, a, b
        codes = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_code, self.pair_rank = codes[:, 0].copy(), codes[:, 1].copy()
        self.sound = self._sound_tokens()
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.reach: dict[str, int] = {}
        for t in vocab:
            n = len(t) - len(END) if t.endswith(END) else len(t)
            self.reach[t[: min(2, n)]] = max(n, self.reach.get(t[: min(2, n)], 0))
        self.start = {c: vocab[c] for c in self.chars}
        self.stop = {c: vocab[c + END] for c in self.chars}
        self.words = PieceCache(CACHE_WORDS, self.encode_words)
        self.pieces = PieceCache(CACHE_WORDS, self.encode_pieces)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where(self.pair_code[at] == code, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether merging would leave the boundary between
        token ``a`` and token ``b`` alone.

        Walks back in merge order: the tokens that touch the boundary are taken
        apart, the later formed one first (of equal ranks the right one, formed
        last). A merge of the two touching tokens spoils the pair if its rank
        comes before the merge just undone; at an equal rank the leftmost place
        merges first."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        live = np.arange(len(a))
        while live.size:
            spoiled = self._ranks(a[live], b[live]) < limit[live]
            ok[live[spoiled]] = False
            live = live[~spoiled]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            apart = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[apart], ra[apart], rb[apart]
            undo_b = rb >= ra
            i, j = live[undo_b], live[~undo_b]
            limit[i], b[i] = rb[undo_b] + 1, self.left[b[i]]
            limit[j], a[j] = ra[~undo_b], self.right[a[j]]
        return ok

    def _sound_tokens(self) -> np.ndarray:
        """Tokens that merging their own characters gives back."""
        sound = self.rank < 0
        made = np.flatnonzero(self.rank >= 0)
        inner = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t, ok in sorted(zip(made, inner), key=lambda x: self.rank[x[0]]):
            sound[t] = ok and sound[self.left[t]] and sound[self.right[t]]
        return sound

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the byte characters of a word."""
        n, i, out, vocab, reach = len(word), 0, [], self.vocab, self.reach
        while i < n - 1:
            end = i + reach.get(word[i : i + 2], 1)
            if end >= n:
                if (t := vocab.get(word[i:] + END)) is not None:
                    out.append(t)
                    return out
                end = n - 1
            while (t := vocab.get(word[i:end])) is None:
                end -= 1
            out.append(t)
            i = end
        out.append(self.stop[word[i]])
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: always the pair of lowest rank, leftmost first."""
        ids = [self.start[c] for c in word[:-1]]
        ids.append(self.stop[word[-1]])
        return self._merge_scan(ids) if len(ids) <= SCAN_SYMBOLS else self._merge_heap(ids)

    def _merge_scan(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (NO_RANK, 0)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x, y][1], -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of byte-character words: propose, verify, repair."""
        out = [self.propose(w) for w in words]
        if not out:
            return out
        ids = np.fromiter((t for x in out for t in x), np.int64)
        owner = np.repeat(np.arange(len(out)), [len(x) for x in out])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(ids[inside] << 32 | ids[inside + 1], return_inverse=True)
        ok = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        for k in np.unique(np.concatenate([owner[~self.sound[ids]], owner[inside[~ok[back]]]])).tolist():
            out[k] = self.merge(words[k])
        return out

    def encode_pieces(self, pieces: list[str]) -> list[tuple[str, str]]:
        """(ids, decoded text), both joined by a space, of pieces between white space."""
        split = [self.words_of(p) for p in pieces]
        ids = self.words.of({w for ws in split for w in ws})
        token, out = self.token, []
        for ws in split:
            got = [t for w in ws for t in ids[w]]
            out.append((" ".join(map(str, got)), " ".join([token[t] for t in got])))
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space: the vocabulary file names no decoder."""
        return " ".join([self.token[i] for i in ids])

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special?, string): special token strings are cut out before normalising."""
        if self.special_split and "<|" in text:
            for k, part in enumerate(self.special_split.split(text)):
                if part:
                    yield k % 2 == 1, part
        else:
            yield False, text

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text, its ids and its decoded text, both joined by a space."""
        cut = [[[(p,)] if special else split_spaces(ascii_lower(p)) for special, p in self.segments(t)] for t in texts]
        known = self.pieces.of({p for parts in cut for ps in parts for p in ps if p.__class__ is str})
        for parts in cut:
            got = [(str(self.specials[p[0]]), p[0]) if p.__class__ is tuple else known[p] for ps in parts for p in ps]
            ids, text = zip(*got) if got else ((), ())
            yield " ".join(ids), " ".join(text)


def groups(rows: list, size: int, length) -> Iterator[list]:
    """Runs of rows whose lengths sum to about ``size``."""
    run, total = [], 0
    for r in rows:
        run.append(r)
        total += length(r)
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


def bpe_round_trip(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ids as decimal strings joined by a space and the
    text that decoding them gives, for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = vocab_path or default_vocab()
        bpe = worker_cache(f"bpe:{path}", lambda: Bpe(path))
        for b in batches:
            rows = list(zip(b["doc_id"], b["text"].fillna("")))
            for part in groups(rows, 2_000_000, lambda r: len(r[1])):
                got = list(bpe.encode_texts([t for _, t in part]))
                yield pd.DataFrame({"doc_id": pd.array([i for i, _ in part], "Int64"), "ids": [x for x, _ in got], "decoded": [y for _, y in got]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids string, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests.

    The digests are taken in the same pass, so that neither ids nor decoded
    texts leave the Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = default_vocab()
        bpe = worker_cache(f"bpe:{path}", lambda: Bpe(path))
        for b in batches:
            rows = list(zip(b["doc_id"], b["text"].fillna("")))
            for part in groups(rows, 2_000_000, lambda r: len(r[1])):
                out = [(i, x.count(" ") + 1 if x else 0, hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(y.encode("utf-8", "surrogatepass")).hexdigest())
                       for (i, _), (x, y) in zip(part, bpe.encode_texts([t for _, t in part]))]
                f = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                yield f.assign(doc_id=pd.array(f["doc_id"], "Int64"))

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
