"""Personal data in texts: fixed patterns, extended by a skip-chain conditional
random field.

Patterns give the base spans. The field's nodes are the words that hold a digit
or an @; its labels are the kinds and none. Words that follow each other share
a chain potential. Distant words of one document whose letters and digits are the same
share a skip potential: each is tied to the next such word and to the first
(one with a base label where there is any), so that the
number of edges grows with the number of words. Similar words share it too: one with letters that is a
single edit away from a labelled one; and runs of digit words, however the digits are grouped, that end
in the same seven digits as a labelled phone or card number and continue it to the left, but for a leading
zero; their words are tied from the right. Loopy message passing then spreads labels:
a number written once in a form that the patterns know labels its other mentions. Base spans
are evidence and never change. A run of following words that the field labels alike (with a
probability over ``CERTAIN``) adds a span if a skip edge ties one of them to a
base span: without a mention that the patterns know, nothing is added.

All potentials are estimated from counts over all documents, with the base labels as
teacher: word shapes and preceding words (hashed to a fixed number of
buckets) per label, label pairs along chains, and how often equal words agree.
Words that the patterns missed although an equal one has a label count as
unobserved: they are what the field is for.

A null text is empty and has no spans. Repeated rows are returned each.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby, zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "none")
NONE = len(KINDS)
#: Kinds whose digits may be grouped otherwise elsewhere.
NUMBERS = (KINDS.index("card"), KINDS.index("phone"))
#: Hash buckets for word shapes and for preceding words.
BUCKETS = 4096
#: Least letters and digits of words that a skip edge ties, if they are the same, and if they are one edit apart.
SKIP_LENGTH = 5
SIMILAR_LENGTH = 8
#: Last digits in which two writings of a number agree.
TAIL = 7
ROUNDS = 12
DAMPING = 0.3
CERTAIN = 0.5
#: Log weight that holds base labels in place.
EVIDENCE = 30.0
#: Words (nodes) of one message-passing batch.
BATCH_NODES = 50_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Leftmost matches start where a run of digits starts, so each run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGNAL = re.compile("[0-9@]")
PUNCTUATION = re.compile(r"[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+\Z")
NOT_WORD = re.compile(r"[\W_]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, back to the end of
    the match before, and the dotted name after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind and start; matches that fail their check are dropped."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS


DIGITS, LETTERS, REPEATED = re.compile("[0-9]+"), re.compile(r"[^\W\d_]+"), re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Character classes of the whole word with runs collapsed, and the number of digits."""
    digits = sum(map(len, DIGITS.findall(word)))
    return REPEATED.sub(r"\1", LETTERS.sub("a", DIGITS.sub("0", word))) + f" {min(digits, 20)}"


#: Base of the rolling hash of words, and its inverse, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def edit_hashes(key: str) -> tuple[np.uint64, np.ndarray]:
    """A rolling hash of a word, and of the word without each of its characters."""
    c = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(c) - 1, BASE)], dtype=np.uint64)
    before = np.r_[np.uint64(0), np.cumsum(c * powers, dtype=np.uint64)]
    return before[-1], before[:-1] + (before[-1] - before[1:]) * INVERSE


def one_edit(a: str, b: str) -> bool:
    """Whether one character put in, left out or replaced makes ``b`` of ``a``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long_ = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(short, long_)) if x != y), len(short))
    return short[k + (len(a) == len(b)) :] == long_[k + 1 :]


def similar(known: dict[str, int], others: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
    """(labelled node, node) of the words one edit apart from a labelled one, by the hashes of
    both with one character left out: the work grows with the lengths of the words, not their pairs."""
    if not known or not others:
        return
    whole: dict[int, str] = {}
    less: dict[int, str] = {}
    for key in known:
        h, gaps = edit_hashes(key)
        whole.setdefault(int(h), key)
        for g in gaps.tolist():
            less.setdefault(g, key)
    for key, nodes in others.items():
        h, gaps = edit_hashes(key)
        near = {less.get(int(h)), *(t.get(g) for g in gaps.tolist() for t in (whole, less))} - {None}
        hub = min((known[x] for x in near if one_edit(key, x)), default=None)
        if hub is not None:
            yield from ((hub, k) for k in nodes)


def same_number(a: str, b: str) -> bool:
    """Whether two digit strings can be one number: one continues the other to the left, but for leading zeros."""
    x, y = a.lstrip("0"), b.lstrip("0")
    return min(len(x), len(y)) >= TAIL and (x.endswith(y) or y.endswith(x))


class Words:
    """The nodes of some documents: place, features, base label, chain and skip edges."""

    def __init__(self) -> None:
        self.start: list[int] = []
        self.end: list[int] = []
        self.label: list[int] = []  # of the base; NONE without
        self.shape: list[int] = []
        self.cue: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def tie_numbers(self, runs: list[list[tuple[int, str]]]) -> None:
        """Skip edges between a labelled number and later or earlier writings of it without a label.
        ``runs`` hold following words without letters: (node, digits)."""
        hubs: dict[str, dict[str, list[int]]] = {}
        loose: list[list[tuple[int, str]]] = []
        for run in runs:
            for label, part in groupby(run, key=lambda x: self.label[x[0]]):
                part = list(part)
                if label == NONE:
                    loose.append(part)
                elif label in NUMBERS and len(digits := "".join([d for _, d in part])) >= TAIL:
                    hubs.setdefault(digits[-TAIL:], {}).setdefault(digits, [k for k, _ in part])
        if not hubs:
            return
        for run in loose:
            j = len(run) - 1
            while j >= 0:
                best, digits, i = None, "", j
                while i >= 0 and len(digits) < 20:
                    digits = run[i][1] + digits
                    hub = next((h for d, h in hubs.get(digits[-TAIL:], {}).items() if same_number(digits, d)), None) if len(digits) >= TAIL else None
                    best = (i, hub) if hub else best
                    i -= 1
                if best:
                    i, hub = best
                    mine = [k for k, _ in run[i : j + 1]]
                    for a, b in zip_longest(reversed(mine), reversed(hub)):
                        self.skip.append((hub[0] if b is None else b, mine[0] if a is None else a))
                    j = i
                j -= 1

    def add(self, text: str, base: list[Span]) -> range:
        """Append a document's nodes."""
        first, places = len(self.start), sorted(base, key=lambda s: (s[1], s[2]))
        starts = [s for _, s, _ in places]
        reach = [e for _, _, e in places]
        for i in range(1, len(reach)):
            reach[i] = max(reach[i], reach[i - 1])
        same: dict[str, list[int]] = {}
        runs: list[list[tuple[int, str]]] = []
        numbers = False  # whether the word before belongs to the last run
        done, n = 0, len(text)
        for m in SIGNAL.finditer(text):
            if m.start() < done:
                continue
            s, e = m.start(), m.end()
            while s > done and not text[s - 1].isspace():
                s -= 1
            while e < n and not text[e].isspace():
                e += 1
            word, node = text[s:e], len(self.start)
            follows = node > first and text[self.end[-1] : s].isspace()
            i = bisect_left(starts, e) - 1  # the last span that begins before the word's end
            label = NONE
            while i >= 0 and reach[i] > s:
                if places[i][2] > s:
                    label = places[i][0]
                    break
                i -= 1
            b = s
            while b > 0 and text[b - 1].isspace() and s - b < 4:
                b -= 1
            a = b
            while a > 0 and not text[a - 1].isspace() and b - a < 16:
                a -= 1
            self.start.append(s)
            self.end.append(e)
            self.label.append(label)
            self.shape.append(bucket(shape(word)))
            self.cue.append(bucket(NOT_WORD.sub("", text[a:b]).lower()))
            if follows:
                self.chain.append((node - 1, node))
            key = NOT_WORD.sub("", word).lower()
            if len(key) >= SKIP_LENGTH:
                same.setdefault(key, []).append(node)
            if key.isdigit() and key.isascii():
                if not (follows and numbers):
                    runs.append([])
                runs[-1].append((node, key))
            numbers = key.isdigit() and key.isascii()
            done = e
        for nodes in same.values():
            if len(nodes) > 1:
                hub = next((k for k in nodes if self.label[k] != NONE), nodes[0])
                self.skip += list(zip(nodes, nodes[1:]))
                self.skip += [(hub, k) for k in nodes if k != hub]
        if base:
            long_ = {k: v for k, v in same.items() if len(k) >= SIMILAR_LENGTH and not k.isdigit()}
            known = {k: next(x for x in v if self.label[x] != NONE) for k, v in long_.items() if any(self.label[x] != NONE for x in v)}
            self.skip += similar(known, {k: v for k, v in long_.items() if k not in known})
            self.tie_numbers(runs)
        return range(first, len(self.start))

    def anchored(self) -> set[int]:
        """Nodes without a base label that a skip edge ties to one with a base label."""
        label = self.label
        out = {b for a, b in self.skip if label[a] != NONE and label[b] == NONE}
        return out | {a for a, b in self.skip if label[b] != NONE and label[a] == NONE}


def counts(docs: DataFrame) -> dict[str, np.ndarray]:
    """Label counts for the potentials over all documents: a table of fixed size."""
    sizes = {"shape": BUCKETS * len(LABELS), "cue": BUCKETS * len(LABELS), "chain": len(LABELS) ** 2, "skip": 2}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
        for b in batches:
            words = Words()
            for t in b["text"]:
                if t and SIGNAL.search(t):
                    words.add(t, base_spans(t))
                if len(words.start) >= BATCH_NODES:
                    count(words, total)
                    words = Words()
            count(words, total)
        rows = [(k, int(i), int(v[i])) for k, v in total.items() for i in np.flatnonzero(v)]
        if rows:
            yield pd.DataFrame(rows, columns=["what", "i", "n"])

    def count(words: Words, total: dict[str, np.ndarray]) -> None:
        if not words.start:
            return
        label, k = np.array(words.label), len(LABELS)
        hidden = np.zeros(len(label), bool)
        hidden[list(words.anchored())] = True
        for what, f in (("shape", words.shape), ("cue", words.cue)):
            total[what] += np.bincount((np.array(f) * k + label)[~hidden], minlength=sizes[what])
        for what, edges in (("chain", words.chain), ("skip", words.skip)):
            if edges:
                a, b = np.array(edges).T
                seen = ~(hidden[a] | hidden[b])
                a, b = a[seen], b[seen]
                code = label[a] * k + label[b] if what == "chain" else (label[a] == label[b]).astype(int)
                total[what] += np.bincount(code, minlength=sizes[what])

    out = {k: np.zeros(n) for k, n in sizes.items()}
    for r in docs.select("text").mapInPandas(run, "what string, i int, n long").groupBy("what", "i").agg(F.sum("n").alias("n")).collect():
        out[r["what"]][r["i"]] = r["n"]
    return out


class Field:
    """The potentials, and message passing."""

    def __init__(self, n: dict[str, np.ndarray]):
        k = len(LABELS)
        shapes, cues = n["shape"].reshape(BUCKETS, k) + 0.1, n["cue"].reshape(BUCKETS, k) + 1.0
        prior = shapes.sum(axis=0)
        self.shape = np.log(shapes / shapes.sum(axis=1, keepdims=True))
        lift = np.log(cues / cues.sum(axis=0)) - np.log(cues.sum(axis=1, keepdims=True) / cues.sum())
        self.cue = np.clip(lift, -2, 2)
        chain = n["chain"].reshape(k, k) + 1.0
        self.chain = np.clip(np.log(chain / chain.sum()) - np.log(chain.sum(axis=1, keepdims=True) / chain.sum()) - np.log(chain.sum(axis=0, keepdims=True) / chain.sum()), -3, 3)
        agree = (n["skip"][1] + 8.0) / (n["skip"].sum() + 9.0)
        self.skip = np.full((k, k), np.log((1 - agree) / (k - 1))) + np.eye(k) * (np.log(agree) - np.log((1 - agree) / (k - 1)))
        self.prior = np.log(prior / prior.sum())

    def beliefs(self, w: Words) -> np.ndarray:
        """Label probabilities of the nodes."""
        unary = self.shape[w.shape] + self.cue[w.cue]
        label = np.array(w.label)
        known = label != NONE
        unary[known, label[known]] += EVIDENCE
        edges = np.array([*w.chain, *w.skip], np.int64).reshape(-1, 2)
        # Messages both ways: 2e along the edge, 2e + 1 back.
        src, dst = edges.ravel(), edges[:, ::-1].ravel()
        psi = np.empty((len(src), len(LABELS), len(LABELS)))
        psi[: 2 * len(w.chain) : 2], psi[1 : 2 * len(w.chain) : 2] = self.chain, self.chain.T
        psi[2 * len(w.chain) :] = self.skip
        back = np.arange(len(src)) ^ 1
        msg, total = np.zeros((len(src), len(LABELS))), unary
        for _ in range(ROUNDS if len(src) else 0):
            x = (total[src] - msg[back])[:, :, None] + psi
            top = x.max(axis=1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(x - top).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
            total = unary + np.stack([np.bincount(dst, msg[:, j], len(unary)) for j in range(len(LABELS))], axis=1)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """A span without the punctuation around it."""
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while s < e and not (text[e - 1].isalnum() or text[e - 1] == ")"):
        e -= 1
    return s, e


def added_spans(text: str, words: Words, nodes: range, p: np.ndarray, base: list[Span], joined: set[tuple[int, int]], anchored: set[int]) -> list[Span]:
    """Runs of following words with one likely label, tied to a base span and apart from all of them."""
    out: list[Span] = []
    run: list[int] = []
    kind = NONE

    def close() -> None:
        s, e = trimmed(text, words.start[run[0]], words.end[run[-1]])
        if s < e and not anchored.isdisjoint(run) and not any(b < e and s < x for _, b, x in base):
            out.append((kind, s, e))

    best = p[nodes.start : nodes.stop].argmax(axis=1).tolist()
    for node, k in zip(nodes, best):
        if words.label[node] != NONE or p[node, k] < CERTAIN:
            k = NONE
        if run and (k != kind or (run[-1], node) not in joined):
            close()
            run = []
        kind = k
        if k != NONE:
            run.append(node)
    if run:
        close()
    return out


def spans_of(texts: list[str], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text, sorted by kind and start. Message
    passing runs over many documents at once; no edge joins two of them."""
    base = [base_spans(t) if SIGNAL.search(t) else [] for t in texts]
    spans = [list(x) for x in base]
    words: Words = Words()
    held: list[tuple[int, range]] = []

    def settle() -> None:
        p, joined, anchored = field.beliefs(words), set(words.chain), words.anchored()
        for i, nodes in held:
            spans[i] += added_spans(texts[i], words, nodes, p, base[i], joined, anchored)

    for i, t in enumerate(texts):
        if SIGNAL.search(t):
            held.append((i, words.add(t, base[i])))
        if len(words.start) >= BATCH_NODES:
            settle()
            words, held = Words(), []
    if words.start:
        settle()
    return [sorted(x) for x in base], [sorted(x) for x in spans]


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, spans) of every row: base spans and all spans as arrays of
    (kind, start, end) by kind and start, in code points, ends exclusive."""

    def packed(found: list[list[Span]]) -> list[list[dict]]:
        return [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, spans = spans_of(b["text"].fillna("").tolist(), field)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "base": packed(base), "spans": packed(spans)})

    span = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, f"doc_id long, base {span}, spans {span}")


def redacted(text: str, spans: list[Span]) -> str:
    """A text with each span replaced by its kind in brackets; spans that overlap
    are replaced as one, by the first one's kind."""
    out, end, kind, start = [], 0, None, 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if kind is not None and s < end:
            end = max(end, e)
            continue
        if kind is not None:
            out.append(f"[{KINDS[kind].upper()}]")
        out.append(text[end:s])
        start, end, kind = s, e, k
    if kind is not None:
        out.append(f"[{KINDS[kind].upper()}]")
    out.append(text[end:])
    return "".join(out)


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span replaced, and n_chars, where there, to match the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            _, spans = spans_of([t or "" for t in texts], field)
            new = [redacted(t, x) if x else t for t, x in zip(texts, spans)]
            columns = dict(zip(b.schema.names, b.columns))
            columns["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in columns:
                was, kind = columns["n_chars"].to_pylist(), b.schema.field("n_chars").type
                columns["n_chars"] = pa.array([len(t) if x else n for t, n, x in zip(new, was, spans)], kind)
            yield pa.RecordBatch.from_arrays([*columns.values()], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, Field(counts(docs)))
    listed = "concat_ws(',', transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    n = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(F.expr(listed.format("base")), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))
