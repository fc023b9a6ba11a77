r"""Spelling variants by dense prefix-suffix tiling.

Words are counted over all texts. Two words are one edit apart exactly when the length of their
common prefix plus that of their common suffix reaches the longer length minus one. A tile is a
block of words against another, as padded matrices of code points, written forwards for
prefixes and backwards for suffixes; one comparison of two matrices gives the lengths for all its pairs.

Which blocks meet: of two words one edit apart, the shorter of m letters, the first m div 2 letters
or the last m - m div 2 agree, as the one edit lies in one half only. Words that share a half
form a group; a word of length L is in the groups of m = L (with words as long or one longer) and of m = L - 1.
Groups of more than ``LOT`` words are cut into lots and every two lots make a tile. A pair counts in its
prefix group, and in its suffix group only if the prefixes differ, so it counts once. A tile
returns, per word, the number of its near words and the best of them: pairs never become rows.

A word's form is its near word of largest count (ties: the smallest), if it occurs at least twice as often.
Forms at least double the count, so following them ends; it is done by pointer doubling.

Words are runs of ``[A-Za-zÀ-ÿ]``, A-Z lower-cased. A null text has none; a null doc_id counts as an empty
string in the hash. Repeated rows count each; with no words there are no rows. Other columns are ignored.
Words may be as long as a text: tiles are compared in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import cut, table

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the (document, run) pairs one in so many loses a letter, by a hash.
DAMAGE = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs at least so many times as often.
FORM_RATIO = 2
#: Words of a lot (of up to 32 letters; a lot has about 32 * LOT letters): a tile has LOT by LOT pairs.
LOT = 1024
#: Letters that one task of the comparison gets, about.
LETTERS_A_TASK = 400_000
#: Code points compared at a time.
CHUNK = 1 << 22


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH letters with their occurrences, at least LEAST_COUNT.
    Occurrences are summed per task before they are shuffled, a text's runs first per text."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGE == 0, less).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def tiles(words: DataFrame) -> DataFrame:
    """(task, half, m, i, j, lot, id, word, n): the words of each tile; ``half`` names its group."""
    sides = []
    for m in ("length(word)", "length(word) - 1"):
        sides += [F.expr(f"named_struct('half', concat('<', left(word, ({m}) DIV 2)), 'm', {m})"),
                  F.expr(f"named_struct('half', concat('>', right(word, {m} - ({m}) DIV 2)), 'm', {m})")]
    keyed = words.select("id", "word", "n", F.explode(F.array(*sides)).alias("k")).select("k.half", "k.m", "id", "word", "n")
    sizes = keyed.groupBy("half", "m").agg(F.count("*").alias("size")).filter("size > 1")
    lots = F.ceil(F.col("size") * F.greatest("m", F.lit(32)) / (32 * LOT)).cast("int")  # longer words, smaller lots
    keyed = keyed.join(sizes, ["half", "m"]).withColumn("lots", lots).withColumn("lot", F.expr("CAST(pmod(xxhash64(id), lots) AS INT)"))
    met = keyed.select("*", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("with"))
    return met.select("half", "m", F.least("lot", "with").alias("i"), F.greatest("lot", "with").alias("j"), "lot", "id", "word", "n")


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, one row each, filled up with zeros."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which two matrices agree, row by row."""
    apart = a != b
    return np.where(apart.any(axis=1), apart.argmax(axis=1), a.shape[1])


def partners(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``t``, sorted by tile and lot, the range of rows it meets: within one lot the rows
    after it, between two lots the rows of the second for those of the first."""
    n = len(t)
    at, i, j, lot = np.arange(n), t["i"].to_numpy(), t["j"].to_numpy(), t["lot"].to_numpy()
    half = t["half"].to_numpy()
    new = np.r_[True, (half[1:] != half[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    tile, start = np.cumsum(new) - 1, np.flatnonzero(new)
    end = np.r_[start[1:], n][tile]
    ones = np.bincount(tile, lot == i).astype(np.int64)
    first = np.where(i == j, at + 1, start[tile] + ones[tile])
    return first, np.where((i == j) | (lot == i), end, first)


def near_pairs(t: pd.DataFrame, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of the near pairs in the tiles of ``t`` whose shorter word has ``m`` letters."""
    words = t["word"].tolist()
    size = np.array([len(w) for w in words])
    by_head = np.array([h[0] == "<" for h in t["half"]])
    forward, backward = codes(words, m + 1), codes([w[::-1] for w in words], m + 1)
    first, end = partners(t)
    met = end - first
    done, step = np.r_[0, np.cumsum(met)], max(1, CHUNK // (m + 1))
    for at in range(0, int(done[-1]), step):
        pair = np.arange(at, min(at + step, int(done[-1])))
        a = np.searchsorted(done, pair, side="right") - 1
        b = first[a] + pair - done[a]
        fit = np.minimum(size[a], size[b]) == m
        a, b = a[fit], b[fit]
        prefix = np.minimum(agreeing(forward[a], forward[b]), m)
        suffix = np.minimum(agreeing(backward[a], backward[b]), m)
        near = (prefix + suffix >= np.maximum(size[a], size[b]) - 1) & ((prefix >= m // 2) == by_head[a])
        yield a[near], b[near]


def compared(f: pd.DataFrame) -> pd.DataFrame:
    """(id, n_near, best_n, best) of the words that have near words in the tiles of one task."""
    out = []
    for m, t in f.sort_values(["m", "half", "i", "j", "lot"], kind="stable").groupby("m", sort=False):
        words, n, ids = t["word"].to_numpy(), t["n"].to_numpy(), t["id"].to_numpy()
        for a, b in near_pairs(t, int(m)):
            x, y = np.r_[a, b], np.r_[b, a]
            out.append(pd.DataFrame({"id": ids[x], "best_n": n[y], "best": words[y]}))
    if not out:
        return pd.DataFrame([], columns=["id", "n_near", "best_n", "best"])
    found = pd.concat(out).sort_values(["id", "best_n", "best"], ascending=[True, False, True], kind="stable")
    count = found.groupby("id", sort=False).size()
    return found.drop_duplicates("id").assign(n_near=count.to_numpy())[["id", "n_near", "best_n", "best"]]


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form) that have one: pointers are doubled until
    all point at a word without a form."""
    step = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = cut(step.join(ends, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            return step


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text)."""
    return of_words(cut(counted(docs), "words"))


def of_words(words: DataFrame) -> DataFrame:
    """The same from a table of distinct words with their counts (word, n)."""
    words = cut(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    met = tiles(words)
    rows = cut(met, "tiles")
    tasks = 1 + (rows.agg(F.sum(F.length("word"))).first()[0] or 0) // LETTERS_A_TASK
    lots = rows.withColumn("task", F.expr(f"pmod(xxhash64(half, m, i, j), {tasks})"))
    some = lots.groupBy("task").applyInPandas(lambda f: compared(f), "id long, n_near long, best_n long, best string")
    best = some.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    form = F.when(-F.col("b.m") >= FORM_RATIO * F.col("n"), F.col("b.best"))
    known = cut(words.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("b.m")).alias("form_n")), "forms")
    return known.join(roots(known), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: CRC-32 of a string in DuckDB: the table by its rule, then a fold over the UTF-8 bytes.
CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS x(i)))"


def crc_sql(text: str, crc_table: str) -> str:
    """The unsigned CRC-32 of ``text`` as a DuckDB expression, given the name of the table's list."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, o: xor(c >> 8, {crc_table}[1 + (xor(c, o) & 255)]), 4294967295), 4294967295)"


ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t), run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), told AS (SELECT id, run, count(*) AS n FROM run WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run
), hashed AS (SELECT run, n, {crc_sql("id || ':' || run", "t")} AS h FROM told, crc
), w AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY word HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}
), gap AS (
  SELECT word, n, pos, left(word, pos::INT) || substr(word, pos::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM w)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM gap a JOIN gap b ON a.pos = b.pos AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gap a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gap a JOIN w b ON a.rest = b.word
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FORM_RATIO} * w.n THEN other END AS form, CASE WHEN m >= {FORM_RATIO} * w.n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS last FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.last WHERE forms.form IS NOT NULL
)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms r ON r.word = c.last WHERE r.form IS NULL
"""
