"""Reduce a child table to the rows that may belong to a slice of its parent, before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in one row of the filter.
WORDS = 32
#: Bits of one row.
ROW_BITS = 64 * WORDS


def keep_matching(child: DataFrame, parent: DataFrame, key: str, bits: int = 27) -> DataFrame:
    """The rows of ``child`` whose ``key`` may be among the keys of ``parent``, by a
    Bloom filter with one hash function and 2**``bits`` bits. No matching row is lost;
    of the others a share of about 1 - exp(-keys / 2**bits) stays, for a later join to drop.

    Only the keys of ``parent`` are shuffled, once. The filter is broadcast: it has at most
    2**bits / 2,048 rows of about 310 bytes (20 MB for 27 bits), whatever the sizes of the tables.
    ``child`` is read, filtered and passed on in one stage, so what later crosses the network
    falls with the slice. A NULL key never matches."""
    if not 15 <= bits <= 31:
        raise ValueError("a filter has between 2**15 and 2**31 bits (at most 320 MB are broadcast)")
    hashed = f"pmod(xxhash64(`{key}`), {1 << bits}L)"
    at = (parent.where(F.col(key).isNotNull()).selectExpr(f"{hashed} AS _h")
          .selectExpr(f"CAST(_h DIV {ROW_BITS} AS INT) AS _row", f"CAST(_h DIV 64 % {WORDS} AS INT) AS _word", "shiftleft(1L, CAST(_h % 64 AS INT)) AS _bits"))
    words = [F.expr(f"coalesce(bit_or(CASE WHEN _word = {i} THEN _bits END), 0L)") for i in range(WORDS)]
    rows = at.repartition("_row").groupBy("_row").agg(F.array(*words).alias("_words"))
    probe = child.where(F.col(key).isNotNull()).selectExpr("*", f"{hashed} AS _h").selectExpr("*", f"CAST(_h DIV {ROW_BITS} AS INT) AS _row")
    hit = probe.join(F.broadcast(rows), "_row").where(f"bit_get(_words[CAST(_h DIV 64 % {WORDS} AS INT)], CAST(_h % 64 AS INT)) = 1")
    return hit.select(*child.columns)
