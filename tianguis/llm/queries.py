"""Registered queries of the corpus operators: key -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tianguis.llm import ann, chat, licenses, mixing, near_dedup, trie, vafile, variants
from tianguis.llm.ann import op3_ann
from tianguis.llm.bpe import op9_bpe
from tianguis.llm.chat import op5_chat
from tianguis.llm.language import op6_langid
from tianguis.llm.licenses import op8_licenses
from tianguis.llm.mixing import op11_mixing
from tianguis.llm.near_dedup import op10_minhash
from tianguis.llm.packing import op2_packing
from tianguis.llm.pii import op1_pii
from tianguis.llm.trie import op13_trie
from tianguis.llm.urls import op4_urls
from tianguis.llm.vafile import op7_topk
from tianguis.llm.variants import op12_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_ann": op3_ann,
    "op4_urls": op4_urls,
    "op5_chat": op5_chat,
    "op6_langid": op6_langid,
    "op7_topk": op7_topk,
    "op8_licenses": op8_licenses,
    "op9_bpe": op9_bpe,
    "op10_minhash": op10_minhash,
    "op11_mixing": op11_mixing,
    "op12_variants": op12_variants,
    "op13_trie": op13_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ann": ann.ORACLE,
    "op5_chat": chat.ORACLE,
    "op7_topk": vafile.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op10_minhash": near_dedup.ORACLE,
    "op11_mixing": mixing.ORACLE,
    "op12_variants": variants.ORACLE,
    "op13_trie": trie.ORACLE,
}
