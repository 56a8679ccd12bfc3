"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scribelens.llm import exact_dedup, lexical, line_dedup, merkle, substrings, url_filter
from scribelens.llm.cover_tree import op5_cover_tree
from scribelens.llm.exact_dedup import op8_exact_dedup
from scribelens.llm.lexical import op12_lexical_search
from scribelens.llm.line_dedup import op4_line_dedup
from scribelens.llm.merkle import op11_merkle_manifest
from scribelens.llm.packing import op6_packing
from scribelens.llm.pieces import op10_sentencepiece
from scribelens.llm.quality import op3_quality
from scribelens.llm.sharding import op7_sharding
from scribelens.llm.simhash import op9_simhash
from scribelens.llm.substrings import op13_substring_dedup
from scribelens.llm.token_counts import op1_token_counts
from scribelens.llm.url_filter import op2_url_filter


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_url_filter": op2_url_filter,
        "op3_quality": op3_quality,
        "op4_line_dedup": op4_line_dedup,
        "op5_cover_tree": op5_cover_tree,
        "op6_packing": op6_packing,
        "op7_sharding": op7_sharding,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_simhash": op9_simhash,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_lexical_search": op12_lexical_search,
        "op13_substring_dedup": op13_substring_dedup,
    }


def llm_oracles() -> dict[str, str]:
    """Queries without an entry have no SQL equivalent; tests compare them with brute force."""
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op4_line_dedup": line_dedup.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
        "op13_substring_dedup": substrings.ORACLE,
    }
