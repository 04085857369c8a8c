"""The queries of this subpackage by name, and SQL for those that DuckDB can express in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations_sql, sql
from .html import op7_html
from .jpeg import op1_progressive_jpeg
from .language import op13_language_id
from .mixing import op8_mixing
from .packing import op3_packing
from .parsing import op2_parsing
from .repair import op11_structure_repair
from .secrets import op10_secrets
from .simhash import op5_simhash
from .substrings import op9_substrings
from .suffixes import op4_suffix_dedup
from .toxicity import op6_toxicity
from .trie import op12_prefix_trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_progressive_jpeg, op2_parsing, op3_packing, op4_suffix_dedup, op5_simhash,
        op6_toxicity, op7_html, op8_mixing, op9_substrings, op10_secrets,
        op11_structure_repair, op12_prefix_trie, op13_language_id,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB can express a query; the others have models, rounding draws, packings or hashes that it lacks."""
    return {"op4_suffix_dedup": sql.OP4, "op9_substrings": sql.OP9, "op10_secrets": sql.OP10, "op11_structure_repair": conversations_sql.OP11, "op12_prefix_trie": conversations_sql.OP12}
