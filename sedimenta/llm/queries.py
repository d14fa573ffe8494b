"""The queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .chat import op4_chat
from .jaccard import op1_jaccard
from .language import op8_language
from .neighbours import op10_neighbours
from .lm import op5_lm
from .oracles import ORACLE_SQL
from .packing import op6_packing
from .pieces import op9_pieces
from .quality import op3_quality
from .substrings import op2_substrings
from .urls import op7_urls

QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_substrings": op2_substrings,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_lm": op5_lm,
    "op6_packing": op6_packing,
    "op7_urls": op7_urls,
    "op8_language": op8_language,
    "op9_pieces": op9_pieces,
    "op10_neighbours": op10_neighbours,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
