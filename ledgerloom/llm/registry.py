"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op4_byte_bpe
from .chat_format import OP11_SQL, op11_chat_format
from .credentials import OP1_SQL, op1_secret_scan
from .fingerprints import op2_document_fingerprints
from .packing import op3_best_fit_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .pseudonyms import op7_feistel_pseudonyms
from .quality import op6_quality_classifier
from .simhash import op5_simhash_near_dedup
from .spelling import OP12_SQL, op12_spelling_variants
from .token_files import op8_token_files
from .topk import OP9_SQL, op9_exact_topk
from .url_rules import OP10_SQL, op10_url_filters

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
    "op8_token_files": op8_token_files,
    "op9_exact_topk": op9_exact_topk,
    "op10_url_filters": op10_url_filters,
    "op11_chat_format": op11_chat_format,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_secret_scan": OP1_SQL,
    "op9_exact_topk": OP9_SQL,
    "op10_url_filters": OP10_SQL,
    "op11_chat_format": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
