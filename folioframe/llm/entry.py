"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .audit import OP11_SQL, op11_filter_audit
from .bpe import op8_token_counts
from .covertree import OP1_SQL, op1_cover_tree
from .decontamination import OP6_SQL, op6_decontamination
from .language import op7_language
from .lines import OP2_SQL, op2_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .packing import op5_token_output
from .simhash import op9_simhash
from .substrings import OP3_SQL, op3_substrings
from .toxicity import op10_toxicity
from .trie import OP13_SQL, op13_prefix_trie
from .warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_line_dedup": op2_line_dedup,
    "op3_substrings": op3_substrings,
    "op4_mixing": op4_mixing,
    "op5_token_output": op5_token_output,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = {
    "op1_cover_tree": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_substrings": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
