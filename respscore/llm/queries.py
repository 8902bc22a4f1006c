"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .align import op12_alignment
from .chat import OP8_SQL, op8_chat_formatting
from .collocations import OP13_SQL, op13_collocations
from .counts import op2_separator_scan
from .decontaminate import OP11_SQL, op11_decontamination
from .idfiles import op6_packed_ids
from .linededup import OP9_SQL, op9_line_dedup
from .mixing import op10_mixing
from .multiset import op3_multiset_fingerprints
from .piecebpe import op7_piece_bpe
from .quality import OP4_SQL, op4_quality_rules
from .simhash import op1_simhash
from .suffix import op5_suffix_array

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_separator_scan": op2_separator_scan,
    "op3_multiset_fingerprints": op3_multiset_fingerprints,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_array": op5_suffix_array,
    "op6_packed_ids": op6_packed_ids,
    "op7_piece_bpe": op7_piece_bpe,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {"op4_quality_rules": OP4_SQL, "op8_chat_formatting": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_decontamination": OP11_SQL,
              "op13_collocations": OP13_SQL}
