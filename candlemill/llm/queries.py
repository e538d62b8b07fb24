"""Queries over the text operators, one for each, and SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op3_byte_bpe
from .decontaminate import op2_decontamination
from .fill_middle import SQL as FILL_MIDDLE_SQL
from .fill_middle import op11_fill_middle
from .fingerprint import op6_winnow_fingerprints
from .hard_negatives import SQL as HARD_NEGATIVES_SQL
from .hard_negatives import op12_hard_negatives
from .hilbert_shards import op1_hilbert_shards
from .html_text import op8_main_text
from .license_scan import op10_license_scan
from .line_dedup import SQL as LINE_DEDUP_SQL
from .line_dedup import op7_line_dedup
from .nbsvm import op9_quality_nbsvm
from .simhash import op5_simhash_dedup
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op13_toxicity


def queries() -> dict:
    own = (op1_hilbert_shards, op2_decontamination, op3_byte_bpe, op4_suffix_dedup, op5_simhash_dedup, op6_winnow_fingerprints, op7_line_dedup, op8_main_text, op9_quality_nbsvm, op10_license_scan, op11_fill_middle, op12_hard_negatives, op13_toxicity)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": LINE_DEDUP_SQL, "op11_fill_middle": FILL_MIDDLE_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
