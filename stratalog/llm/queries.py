"""The subpackage's queries, as the driver runs them, and the SQL of those that SQL can express."""

from __future__ import annotations

from stratalog.llm.decontaminate import OP6_SQL, decontamination_stage, op6_decontamination
from stratalog.llm.hnsw import op9_nearest
from stratalog.llm.html_text import op2_html_text
from stratalog.llm.language import language_stage, op5_language
from stratalog.llm.neardup import neardup_stage, op10_near_duplicates
from stratalog.llm.packing import op1_packing, packing_stage
from stratalog.llm.quality import op8_quality, quality_stage
from stratalog.llm.sstable import op7_sstable
from stratalog.llm.tokens import op4_token_counts
from stratalog.llm.url_rules import OP3_SQL, op3_url_rules

QUERIES = {
    "op1_packing": op1_packing,
    "op2_html_text": op2_html_text,
    "op3_url_rules": op3_url_rules,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_decontamination": op6_decontamination,
    "op7_sstable": op7_sstable,
    "op8_quality": op8_quality,
    "op9_nearest": op9_nearest,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLES = {"op3_url_rules": OP3_SQL, "op6_decontamination": OP6_SQL}

STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
