"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from marlstone.llm.decontaminate import op4_decontamination
from marlstone.llm.licenses import op2_license_scan
from marlstone.llm.linededup import op10_line_dedup
from marlstone.llm.neardup import op7_near_duplicates
from marlstone.llm.pieces import op5_sentencepiece
from marlstone.llm.quality import op3_quality_classifier
from marlstone.llm.rules import op6_quality_rules
from marlstone.llm.tokencounts import op1_token_counts
from marlstone.llm.urltemplates import op9_url_filter
from marlstone.llm.wrappers import op8_html_extraction

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_html_extraction": op8_html_extraction,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {}
