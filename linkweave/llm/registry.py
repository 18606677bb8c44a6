"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from linkweave.llm.decontaminate import op9_decontaminate
from linkweave.llm.license_scan import op5_license_scan
from linkweave.llm.packing import op1_best_fit_packing
from linkweave.llm.pii import op10_pii
from linkweave.llm.quality_classifier import op2_quality_classifier
from linkweave.llm.quality_rules import op7_quality_rules
from linkweave.llm.simhash import op8_simhash
from linkweave.llm.token_store import op3_token_store
from linkweave.llm.toxicity import op4_toxicity
from linkweave.llm.url_filter import op6_url_filter

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_store": op3_token_store,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
}
ORACLE_SQL: dict[str, str] = {}
