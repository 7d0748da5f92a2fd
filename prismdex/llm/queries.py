"""The operators as queries over the given tables."""

from __future__ import annotations

from prismdex.llm import (
    ann, attention_lm, filter_audit, license_scan, ns_bounds, packing, quality, revisit, simhash, site_style, token_counts, toxicity, winnow,
)
from prismdex.llm.common import table

QUERIES = {
    "op1_quality": lambda s, d: quality.op1_quality(table(s, d, "documents"), table(s, d, "labels")),
    "op2_site_style": lambda s, d: site_style.op2_site_style(table(s, d, "pages")),
    "op3_simhash": lambda s, d: simhash.op3_simhash(table(s, d, "documents")),
    "op4_attention_lm": lambda s, d: attention_lm.op4_attention_lm(table(s, d, "documents")),
    "op5_packing": lambda s, d: packing.op5_packing(table(s, d, "documents")),
    "op6_license_scan": lambda s, d: license_scan.op6_license_scan(table(s, d, "documents")),
    "op7_toxicity": lambda s, d: toxicity.op7_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op8_revisit": lambda s, d: revisit.op8_revisit(table(s, d, "pages")),
    "op9_nearest": lambda s, d: ann.op9_nearest(table(s, d, "embeddings")),
    "op10_decontaminate": lambda s, d: winnow.op10_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
    "op11_filter_audit": lambda s, d: filter_audit.op11_filter_audit(table(s, d, "documents"), table(s, d, "labels")),
    "op12_token_counts": lambda s, d: token_counts.op12_token_counts(table(s, d, "documents")),
    "op13_ns_bounds": lambda s, d: ns_bounds.op13_ns_bounds(table(s, d, "embeddings")),
}

#: The other operators have no SQL form; tests hold them against brute force or held-out labels.
ORACLE = {"op8_revisit": revisit.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op13_ns_bounds": ns_bounds.ORACLE_SQL}
