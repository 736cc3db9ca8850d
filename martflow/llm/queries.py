"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from martflow.llm import oracles, quality_rules
from martflow.llm.bpe import op6_bpe
from martflow.llm.html_text import op2_html_text
from martflow.llm.jaccard_join import op4_jaccard_join
from martflow.llm.language_id import op1_language_id
from martflow.llm.license_scan import op5_license_scan, oracle as _licenses
from martflow.llm.mixing import op10_mixing
from martflow.llm.quality_model import op9_quality_model
from martflow.llm.quality_rules import op7_quality_rules
from martflow.llm.token_shards import op3_token_shards
from martflow.llm.vector_search import op8_vector_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_html_text,
        op3_token_shards,
        op4_jaccard_join,
        op5_license_scan,
        op6_bpe,
        op7_quality_rules,
        op8_vector_search,
        op9_quality_model,
        op10_mixing,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": oracles.jaccard_join(4, 85),
    "op5_license_scan": _licenses(),
    "op7_quality_rules": oracles.quality_rules(quality_rules.COVERAGE, quality_rules.LINE_COVERAGE),
}
