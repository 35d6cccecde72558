"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidegrid.llm.byte_bpe import op9_byte_bpe
from tidegrid.llm.classifier import op7_quality_classifier
from tidegrid.llm.decontamination import op3_decontamination
from tidegrid.llm.divergence import SQL as DIVERGENCE_SQL
from tidegrid.llm.divergence import op12_source_divergence
from tidegrid.llm.jaccard_join import op10_jaccard_join
from tidegrid.llm.pii import op4_pii
from tidegrid.llm.quality_rules import op8_quality_rules
from tidegrid.llm.resampling import SQL as RESAMPLING_SQL
from tidegrid.llm.resampling import op11_importance_resampling
from tidegrid.llm.sharding import op2_sharding
from tidegrid.llm.suffix_dedup import op1_suffix_dedup
from tidegrid.llm.token_count import op6_token_count
from tidegrid.llm.vantage import op13_nearest_vectors
from tidegrid.llm.window_dedup import op5_window_dedup

QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_sharding, op3_decontamination, op4_pii, op5_window_dedup, op6_token_count,
    op7_quality_classifier, op8_quality_rules, op9_byte_bpe, op10_jaccard_join,
    op11_importance_resampling, op12_source_divergence, op13_nearest_vectors)}
ORACLES: dict[str, str] = {"op11_importance_resampling": RESAMPLING_SQL,
                           "op12_source_divergence": DIVERGENCE_SQL}
