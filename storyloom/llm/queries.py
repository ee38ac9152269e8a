"""The opN_ queries and the pipeline, with their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline

from .byte_cnn import op4_quality_classifier
from .decontamination import op1_decontamination
from .delta_lloyd import OP12_SQL, op12_centroid_clustering
from .impact_search import OP13_SQL, op13_ranked_search
from .licenses import op10_license_scans
from .line_runs import OP11_SQL, op11_line_dedup
from .packing import op9_best_fit_packing
from .pitman_yor import op6_language_model
from .quality_rules import OP2_SQL, op2_quality_rules
from .simhash import op3_simhash_groups
from .toxicity import op8_toxicity
from .urls import OP5_SQL, op5_url_filters
from .warc import OP7_SQL, op7_warc_revisits

LLM_QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filters": op5_url_filters,
    "op6_language_model": op6_language_model,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_license_scans": op10_license_scans,
    "op11_line_dedup": op11_line_dedup,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}
LLM_SQL = {
    "op2_quality_rules": OP2_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_warc_revisits": OP7_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
