"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from dendrium.llm.filter_audit import OP13_SQL, op13_filter_shapley
from dendrium.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from dendrium.llm.language import op3_language_id
from dendrium.llm.licenses import op4_license_scan
from dendrium.llm.mixing import OP10_SQL, op10_mix_sources
from dendrium.llm.neighbours import op8_nn_descent
from dendrium.llm.packing import op2_pack_binary
from dendrium.llm.quality_classifier import op9_quality_trees
from dendrium.llm.quality_rules import op5_mcd_outliers
from dendrium.llm.sessions import OP12_SQL, op12_session_versions
from dendrium.llm.sharding import op6_hash_tree_shards
from dendrium.llm.token_files import op11_token_files
from dendrium.llm.url_filter import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_pack_binary": op2_pack_binary,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_mcd_outliers": op5_mcd_outliers,
    "op6_hash_tree_shards": op6_hash_tree_shards,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_nn_descent": op8_nn_descent,
    "op9_quality_trees": op9_quality_trees,
    "op10_mix_sources": op10_mix_sources,
    "op11_token_files": op11_token_files,
    "op12_session_versions": op12_session_versions,
    "op13_filter_shapley": op13_filter_shapley,
}
ORACLES = {"op1_url_filters": OP1_SQL, "op7_jaccard_join": OP7_SQL, "op10_mix_sources": OP10_SQL, "op12_session_versions": OP12_SQL, "op13_filter_shapley": OP13_SQL}
