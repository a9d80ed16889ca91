"""The queries of this subpackage and, where SQL can express one, the SQL for its rows."""

from __future__ import annotations

from .chat import OP8_SQL, op8_reply_trees
from .crosstok import op12_cross_tokenizer
from .decontam import op5_simhash_windows
from .langid import op13_byte_network
from .media import op6_avi_mjpeg
from .merkle import op11_merkle_manifest
from .pieces import op10_batched_viterbi
from .resampling import op2_importance_resampling
from .sharding import op1_kd_shards
from .simhash import op7_tiled_simhash
from .suffix_dedup import op3_suffix_spans
from .toxicity import op9_classifier_chain
from .warc import OP4_SQL, op4_boundary_chain

QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_suffix_spans": op3_suffix_spans,
    "op4_boundary_chain": op4_boundary_chain,
    "op5_simhash_windows": op5_simhash_windows,
    "op6_avi_mjpeg": op6_avi_mjpeg,
    "op7_tiled_simhash": op7_tiled_simhash,
    "op8_reply_trees": op8_reply_trees,
    "op9_classifier_chain": op9_classifier_chain,
    "op10_batched_viterbi": op10_batched_viterbi,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_byte_network": op13_byte_network,
}

ORACLE_SQL = {
    "op4_boundary_chain": OP4_SQL,
    "op8_reply_trees": OP8_SQL,
}
