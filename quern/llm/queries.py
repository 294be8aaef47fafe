"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from .ann import op10_nearest_vectors
from .bpe import op9_byte_bpe
from .mixing import OP6_SQL, op6_mix_sources
from .quality import op5_quality_scores
from .sharding import op3_feistel_shards
from .simhash import op4_simhash_classes
from .spotsigs import op1_spotsigs
from .suffix_dedup import op2_repeated_passages
from .token_counts import op8_token_counts
from .toxicity import op7_toxicity_scores

QUERIES = {f.__name__: f for f in (op1_spotsigs, op2_repeated_passages, op3_feistel_shards, op4_simhash_classes, op5_quality_scores, op6_mix_sources, op7_toxicity_scores, op8_token_counts, op9_byte_bpe, op10_nearest_vectors)}
ORACLE_SQL = {"op6_mix_sources": OP6_SQL}
