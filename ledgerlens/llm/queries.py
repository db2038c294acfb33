"""The queries of this folder, by name."""

from __future__ import annotations

from . import oracles
from .bpe_codec import op10_bpe
from .curve_neighbours import op6_curve_neighbours
from .jaccard_join import op9_jaccard_join
from .language_id import op7_language_id
from .mixing import op4_mixing
from .quality_rules import op3_quality_rules
from .secret_scans import op1_secret_scans
from .sharding import op2_sharding
from .token_store import op8_token_store
from .toxicity import op5_toxicity

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_curve_neighbours": op6_curve_neighbours,
    "op7_language_id": op7_language_id,
    "op8_token_store": op8_token_store,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scans": oracles.SECRET_SCANS,
    "op9_jaccard_join": oracles.JACCARD_JOIN,
}
