"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .embedding_dedup import op6_embedding_dedup
from .fingerprint import op4_fingerprint
from .jaccard_join import op10_jaccard_join
from .language_id import op1_language_id
from .mixing import OP9_SQL, op9_mixing
from .packing import op7_packing
from .pii import op8_pii
from .token_attribution import op5_token_attribution
from .toxicity import op2_toxicity
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_fingerprint": op4_fingerprint,
    "op5_token_attribution": op5_token_attribution,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
}
SQL = {"op3_url_filter": OP3_SQL, "op9_mixing": OP9_SQL}
