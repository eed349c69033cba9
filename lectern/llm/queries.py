"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .conversation_repair import OP12_SQL, op12_conversation_repair
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .hnsw import OP8_SQL, op8_embedding_dedup
from .html_extract import OP10_SQL, op10_html
from .mixing import op9_mixing
from .sharding import op5_sharding
from .simhash import op1_simhash
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op6_token_counts
from .token_files import op13_token_files
from .toxicity import op4_toxicity

OPERATORS = [
    op1_simhash, op2_suffix_dedup, op3_bpe, op4_toxicity, op5_sharding, op6_token_counts, op7_exact_dedup, op8_embedding_dedup, op9_mixing, op10_html, op11_hard_negatives,
    op12_conversation_repair, op13_token_files,
]
QUERIES = {f.__name__: f for f in OPERATORS}
SQL = {"op7_exact_dedup": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op10_html": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_conversation_repair": OP12_SQL}
