"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .bpe import op5_bpe
from .context_tree import op4_context_tree
from .embedding_links import ORACLE_OP13, op13_embedding_links
from .fill_in_middle import ORACLE_OP12, op12_fill_in_middle
from .language_id import op9_language_id
from .near_join import ORACLE_OP3, op3_near_join
from .packing import op6_packing
from .quality_model import op2_quality_model
from .quality_rules import ORACLE_OP10, op10_quality_rules
from .sharding import op8_sharding
from .url_rules import op7_url_rules
from .vector_codes import ORACLE_OP11, op11_vector_codes
from .winnowing import op1_winnowing

QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_quality_model": op2_quality_model,
    "op3_near_join": op3_near_join,
    "op4_context_tree": op4_context_tree,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_url_rules": op7_url_rules,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_embedding_links": op13_embedding_links,
}

ORACLES = {
    "op3_near_join": ORACLE_OP3,
    "op10_quality_rules": ORACLE_OP10,
    "op11_vector_codes": ORACLE_OP11,
    "op12_fill_in_middle": ORACLE_OP12,
    "op13_embedding_links": ORACLE_OP13,
}
