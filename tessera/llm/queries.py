"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm.chat import OP1_SQL, op1_chat_formatting
from tessera.llm.language import op4_language_id
from tessera.llm.mixing import op7_mixing
from tessera.llm.neardup import OP6_SQL, op6_near_duplicates
from tessera.llm.packing import op9_packing
from tessera.llm.personal import op8_personal_data
from tessera.llm.sharding import op2_sharding
from tessera.llm.substrings import OP10_SQL, op10_substring_dedup
from tessera.llm.vectors import OP3_SQL, op3_exact_top_k, op5_nearest_neighbours

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_sharding, op3_exact_top_k, op4_language_id, op5_nearest_neighbours,
        op6_near_duplicates, op7_mixing, op8_personal_data, op9_packing, op10_substring_dedup,
    )
}

ORACLE_SQL = {
    "op1_chat_formatting": OP1_SQL, "op3_exact_top_k": OP3_SQL, "op6_near_duplicates": OP6_SQL, "op10_substring_dedup": OP10_SQL,
}
