"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_snapshots
from .huffman import op10_token_files
from .langid import op7_language_id
from .mixing import OP9_SQL, op9_mix_sources
from .neardup import op6_near_duplicates
from .packing import op1_pack_documents
from .quality import OP4_SQL, op4_quality_rules
from .substring import op3_substring_dedup
from .vptree import OP2_SQL, op2_nearest_vectors
from .warc import OP8_SQL, op8_warc_index


def queries() -> dict:
    return {
        "op1_pack_documents": op1_pack_documents,
        "op2_nearest_vectors": op2_nearest_vectors,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_chat_snapshots": op5_chat_snapshots,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_language_id": op7_language_id,
        "op8_warc_index": op8_warc_index,
        "op9_mix_sources": op9_mix_sources,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest_vectors": OP2_SQL, "op4_quality_rules": OP4_SQL, "op5_chat_snapshots": OP5_SQL, "op8_warc_index": OP8_SQL, "op9_mix_sources": OP9_SQL}
