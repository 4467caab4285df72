"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_format import OP6_SQL, op6_chat_format
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontaminate import OP3_SQL, op3_decontaminate
from .embedding_dedup import op12_embedding_dedup
from .language_id import op7_language
from .line_dedup import OP10_SQL, op10_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .near_dedup import op8_near_dedup
from .neighbours import op1_neighbours
from .packing import op2_packing
from .secret_scan import op4_secret_scan
from .toxicity import op9_toxicity
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_chat_format": op6_chat_format,
    "op7_language": op7_language,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op3_decontaminate": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
