"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat_prefix
from .decontaminate import op2_decontaminate
from .jaccard import op9_group_jaccard
from .merkle import OP11_SQL, op11_merkle_exchange
from .neighbors import op5_srs_neighbors
from .packing import op10_tier_packing
from .periodic import OP12_SQL, op12_scale_tiles
from .ppm import op3_ppm_score
from .quality import op6_site_quality
from .repeats import OP13_SQL, op13_recompression
from .secrets import op1_secret_scan
from .urls import OP8_SQL, op8_url_rules
from .warc import op4_warc_chunks


def queries():
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_decontaminate": op2_decontaminate,
        "op3_ppm_score": op3_ppm_score,
        "op4_warc_chunks": op4_warc_chunks,
        "op5_srs_neighbors": op5_srs_neighbors,
        "op6_site_quality": op6_site_quality,
        "op7_chat_prefix": op7_chat_prefix,
        "op8_url_rules": op8_url_rules,
        "op9_group_jaccard": op9_group_jaccard,
        "op10_tier_packing": op10_tier_packing,
        "op11_merkle_exchange": op11_merkle_exchange,
        "op12_scale_tiles": op12_scale_tiles,
        "op13_recompression": op13_recompression,
    }


def oracle_sql():
    return {"op7_chat_prefix": OP7_SQL, "op8_url_rules": OP8_SQL, "op11_merkle_exchange": OP11_SQL, "op12_scale_tiles": OP12_SQL, "op13_recompression": OP13_SQL}
