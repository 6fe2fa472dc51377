"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import op8_chat_formatting, op8_sql
from .codes import op11_sql, op11_vector_codes
from .decontaminate import op3_decontamination
from .divergence import op13_divergence, op13_sql
from .fingerprints import op12_fingerprints
from .jaccard import op5_jaccard_join
from .lines import op7_line_dedup
from .mixing import op1_mixing
from .neighbours import op10_neighbours
from .quality import op6_quality_classifier
from .sharding import op2_sharding
from .tokens import op4_token_counts
from .warc import op9_sql, op9_warc


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_token_counts": op4_token_counts,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_line_dedup": op7_line_dedup,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_warc": op9_warc,
        "op10_neighbours": op10_neighbours,
        "op11_vector_codes": op11_vector_codes,
        "op12_fingerprints": op12_fingerprints,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_formatting": op8_sql(), "op9_warc": op9_sql(), "op11_vector_codes": op11_sql(), "op13_divergence": op13_sql()}
