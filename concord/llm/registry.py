"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from .decontaminate import op1_decontamination
from .html_text import op10_html_text
from .jaccard import op8_jaccard_join
from .language_model import op3_language_model
from .media import op9_media
from .packing import op5_packing
from .pii import op2_pii
from .secrets import op7_secrets
from .sql import ORACLES
from .token_files import op4_token_files
from .toxicity import op6_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_language_model": op3_language_model,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_media": op9_media,
    "op10_html_text": op10_html_text,
}

__all__ = ["ORACLES", "QUERIES"]
