"""Queries and oracle SQL of this package for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline

from . import line_dedup, url_filter
from .ann import op7_neighbours
from .bpe import op4_bpe
from .html_text import op1_main_text
from .language_id import op2_language_id
from .line_dedup import op10_line_dedup
from .mixing import op6_mixing
from .near_dedup import op3_near_dedup
from .tiff import op9_tiff
from .toxicity import op8_toxicity
from .url_filter import op5_url_filter

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_language_id": op2_language_id,
    "op3_near_dedup": op3_near_dedup,
    "op4_bpe": op4_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_neighbours": op7_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_tiff": op9_tiff,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {"op5_url_filter": url_filter.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
