"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, warc
from .decontaminate import op3_decontaminate
from .media import op4_media
from .ngram_lm import op5_lm_scoring
from .quality import op10_quality
from .simhash_dedup import op1_simhash_dedup
from .secret_scan import op7_secret_scan
from .substring_dedup import op6_substring_dedup
from .token_counts import op2_token_counts
from .transducer import op8_sentencepiece
from .warc import op9_warc_revisit

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontaminate": op3_decontaminate,
    "op4_media": op4_media,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_warc_revisit": op9_warc_revisit,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": decontaminate.ORACLE, "op9_warc_revisit": warc.ORACLE}
