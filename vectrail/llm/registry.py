"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from vectrail.llm import op1_anisotropic as op1
from vectrail.llm.op1_anisotropic import op1_anisotropic
from vectrail.llm.op10_decontaminate import op10_decontaminate
from vectrail.llm.op2_license_scan import op2_license_scan
from vectrail.llm.op3_quality import op3_quality
from vectrail.llm.op4_token_codes import op4_token_codes
from vectrail.llm.op5_ngram_join import op5_ngram_join
from vectrail.llm.op6_packing import op6_packing
from vectrail.llm.op7_pii import op7_pii
from vectrail.llm.op8_site_style import op8_site_style
from vectrail.llm.op9_suffix_dedup import op9_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_anisotropic, op2_license_scan, op3_quality, op4_token_codes, op5_ngram_join, op6_packing, op7_pii, op8_site_style, op9_suffix_dedup, op10_decontaminate)}
SQL: dict[str, str] = {"op1_anisotropic": op1.SQL}
