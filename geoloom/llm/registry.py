"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from geoloom.llm import oracle
from geoloom.llm.chat import op7_chat_formatting
from geoloom.llm.decontaminate import op6_benchmark_decontamination
from geoloom.llm.licenses import op5_license_scans
from geoloom.llm.lines import op1_line_dedup
from geoloom.llm.ngram_join import op3_ngram_jaccard_join
from geoloom.llm.pages import op8_html_extraction
from geoloom.llm.quality import op4_quality_rules
from geoloom.llm.sentencepiece import op10_sentencepiece
from geoloom.llm.substring import op9_substring_dedup
from geoloom.llm.urls import op2_url_filters

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filters, op3_ngram_jaccard_join, op4_quality_rules, op5_license_scans, op6_benchmark_decontamination, op7_chat_formatting, op8_html_extraction, op9_substring_dedup, op10_sentencepiece)}
ORACLE_SQL = dict(oracle.SQL)
