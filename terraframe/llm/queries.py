"""Queries and SQL of this subpackage."""

from __future__ import annotations

from .decontam import op8_decontamination
from .hard_negatives import op11_hard_negatives
from .hard_negatives import sql as op11_sql
from .html_extract import op3_html_extraction
from .language_id import language_id_pages, op6_language_id
from .minhash import op13_minhash
from .minhash import sql as op13_sql
from .packing import op2_packing
from .quality_rules import op10_quality_rules
from .sharding import op4_sharding
from .simhash import op1_simhash
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op5_token_counts
from .url_filter import op7_url_filters
from .url_filter import sql as op7_sql
from .whitening import op12_whitening

QUERIES = {"op1_simhash": op1_simhash, "op2_packing": op2_packing, "op3_html_extraction": op3_html_extraction, "op4_sharding": op4_sharding, "op5_token_counts": op5_token_counts, "op6_language_id": op6_language_id, "language_id_pages": language_id_pages, "op7_url_filters": op7_url_filters, "op8_decontamination": op8_decontamination, "op9_suffix_dedup": op9_suffix_dedup, "op10_quality_rules": op10_quality_rules, "op11_hard_negatives": op11_hard_negatives, "op12_whitening": op12_whitening, "op13_minhash": op13_minhash}
#: The others train, tokenize or hash in ways SQL has no words for; tests hold them against brute force.
SQL: dict[str, str] = {"op7_url_filters": op7_sql(), "op11_hard_negatives": op11_sql(), "op13_minhash": op13_sql()}
