"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from docloom.llm import clustering, decontamination, line_dedup, url_filter
from docloom.llm.bpe import op7_bpe
from docloom.llm.clustering import op12_clusters
from docloom.llm.decontamination import op9_decontamination
from docloom.llm.fingerprints import op1_fingerprints
from docloom.llm.html_extraction import op8_main_text
from docloom.llm.language_id import op6_language
from docloom.llm.line_dedup import op10_line_dedup
from docloom.llm.simhash import op2_simhash
from docloom.llm.token_counts import op4_token_counts
from docloom.llm.toxicity import op5_toxicity
from docloom.llm.url_filter import op11_url_filter
from docloom.llm.warc import op3_warc_derivatives
from docloom.llm.whitening import op13_whitening

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_main_text": op8_main_text,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_clusters": op12_clusters,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op9_decontamination": decontamination.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_url_filter": url_filter.SQL,
    "op12_clusters": clustering.SQL,
}
