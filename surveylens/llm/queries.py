"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surveylens.llm import lexical_search, licenses, spelling
from surveylens.llm.language_id import op11_language_id
from surveylens.llm.mixing import op3_source_mixing
from surveylens.llm.ngram_join import op7_ngram_join
from surveylens.llm.packing import op4_curve_packing
from surveylens.llm.page_text import op10_html_extraction
from surveylens.llm.quality import op1_quality_classifier
from surveylens.llm.secrets import op9_secret_scans
from surveylens.llm.spotsigs import op5_near_duplicates, op5_spot_signatures
from surveylens.llm.token_counts import op6_token_counts
from surveylens.llm.vector_search import op8_posting_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_source_mixing": op3_source_mixing,
    "op4_curve_packing": op4_curve_packing,
    "op5_spot_signatures": op5_spot_signatures,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_join": op7_ngram_join,
    "op8_posting_lists": op8_posting_lists,
    "op9_secret_scans": op9_secret_scans,
    "op10_html_extraction": op10_html_extraction,
    "op11_language_id": op11_language_id,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}


def oracle_queries() -> dict[str, str]:
    return {"op2_license_scans": licenses.oracle(), "op12_lexical_search": lexical_search.oracle(),
            "op13_spelling_variants": spelling.oracle()}
