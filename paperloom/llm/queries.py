"""Queries and SQL of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pipeline
from .exact_dedup import op8_exact_dedup
from .html_extraction import op7_html_extraction
from .language_id import op12_language_id
from .mixing import ORACLE_SQL as MIXING_SQL
from .mixing import op6_source_mixing
from .packing import op5_best_fit_packing
from .secret_scan import op3_secret_scan
from .simhash import op10_simhash
from .token_output import op2_token_output
from .toxicity import op1_toxicity
from .transport_stream import op4_transport_stream
from .url_filter import op9_url_filter
from .vector_codes import ORACLE_SQL as CODES_SQL
from .vector_codes import op13_vector_codes
from .whitening import op11_whitening

OPERATORS = [
    op1_toxicity,
    op2_token_output,
    op3_secret_scan,
    op4_transport_stream,
    op5_best_fit_packing,
    op6_source_mixing,
    op7_html_extraction,
    op8_exact_dedup,
    op9_url_filter,
    op10_simhash,
    op11_whitening,
    op12_language_id,
    op13_vector_codes,
]

EXACT_DEDUP_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": MIXING_SQL, "op8_exact_dedup": EXACT_DEDUP_SQL, "op13_vector_codes": CODES_SQL}
