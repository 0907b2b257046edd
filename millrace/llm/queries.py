"""The registered queries of the training-data operators, and their SQL where SQL can express them.

None of the ten has an oracle: each needs hashing, tokenizing, parsing or training that
SQL has no words for.  Each is tested against a brute-force version in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op1_nearest_neighbours
from .decontaminate import op3_decontaminate
from .html_text import op9_html_text
from .langid import langid_pages, op2_language_id
from .licenses import op8_license_scan
from .near_dup import op10_near_duplicates
from .packing import op7_pack_sequences
from .secrets import op5_secret_scan
from .substring_dedup import op4_substring_dedup
from .url_filter import op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_license_scan": op8_license_scan,
    "op9_html_text": op9_html_text,
    "op10_near_duplicates": op10_near_duplicates,
    "langid_pages": langid_pages,
}
ORACLES: dict[str, str] = {}
