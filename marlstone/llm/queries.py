"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_scan, line_dedup
from .bpe import op9_byte_bpe
from .decontaminate import op6_decontamination
from .license_scan import op8_license_scan, op8_wrapped_notices
from .line_dedup import op7_line_dedup
from .minhash import op10_near_duplicates
from .pii import op2_personal_data
from .quality import op4_quality
from .repeats import op3_repeated_passages
from .syncmers import op5_fingerprints
from .token_counts import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_personal_data, op3_repeated_passages, op4_quality, op5_fingerprints, op6_decontamination, op7_line_dedup, op8_license_scan, op9_byte_bpe, op10_near_duplicates, op8_wrapped_notices)}
SQL: dict[str, str] = {"op7_line_dedup": line_dedup.SQL, "op8_license_scan": license_scan.SQL}
