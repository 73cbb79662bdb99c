"""All queries of this folder, registered by importing their modules."""

from routeyard.llm import (  # noqa: F401
    byte_bpe,
    hard_negatives,
    license_scan,
    near_dedup,
    packing,
    periodic_runs,
    pitman_yor,
    quality,
    token_counts,
    token_files,
    topk,
    toxicity,
    warc,
)
from routeyard.llm.common import ORACLES, QUERIES  # noqa: F401
