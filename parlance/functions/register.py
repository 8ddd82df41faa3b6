"""SQL functions for users of ``spark.sql``.

They are SQL-bodied temporary functions, so the optimizer inlines them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from parlance.functions import language as LG
from parlance.functions import safety as S
from parlance.functions import tags as TG

BODIES = {
    "mask_pii": ("string", S.mask_pii_sql),
    "pii_items": (S.PII_TYPE, lambda t: f"({S.pii_scan_sql(t)}).items"),
    "injection_labels": ("array<string>", lambda t: f"transform({S.injection_hits_sql(t)}, _h -> _h.label)"),
    "nsfw_categories": ("array<string>", S.nsfw_categories_sql),
    "detect_language": ("string", LG.detect_language_sql),
    "rule_tags": ("array<string>", TG.rule_tags_sql),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create ``name(text STRING)`` for every screening and tagging function."""
    for name, (returns, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(txt STRING) RETURNS {returns} RETURN {body('txt')}")
    return sorted(BODIES)
