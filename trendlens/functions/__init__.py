"""Column functions (all JVM-side built-ins; no Python per row)."""

from trendlens.functions.output import json_safe
from trendlens.functions.parsing import (
    FRENCH_MONTHS,
    clock_parts,
    digits_bigint,
    duration_seconds,
    duration_seconds_from,
    first_nondigit_removed,
    french_date,
    french_date_from,
    french_display,
    french_parts,
    iso_text,
    to_bigint,
    to_boolean,
    to_ts,
)
from trendlens.functions.text import COUNTRY_SYNONYMS, country_key, split_tags, strip_accents

__all__ = [
    "COUNTRY_SYNONYMS", "FRENCH_MONTHS", "clock_parts", "country_key", "digits_bigint",
    "duration_seconds", "duration_seconds_from", "first_nondigit_removed", "french_date", "french_date_from",
    "french_display", "french_parts", "iso_text",
    "json_safe", "split_tags", "strip_accents", "to_bigint", "to_boolean", "to_ts",
]
