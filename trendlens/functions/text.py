"""Text helpers: tag splitting and country-name keys."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendlens.functions.parsing import ColumnOrName, _c


def split_tags(x: ColumnOrName) -> Column:
    """Tag text -> array of raw parts: lower-cased, outer blanks trimmed, split
    at every comma. Empty parts are kept (filtering is the caller's job)."""
    return F.split(F.lower(F.trim(_c(x))), ",", -1)


def _accent_table() -> tuple[str, str]:
    """Characters of the Basic Multilingual Plane whose canonical
    decomposition is one base character plus combining marks
    (U+0300..U+036F), paired with that base character.

    Built from the Unicode database rather than typed in, so it equals "NFD,
    then drop combining marks" for every such precomposed letter (Latin,
    Greek, Cyrillic, Vietnamese ...); letters without a decomposition
    (ø, æ, ß, đ) stay as they are, as they do under that rule.
    """
    src, dst = [], []
    for cp in range(0x00C0, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        base = "".join(c for c in nfd if not 0x0300 <= ord(c) <= 0x036F)
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()

# Country-name synonyms applied after trimming, lower-casing
# and accent stripping, so that data names and map names meet on one key.
COUNTRY_SYNONYMS = {
    "united states": "united states of america",
    "usa": "united states of america",
    "uk": "united kingdom",
    "great britain": "united kingdom",
    "russia": "russian federation",
    "south korea": "korea, republic of",
    "north korea": "korea, democratic people's republic of",
    "czech republic": "czechia",
    "ivory coast": "cote d'ivoire",
    "congo-kinshasa": "democratic republic of the congo",
    "congo-brazzaville": "republic of the congo",
    "swaziland": "eswatini",
    "cape verde": "cabo verde",
    "laos": "lao pdr",
    "myanmar": "myanmar",
    "burma": "myanmar",
}


def strip_accents(x: ColumnOrName) -> Column:
    """Replace precomposed letters with combining marks by their base letter."""
    return F.translate(_c(x), _ACCENTED, _PLAIN)


def strip_blanks(x: ColumnOrName) -> Column:
    """Remove leading and trailing Unicode whitespace (tabs, no-break spaces
    ... not only the ASCII space that ``trim`` removes)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def country_key(x: ColumnOrName) -> Column:
    """Matching key of a country name: strip whitespace, lower, strip
    accents, synonyms -- the normalisation the map page applies to both the
    data names and the shape names.

    NULL stays NULL; a blank name gives ``''`` (callers drop it: an empty key
    matches nothing).
    """
    base = strip_accents(F.lower(strip_blanks(x)))
    synonyms = F.create_map(*[v for k, s in COUNTRY_SYNONYMS.items() for v in (F.lit(k), F.lit(s))])
    return F.coalesce(F.try_element_at(synonyms, base), base)
