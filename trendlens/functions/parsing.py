"""Tolerant parsers for the raw text columns of a trending snapshot.

Every function maps a Column to a Column and stays inside Spark's JVM
expressions (codegen, no Python per row). Dirty input gives NULL, never an
error, so one bad cell cannot fail a whole table under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------
# numbers and booleans
# --------------------------------------------------------------------------

# Number texts with a base, and a separator that does not stand between digits.
_HEX = "^0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*$"
_BINARY = "^0[bB][01]+(?:_[01]+)*$"
_HEX_64, _BINARY_64 = "^0[xX]0*[0-9a-fA-F]{1,16}$", "^0[bB]0*[01]{1,64}$"
_LOOSE_SEPARATOR = "(?:^|[^0-9])_|_(?:[^0-9]|$)"
# Texts that a cast may take: a cast of any other text fails by an exception, which costs twenty times the cast.
_INTEGER = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*\z"
_DECIMAL = (r"^[\x00-\x20]*[+-]?(?:\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)(?:[eE][+-]?\p{Nd}+)?[\x00-\x20]*\z")


def to_bigint(x: ColumnOrName) -> Column:
    """Lenient text -> BIGINT, rounding like a SQL numeric cast.

    ``12.7`` -> 13, ``-0.5`` -> -1, ``1e3`` -> 1000, `` 42 `` -> 42, ``0x10`` -> 16,
    ``0b101`` -> 5, ``1_000`` -> 1000, ``1,234`` and blanks -> NULL. Plain integers
    take the short way. Others go through DECIMAL(38,10), which gives exact half-up
    rounding (a DOUBLE would misround ``2.5000000000000001``-like text); hex,
    binary and separated digits are looked for only in texts that hold their mark.
    """
    raw = _c(x).cast("string")
    text = F.trim(raw)

    def decimal(t: Column) -> Column:
        return F.when(t.rlike(_DECIMAL), F.round(t.try_cast(T.DecimalType(38, 10)), 0).try_cast(T.LongType()))

    digits = F.replace(raw, F.lit("_"), F.lit(""))
    # conv() fails beyond 64 bits, so what is longer never reaches it.
    based = (F.when(raw.rlike(_HEX) & digits.rlike(_HEX_64), F.conv(F.substring(digits, 3, 1 << 20), 16, 10).try_cast(T.LongType()))
             .when(raw.rlike(_BINARY) & digits.rlike(_BINARY_64),
                   F.conv(F.substring(digits, 3, 1 << 20), 2, 10).try_cast(T.LongType())))
    apart = F.when(~text.rlike(_LOOSE_SEPARATOR), decimal(F.replace(text, F.lit("_"), F.lit(""))))
    return F.coalesce(F.when(text.rlike(_INTEGER), text.try_cast(T.LongType())),
                      F.when(raw.startswith("0x") | raw.startswith("0X") | raw.startswith("0b") | raw.startswith("0B"), based)
                      .when(text.contains("_"), apart).otherwise(decimal(text)))


def to_boolean(x: ColumnOrName) -> Column:
    """Text -> BOOLEAN (true/false, t/f, yes/no, y/n, 1/0; else NULL, also for padded text)."""
    text = _c(x).cast("string")
    # Spark's cast ignores surrounding white space; the SQL cast meant here does not.
    return F.when(text.rlike("(?i)^(?:t|true|y|yes|1|f|false|n|no|0)$"), text.try_cast(T.BooleanType()))


def first_nondigit_removed(x: ColumnOrName) -> Column:
    """Remove the FIRST character that is not a digit (not all of them).

    ``1,234,567`` -> ``1234,567``; ``-5`` -> ``5``. This is the behaviour of a
    non-global ``regexp_replace(x, '[^0-9]', '')``, which the view counts of
    the original queries go through.
    """
    return F.regexp_replace(_c(x).cast("string"), r"^([0-9]*)[^0-9]", "$1")


def digits_bigint(x: ColumnOrName, data_type: T.DataType | None = None) -> Column:
    """``first_nondigit_removed`` then a try-cast to BIGINT.

    For an integral column the text round trip is the identity except that a
    minus sign vanishes, so the result is ``abs(x)`` (with the one value whose
    absolute value overflows, Long.MIN_VALUE, giving NULL as the text path
    does). Passing the column's type selects that arithmetic fast path, which
    skips formatting and a regex per row.
    """
    col = _c(x)
    if isinstance(data_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        wide = col.cast(T.LongType())
        return F.when(wide == F.lit(-(2 ** 63)), F.lit(None).cast(T.LongType())).otherwise(F.abs(wide))
    # What is left may still read as a number with a fraction or exponent
    # (``1,2.5`` -> ``12.5`` -> 13), so the lenient SQL-style cast applies.
    return to_bigint(first_nondigit_removed(col))


# --------------------------------------------------------------------------
# timestamps and dates
# --------------------------------------------------------------------------

# The three accepted timestamp layouts: day/month/year hour:minute, ISO
# date-time, ISO date; blanks between day and time may be any number.
_GAP = r"[\t\n\f\r\x0B ]+"
_DMY_TIME = rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{1,4}}){_GAP}([0-9]{{1,2}}):([0-9]{{1,2}})$"
_ISO_TIME = rf"^([0-9]{{1,4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:{_GAP}([0-9]{{1,2}}):([0-9]{{1,2}}):([0-9]{{1,2}}))?$"


def to_ts(x: ColumnOrName) -> Column:
    """Text -> TIMESTAMP (no zone): one of three layouts, else NULL.

    Surrounding blanks are ignored; a zone suffix or a ``T`` separator is not
    accepted. The fields are taken by a regex and made into a TIMESTAMP_NTZ
    directly, so the session zone (and its clock changes) plays no part. An
    impossible day or time gives NULL.
    """
    return ts_from(ts_fields(x))


def ts_fields(x: ColumnOrName) -> Column:
    """The one regex pass of ``to_ts``: a matching text as ``[year, month, day, hour, minute, second]``."""
    text = F.trim(_c(x).cast("string"))
    parts = F.when(text.contains("/"), F.regexp_replace(text, _DMY_TIME, "$3/$2/$1/$4/$5/0")).otherwise(
        F.regexp_replace(text, _ISO_TIME, "$1/$2/$3/$4/$5/$6"))
    return F.split(parts, "/")


def ts_from(fields: ColumnOrName) -> Column:
    """``to_ts`` given ``ts_fields`` of the same text (so a caller can compute
    them once, in an earlier projection)."""
    fields = _c(fields)
    number = [F.get(fields, F.lit(i)).try_cast(T.IntegerType()) for i in range(6)]
    time = [F.when(F.get(fields, F.lit(i)) == "", 0).otherwise(number[i]) for i in range(3, 6)]
    valid = (F.size(fields) == 6) & (time[2] <= 59)  # a 60th second would roll over
    return F.when(valid, F.try_make_timestamp_ntz(*number[:3], time[0], time[1], time[2].cast("decimal(16,6)")))


# French month names (with the unaccented spellings accepted
# for février, août and décembre) and their month numbers.
FRENCH_MONTHS = {
    "janvier": 1,
    "février": 2,
    "fevrier": 2,
    "mars": 3,
    "avril": 4,
    "mai": 5,
    "juin": 6,
    "juillet": 7,
    "août": 8,
    "aout": 8,
    "septembre": 9,
    "octobre": 10,
    "novembre": 11,
    "décembre": 12,
    "decembre": 12,
}

# The French long-date shape "<weekday> <day> <month> <year>",
# words of letters A-Z, a-z and U+00C0..U+00FF. Blank is spelled out as
# [\t\n\f\r ] so Java matches what RE2's \s matches.
_WS = r"[\t\n\f\r ]"
_WORD = "[A-Za-zÀ-ÿ]+"
FRENCH_DATE_PATTERN = rf"^{_WORD}{_WS}+([0-9]{{1,2}}){_WS}+({_WORD}){_WS}+([0-9]{{4}}){_WS}*$"


# Leads a text that a regex has rewritten; texts that start with it themselves count as not matching.
_MARK = "\x01"


def _marked(text: Column, parts: Column) -> Column:
    return (F.get(parts, F.lit(0)) == _MARK) & ~text.startswith(_MARK)


def french_parts(x: ColumnOrName) -> Column:
    """The one regex pass of ``french_date``: a matching text rewritten to
    ``[mark, year, month word, day]`` (the month word cannot contain '/')."""
    return F.split(F.regexp_replace(_c(x).cast("string"), FRENCH_DATE_PATTERN, f"{_MARK}/$3/$2/$1"), "/", 4)


def french_date_from(x: ColumnOrName, parts: ColumnOrName) -> Column:
    """``french_date`` given ``french_parts`` of the same text (so a caller
    can compute the parts once, in an earlier projection)."""
    text, parts = _c(x).cast("string"), _c(parts)
    months = F.create_map(*[v for k, n in FRENCH_MONTHS.items() for v in (F.lit(k), F.lit(n))])
    year, word, day = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    month = F.try_element_at(months, F.lower(word))
    # NULL when the month is unknown and for impossible calendar days.
    zero = F.lit(0)
    moment = F.try_make_timestamp_ntz(year.try_cast(T.IntegerType()), month, day.try_cast(T.IntegerType()), zero, zero,
                                      zero.cast("decimal(16,6)"))
    return F.when(_marked(text, parts), moment.cast(T.DateType()))


def french_date(x: ColumnOrName) -> Column:
    """French long date text (``Mardi 5 août 2024``) -> DATE, else NULL.

    The weekday word is required but not checked against the day. Month names
    are matched case-blind. An impossible day (31 février) gives NULL.
    """
    return french_date_from(x, french_parts(x))


def iso_text(x: ColumnOrName) -> Column:
    """DATE -> ``yyyy-MM-dd`` text."""
    return _c(x).cast("string")


def french_display(x: ColumnOrName) -> Column:
    """DATE -> ``dd/MM/yyyy`` text, as shown beside the map."""
    return F.date_format(_c(x), "dd/MM/yyyy")


# --------------------------------------------------------------------------
# durations
# --------------------------------------------------------------------------

# The ISO-8601 duration part patterns. The seconds pattern is
# kept as the original cleaning step has it: it wants a digit run before the
# seconds, so ``PT45S`` gives 5 and ``PT5S`` gives 0. ``exact=True`` swaps in
# the correct pattern.
_ISO_HOURS = r"PT([0-9]+)H"
_ISO_MINUTES = r"PT(?:[0-9]+H)?([0-9]+)M"
_ISO_SECONDS_QUIRK = r"PT(?:[0-9]+H)?(?:[0-9]+)M?([0-9]+)S"
_ISO_SECONDS_EXACT = r"PT(?:[0-9]+H)?(?:[0-9]+M)?([0-9]+)S"
# Clock text h:m[:s[.fraction][zone]], hour 0-24 (24 only as 24:00:00); a
# zone suffix and trailing blanks are accepted only after seconds (as the SQL
# TIME cast does), other trailing text is refused.
_CLOCK = (rf"^{_WS}*([0-9]{{1,2}}):([0-9]{{1,2}})"
          rf"(?::([0-9]{{1,2}})(?:\.([0-9]+))?(?:{_WS}*(?:Z|[+-][0-9]{{1,2}}(?::?[0-9]{{2}})?))?{_WS}*)?$")


# A day before the clock.
_DAY_BEFORE = rf"^{_WS}*([0-9]{{1,4}}-[0-9]{{1,2}}-[0-9]{{1,2}})(?:[\x20T]+(?=[0-9])|{_WS}*$)"


def _number(digits: Column) -> Column:
    """Digits, or none, as BIGINT; 0 for none and beyond BIGINT. The leading zero spares a failing cast of the empty text."""
    return F.coalesce(F.concat(F.lit("0"), digits).try_cast(T.LongType()), F.lit(0).cast(T.LongType()))


def _part(text: Column, pattern: str) -> Column:
    return _number(F.regexp_extract(text, pattern, 1))


def _clock_of_moment(text: Column) -> Column:
    """The clock of a text that begins with a day (midnight if nothing follows); other texts as they are."""
    day = F.regexp_extract(text, _DAY_BEFORE, 1)
    rest = F.regexp_replace(text, _DAY_BEFORE, "")
    clock = F.when(rest == "", "0:00:00").otherwise(F.regexp_replace(rest, r"^24:00(?::00(?:\.0+)?)?$", "0:00:00"))
    return F.when(text.contains("-") & text.rlike(_DAY_BEFORE), F.when(day.try_cast("date").isNotNull(), clock)).otherwise(text)


def clock_parts(x: ColumnOrName) -> Column:
    """The one regex pass of the clock branch: a clock text rewritten to
    ``[mark, h, m, s, fraction]`` (missing parts empty)."""
    text = _clock_of_moment(_c(x).cast("string"))
    return F.split(F.regexp_replace(text, _CLOCK, f"{_MARK}:$1:$2:$3:$4"), ":", 5)


def duration_seconds_from(x: ColumnOrName, hms: ColumnOrName, exact: bool = False) -> Column:
    """``duration_seconds`` given ``clock_parts`` of the same text (so a
    caller can compute the parts once, in an earlier projection: they are
    read nine times below)."""
    text, hms = _c(x).cast("string"), _c(hms)
    # try_ arithmetic: a count of hours beyond BIGINT gives NULL.
    iso = F.try_add(F.try_add(F.try_multiply(_part(text, _ISO_HOURS), F.lit(3600)),
                              F.try_multiply(_part(text, _ISO_MINUTES), F.lit(60))),
                    _part(text, _ISO_SECONDS_EXACT if exact else _ISO_SECONDS_QUIRK))
    h, m = (F.get(hms, F.lit(i)).try_cast(T.LongType()) for i in (1, 2))
    s = _number(F.get(hms, F.lit(3)))
    # the fraction only matters for 24:00:00 (nothing may follow)
    frac_zero = ~F.get(hms, F.lit(4)).rlike("[1-9]")
    in_range = (m <= 59) & (s <= 59) & ((h <= 23) | ((h == 24) & (m == 0) & (s == 0) & frac_zero))
    clock = F.when(in_range, h * 3600 + m * 60 + s)
    return (F.when(text.startswith("PT"), iso)
            .when(_marked(text, hms), clock)
            .otherwise(F.lit(None).cast(T.LongType())))


def duration_seconds(x: ColumnOrName, exact: bool = False) -> Column:
    """``PT1H2M3S``, ``01:02:03`` or the clock of ``2024-05-01 01:02:03`` -> seconds (BIGINT); anything else NULL."""
    return duration_seconds_from(x, clock_parts(x), exact)
