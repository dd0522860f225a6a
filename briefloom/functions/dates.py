"""Date columns. Every parse is the `try_` form: one bad value never stops a job. Zone-less values are UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from briefloom.functions.core import let, let_sql
from briefloom.functions.text import normalize_text, strip_text

# Month names, and the zone names mail dates may carry with their fixed offsets.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|"
    "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_ZONES = {
    "ast": "-04:00", "adt": "-03:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00",
    "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00",
}

_FULL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
_ISO = (
    r"^(?:\d{4}-\d{2}-\d{2}|\d{8})"
    r"(?:.(?:\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
_MAIL_HEAD = r"(?i)^(?:[a-z]+,? )?(\d{1,2})[ -](" + _MONTH_NAME + r")[ -](\d{4}|\d{2}) "
_MAIL = _MAIL_HEAD + r"\d{1,2}:\d{2}(?::\d{2})?(?: |$)"
_NAMED = r"(?i)^(" + _MONTH_NAME + r") (\d{1,2}), (\d{4})$"
_PLAIN = r"^\d{4}(?:-\d{1,2}-|/\d{1,2}/)\d{1,2}$"

_DATE_IN_TEXT = (
    r"(?U)\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"(?iU)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+20\d{2}\b",
)


_REWRITES = (
    # ISO forms beyond the common ones, brought to `date T time zone` by one replacement after the other
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),  # compact date
    (r"^(.{10}).", "$1T"),  # any separator
    (r"T(\d{2})(\d{2})(\d{2})?", "T$1:$2:$3"),  # compact time
    (r":(?=$|[^\d])", ""),
    (r",", "."),
    (r"(\.\d{6})\d+", "$1"),
    (r"T(\d{2})(?=$|[Z+-])", "T$1:00"),
    (r"T(\d{2}:\d{2})(?=$|[Z+-])", "T$1:00"),
    (r"(T.*[+-]\d{2})$", "$1:00"),
    (r"(T.*[+-]\d{2})(\d{2})$", "$1:$2"),
    (r"(T[\d:.]+)$", "$1Z"),
    (r"^(.{10})$", "$1T00:00:00Z"),
)


def _stamp(text: str) -> str:
    return f"try_cast({text} AS TIMESTAMP)"


def _month(name: str) -> str:
    return f"cast(cast((instr('{_MONTHS}', lower(substr({name}, 1, 3))) + 2) / 3 AS INT) AS STRING)"


def _rewritten(c: str) -> str:
    for pattern, put in _REWRITES:
        c = f"regexp_replace({c}, r'{pattern}', r'{put}')"
    return c


# day, month, year, time, zone of a mail date
_YEAR = "if(length(t[2]) = 2, concat(if(t[2] > '68', '19', '20'), t[2]), t[2])"
_CLOCK = "if(length(t[3]) < 6, concat(t[3], ':00'), t[3])"
_ZONE = (
    r"CASE WHEN get(t, 4) RLIKE r'^[+-]\d{4}$' THEN regexp_replace(get(t, 4), r'(\d{2})(\d{2})$', r'$1:$2') "
    + " ".join(f"WHEN lower(get(t, 4)) = '{name}' THEN '{offset}'" for name, offset in _ZONES.items())
    + " ELSE 'Z' END"
)
_MAIL_SQL = rf"""if(c RLIKE r'{_MAIL}', transform(array(split(regexp_replace(c, r'{_MAIL_HEAD}', r'$1 $2 $3 '), ' ')),
    t -> {_stamp(f"concat({_YEAR}, '-', {_month('t[1]')}, '-', t[0], 'T', {_CLOCK}, {_ZONE})")})[0], NULL)"""
_PART = [f"regexp_extract(c, r'{_NAMED}', {i})" for i in range(4)]
_NAMED_SQL = rf"""if(c RLIKE r'{_NAMED}', {_stamp(f"concat({_PART[3]}, '-', {_month(_PART[1])}, '-', {_PART[2]}, 'T00:00:00Z')")}, NULL)"""
# the common forms come first and need one pattern and one cast
_PARSE = rf"""c -> CASE WHEN c IS NULL OR c = '' THEN NULL
    WHEN c RLIKE r'{_FULL}' THEN {_stamp('c')}
    WHEN c RLIKE r'{_PLAIN}' THEN {_stamp("concat(replace(c, '/', '-'), 'T00:00:00Z')")}
    WHEN c RLIKE r'{_ISO}' THEN {_stamp(_rewritten('c'))}
    ELSE coalesce({_MAIL_SQL}, {_NAMED_SQL}) END"""


def parse_published_at(c: Column, *, normalized: bool = False) -> Column:
    """ISO 8601, mail dates, `2026-4-7`, `2026/4/7`, `Apr 7, 2026`, `April 7, 2026`; NULL for all else."""
    return let_sql(c if normalized else normalize_text(c), _PARSE)


def iso_text(ts: Column) -> Column:
    """ISO text in UTC, with a fraction only where there is one."""
    whole = "yyyy-MM-dd'T'HH:mm:ss"
    return let(
        F.to_utc_timestamp(ts, F.current_timezone()),
        lambda t: F.concat(
            F.when(F.pmod(F.unix_micros(t), F.lit(1_000_000)) == 0, F.date_format(t, whole)).otherwise(
                F.date_format(t, whole + ".SSSSSS")
            ),
            F.lit("+00:00"),
        ),
    )


def normalize_datetime(c: Column) -> Column:
    """Any accepted date as ISO text in UTC, else NULL."""
    return iso_text(parse_published_at(strip_text(c)))


def extract_date(text: Column) -> Column:
    """First date inside a text as it stands there, numeric form before named form, else NULL."""
    return let(text, lambda v: F.coalesce(*[F.nullif(F.regexp_extract(v, p, 0), F.lit("")) for p in _DATE_IN_TEXT]))


def feed_published_at(published: Column, updated: Column) -> Column:
    """Date text of a feed entry: `published`, else `updated`; mail dates become ISO, others stay as they are."""
    value = F.coalesce(F.nullif(published, F.lit("")), F.nullif(updated, F.lit("")))
    return let(value, lambda v: F.coalesce(iso_text(let_sql(normalize_text(v), f"c -> {_MAIL_SQL}")), v))


def report_title(prefix: Column | str, ts: Column) -> Column:
    """`prefix yyyy-MM-dd HH:mm`, in UTC+8."""
    prefix = prefix if isinstance(prefix, Column) else F.lit(prefix)
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat_ws(" ", prefix, F.date_format(F.from_utc_timestamp(utc, "+08:00"), "yyyy-MM-dd HH:mm"))
