"""Times in text columns, whatever their format: found by a vote over all values of a column.

A value is a date, then perhaps a time, AM or PM and a zone. The date may be written in several orders; each order that
a text fits is a candidate, and years, months and days are checked as numbers. Numeric dates with the
year last can be month-first or day-first; one reading is chosen per column, month-first if every value allows it. A
column is converted only if all its values parse.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month and weekday names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_NAME = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + "|sept)"
_WEEKDAY = "(?:(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in DAYS) + r"),? +)?"
_CLOCK = (r"(?:t| |, ?) *(?<hour>\d{1,2}):(?<minute>\d{2})(?::(?<second>\d{2}(?:[.,]\d{1,9})?))? *(?:(?<half>[ap])\.?m\.?)? *"
          r"(?:z|utc|gmt|(?<sign>[+-])(?<offhours>\d{2})(?::?(?<offminutes>\d{2}))?)?")
_TH = "(?:st|nd|rd|th)?"
# Orders of a date, with groups y year, m month, n month name, d day. A date fits one order at most; in the last one, with the
# year last, month and day may change places.
_ORDERS = (
    r"(?<y1>\d{4})(?<s1>[-/.])(?<m1>\d{1,2})\k<s1>(?<d1>\d{1,2})",
    r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})",
    rf"(?<d3>\d{{1,2}}){_TH}[ -](?<n3>{_NAME})\.?,?[ -](?<y3>\d{{4}})",
    rf"(?<n4>{_NAME})\.? +(?<d4>\d{{1,2}}){_TH},? +(?<y4>\d{{4}})",
    rf"(?<y5>\d{{4}})[ -](?<n5>{_NAME})\.?[ -](?<d5>\d{{1,2}})",
    r"(?<m6>\d{1,2})(?<last>[-/.])(?<d6>\d{1,2})\k<last>(?<y6>\d{4}|\d{2})",
)
# One search splits a text: of the orders one takes part, so the others' groups add nothing. Any other text has empty fields only.
_PATTERN = f"^(?:{_WEEKDAY}(?:{'|'.join(_ORDERS)}) *(?:{_CLOCK})?|[\\s\\S]*)$"
# Fields of a text, each from the groups that may hold it. Numbers come first and have a zero before them, so that a missing
# one is zero: a text that is no number makes even a forgiving cast slow.
_WHOLE = {
    "year": "y1 y2 y3 y4 y5 y6", "month": "m1 m2 m6", "day": "d1 d2 d3 d4 d5 d6",
    **{f: f for f in ("hour", "minute", "offhours", "offminutes")}}
_GROUPS = _WHOLE | {"name": "n3 n4 n5"} | {f: f for f in ("last", "second", "half", "sign")}
_NUMBERS = {name: i for i, name in enumerate(re.findall(r"\(\?<(\w+)>", _PATTERN), 1)}
_FIELDS = {f: ("0" if f in _WHOLE else "") + "".join(f"${_NUMBERS[g]}" for g in groups.split()) for f, groups in _GROUPS.items()}
READINGS = ("month first", "day first")
# Two-digit years from here on belong to the last century.
_OLD_YEARS = 69


def _braced(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")


def _number(field: str) -> str:
    return f"__n{{i}}[{list(_FIELDS).index(field)}]"


def _is(field: str, test: str) -> str:
    return f"__f{{i}}[{list(_FIELDS).index(field)}] {test}"


# 12 AM is midnight and 12 PM noon; there is no 13 PM. Without a clock all is zero.
_HOUR = (f"CASE WHEN {_is('half', '')} = '' THEN {_number('hour')} WHEN {_number('hour')} BETWEEN 1 AND 12 "
         f"THEN {_number('hour')} % 12 + IF({_is('half', '')} = 'p', 12, 0) ELSE 99 END")
# A year with its zero; none is missing.
_YEAR = (f"{_number('year')} + CASE length({_is('year', '')}) WHEN 1 THEN NULL WHEN 5 THEN 0 "
         f"ELSE IF({_number('year')} < {_OLD_YEARS}, 2000, 1900) END")
_MONTH = (f"IF({_is('name', '')} = '', {_number('month')}, find_in_set(left({_is('name', '')}, 3), '{','.join(n[:3] for n in MONTHS)}'))")
_SHIFT = f"({_number('offhours')} * 60 + {_number('offminutes')}) * IF({_is('sign', '')} = '-', -1, 1)"
# Steps from a text to its numbers. Every step is a projection of its own: its values are computed once however often
# they are used, and plain expressions become compiled code.
_STEPS = (
    # Lower case, single spaces; the pattern leaves out single spaces, which most texts have only.
    {"__f": r"lower(trim(regexp_replace({text}, r'\s{{2,}}|[^\S ]', ' ')))"},
    {"__f": f"IF(__f{{i}} = '', NULL, regexp_replace(__f{{i}}, r'{_braced(_PATTERN)}', '{'|'.join(_FIELDS.values())}'))"},
    {"__f": r"split(__f{i}, r'\|')"},
    {"__n": f"CAST(slice(__f{{i}}, 1, {len(_WHOLE)}) AS ARRAY<INT>)"},
    {"__year": _YEAR, "__month": _MONTH, "__day": _number("day"), "__last": _is("last", "!= ''"), "__hour": _HOUR,
     "__minute": _number("minute"), "__second": f"replace({_is('second', '')}, ',', '.')", "__shift": _SHIFT},
)


def _numbers(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add the numbers of each text, given by a suffix for their names; they are NULL for a missing or blank text."""
    for step in _STEPS:
        df = df.withColumns({f"{name}{i}": F.expr(e.format(i=i, text=text)) for i, text in texts.items() for name, e in step.items()})
    return df


def _valid(i: str, reading: str) -> str:
    """Whether the numbers are a time; checked before one is made, since a failure to make one is slow."""
    month, day = _month_day(i, reading)
    leap = f"__year{i} % 4 = 0 AND (__year{i} % 100 != 0 OR __year{i} % 400 = 0)"
    last = f"CASE WHEN {month} = 2 THEN IF({leap}, 29, 28) WHEN {month} IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    # Seconds are rounded to millionths, and may not become sixty.
    return (f"(__year{i} IS NOT NULL AND {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND {last} AND __hour{i} < 24 "
            f"AND __minute{i} < 60 AND __second{i} < '59.9999995' AND abs(__shift{i}) < 1440)")


def _month_day(i: str, reading: str) -> tuple[str, str]:
    if reading == "month first":
        return f"__month{i}", f"__day{i}"
    return f"IF(__last{i}, __day{i}, __month{i})", f"IF(__last{i}, __month{i}, __day{i})"


def _time(i: str, reading: str) -> str:
    """UTC time of valid numbers; a time without a zone is UTC."""
    month, day = _month_day(i, reading)
    second = f"CAST(IF(__second{i} = '', 0, CAST(__second{i} AS DECIMAL(11, 9))) AS DECIMAL(16, 6))"
    made = f"try_make_timestamp_ntz(__year{i}, {month}, {day}, __hour{i}, __minute{i}, {second})"
    return f"timestampadd(MINUTE, -__shift{i}, {made})"


def with_times(df: DataFrame, readings: dict[str, str]) -> DataFrame:
    """Text columns as UTC times by the readings that the vote found, so all values are valid or missing."""
    if not readings:
        return df
    columns = df.columns
    numbers = _numbers(df, {str(i): f"`{name}`" for i, name in enumerate(readings)})
    return numbers.withColumns({name: F.expr(_time(str(i), r)) for i, (name, r) in enumerate(readings.items())}).select(
        *[f"`{c}`" for c in columns])


def vote(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """The reading of each column whose values all parse, in one pass; a row of counts per column comes back."""
    if not names:
        return {}
    # One value per row, so that one set of expressions serves any number of columns.
    texts = df.selectExpr(f"posexplode(array({', '.join(f'`{n}`' for n in names)})) AS (i, text)").where("text IS NOT NULL")
    counts = _numbers(texts, {"": "text"}).groupBy("i").agg(
        F.count("__f"), *(F.count_if(F.expr(_valid("", r))) for r in READINGS))
    out = {}
    for i, n, *valid in counts.collect():
        if fits := [r for r, v in zip(READINGS, valid, strict=True) if n and v == n]:
            out[names[i]] = fits[0]
    return {name: out[name] for name in names if name in out}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def infer_formats(df: DataFrame) -> DataFrame:
    """Text columns become plain UTC times if they have values and all of them parse; others stay as they are.

    Blank texts count as missing. Offsets may differ from row to row.
    """
    return with_times(df, vote(df, text_columns(df)))
