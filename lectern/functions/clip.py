"""Clip times and clock formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
_WHOLE = r"^\s*([-+]?[0-9]+)"


def leading_number(text: Column) -> Column:
    """The number that a text begins with; NaN if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, _NUMBER, 1), F.lit("")).cast("double"), F.lit(float("nan")))


def _leading_whole(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, _WHOLE, 1), F.lit("")).cast("double"), F.lit(float("nan")))


def clip_ms(text: Column) -> Column:
    """Milliseconds of a clip time: '1500ms', '1.5s', '1:02:03.5', '02:03.5', else plain seconds.

    Suffixes are looked at first; only a leading number counts ('2min' is two seconds); other numbers of
    colons give 0; empty or null gives 0; no number gives NaN.
    """
    t = F.trim(text)
    parts = F.split(t, ":")
    n = F.size(parts)
    at = lambda i: F.element_at(parts, i)
    clock = F.when(n == 3, _leading_whole(at(1)) * 3600 + _leading_whole(F.try_element_at(parts, F.lit(2))) * 60 + leading_number(F.try_element_at(parts, F.lit(3)))).when(n == 2, _leading_whole(at(1)) * 60 + leading_number(F.try_element_at(parts, F.lit(2)))).otherwise(F.lit(0.0))
    return (
        F.when(text.isNull() | (text == ""), F.lit(0.0))
        .when(t.endswith("ms"), leading_number(F.substring(t, F.lit(1), F.length(t) - 2)))
        .when(t.endswith("s"), leading_number(F.substring(t, F.lit(1), F.length(t) - 1)) * 1000)
        .when(t.contains(":"), clock * 1000)
        .otherwise(leading_number(t) * 1000)
    )


def hours_text(ms: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; rounded down; 'n/a' for what isn't finite."""
    s = F.floor(ms / 1000).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    finite = ms.isNotNull() & ~F.isnan(ms) & (F.abs(ms) < float("inf"))
    return F.when(~finite, F.lit("n/a")).when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def minutes_text(ms: Column) -> Column:
    """m:ss, minutes without end."""
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))


def seconds_to_ms(seconds: Column) -> Column:
    """Rounded half up; -1 for unknown."""
    return F.when(seconds < 0, F.lit(-1.0)).otherwise(F.floor(seconds * 1000 + 0.5).cast("double"))


def seek_target(begin_ms: Column) -> Column:
    return begin_ms.cast("long") + 1
