"""Column predicates and names that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timed(begin: Column | str = "clip_begin_ms", end: Column | str = "clip_end_ms") -> Column:
    """A span that has a place in the audio: begin >= 0 and end > begin. Null bounds are not timed."""
    b, e = (F.col(c) if isinstance(c, str) else c for c in (begin, end))
    return F.coalesce((b >= 0) & (e > b), F.lit(False))


def active_at(t: Column, begin: Column | str = "clip_begin_ms", end: Column | str = "clip_end_ms") -> Column:
    """Half-open activity: begin <= t < end."""
    b, e = (F.col(c) if isinstance(c, str) else c for c in (begin, end))
    return (b <= t) & (t < e)


def in_column(left: Column, column_left: Column, column_right: Column) -> Column:
    """A box belongs to a column from four pixels before it up to its right edge."""
    return (left >= column_left - 4) & (left < column_right)


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores behind it until it is none of `names`, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
